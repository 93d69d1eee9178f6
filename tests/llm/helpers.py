import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns whose names operators use too."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(30_000))
    same = " ".join(f"w{k}" for k in range(120))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (None, "an orphan text", "en", "a", None), (None, None, None, None, None),
        (4, long, "en", None, len(long)), (5, same, "en", "b", len(same)), (6, same, "en", "b", len(same)), (6, same, "en", "b", len(same)), (7, same + " tail", "en", "b", None), (7, None, "en", "b", 0),
        (8, "one", "en", "c", 3), (9, "ümläut 日本語 \U0001f600", "de", "c", 12),
    ]
    extra = "id long, runs string, rest int, label int, score double, keep boolean, `a.b` string, nth int, gone string, start int, bucket int, lo long, group_id long, n long, map map<string,int>, list array<map<int,string>>, raw binary, inner struct<doc_id: int, m: map<int,int>>"
    return spark.createDataFrame([(*r, 9, "r", 1, 1, 0.5, False, "x", 7, "g", 3, 2, 1, 5, 0, {"k": 1}, [{1: "a"}, {}], b"raw", (1, {2: 3})) for r in rows], f"{SCHEMA}, {extra}")


def text_lengths(docs):
    """docs whose n_chars is a string, which no operator may touch."""
    return docs.drop("n_chars").selectExpr("*", "'x' AS n_chars")


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, words=800):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(words)}" for _ in range(n))
