"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a short vector of statistics of its whole text (lengths, shares of character classes, repeated
lines, distinct words ...), moved to a scale on which they are closer to normal. For each class the mean and a
covariance are estimated from labelled documents; the covariance is shrunk towards the pooled one and that towards a
multiple of the identity, which keeps it well conditioned. The Cholesky factor of each covariance is computed once, on
the driver, and travels with the model: a document's score is

    log prior_1 - log prior_0 + log N(x; mean_1, cov_1) - log N(x; mean_0, cov_0)

with Mahalanobis distances by the factors' inverses, which are computed once as well. Documents with score >= threshold are kept.

Edge cases: a null or empty text is scored like any other (all statistics at their floor); with no labelled rows, or
of one class only, or a class with fewer rows than dimensions + 2, there is no model: every document is kept with a
null score; labels with nulls are left out, as are ids labelled both ways; documents with a null id are scored; repeated rows are scored alike and
don't count twice in the fit, where of labelled rows that repeat an id that with the smallest statistics counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, packed_rows, pieces, texts_of, unpacked, words_of

#: Documented bound: the model is fitted on at most so many labelled documents (those first by a hash of the id).
FIT_ROWS = 20_000

#: A document is rejected where the odds against it are more than 20 to 1: when in doubt it stays.
THRESHOLD = -3.0

NAMES = ("log_words", "word_length", "upper", "digits", "punctuation", "symbols", "bars", "distinct", "ends_in_symbol", "words_a_line", "repeated_lines", "sentences", "spaces", "beyond_ascii")

# character classes by byte
_LOWER, _UPPER, _DIGIT, _PUNCT, _BAR, _SYMBOL, _SPACE, _HIGH, _CONT = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _c in b".,;:?'\"()-":
    _CLASS[_c] = _PUNCT
_CLASS[ord("|")] = _BAR
for _c in b" \t\n\r\v\f":
    _CLASS[_c] = _SPACE
_CLASS[128:192] = _CONT
_CLASS[192:] = _HIGH


#: A share k of n is taken as (k + WEIGHT * usual) of (n + WEIGHT), so that a few words say little about a document.
WEIGHT = 20.0
#: Statistics count as at most so many standard deviations from the mean: beyond, a density fitted here says nothing.
FAR = 3.0


def _logit(k: np.ndarray, n: np.ndarray, usual: float) -> np.ndarray:
    share = (np.minimum(k, n) + WEIGHT * usual) / (n + WEIGHT)
    return np.log(share / (1 - share))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of len(NAMES) statistics for each text (nulls already replaced)."""
    rows = len(texts)
    if not rows:
        return np.zeros((0, len(NAMES)))
    at = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    kind = _CLASS[raw]
    counts = np.bincount(owner * 9 + kind, minlength=rows * 9).reshape(rows, 9).astype(np.float64)
    chars = counts.sum(1) - counts[:, _CONT]
    solid = np.maximum(chars - counts[:, _SPACE], 0)

    words, starts = words_of(texts)
    n = np.diff(starts).astype(np.float64)
    holder = np.repeat(np.arange(rows, dtype=np.int64), np.diff(starts))
    if len(words):
        coded = words.dictionary_encode()
        key = holder * np.int64(len(coded.dictionary)) + coded.indices.to_numpy()
        first = np.sort(key)
        first = first[np.concatenate([[True], first[1:] != first[:-1]])]
        distinct = np.bincount(first // len(coded.dictionary), minlength=rows).astype(np.float64)
    else:
        distinct = np.zeros(rows)
    # the byte before white space, or the last of a text, ends a word
    space = kind == _SPACE
    last = ~space
    if len(raw):
        follows = np.concatenate([space[1:], [True]])
        ends = at[1:][np.diff(at) > 0] - 1
        follows[ends] = True
        last &= follows
    odd_end = np.bincount(owner[last & ((kind == _SYMBOL) | (kind == _BAR))], minlength=rows).astype(np.float64)
    sentence = np.bincount(owner[last & ((raw == ord(".")) | (raw == ord("?")) | (raw == ord("!")))], minlength=rows).astype(np.float64)
    lines = np.bincount(owner[raw == ord("\n")], minlength=rows).astype(np.float64) + 1
    split = pc.split_pattern(texts, "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    line_owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    different = np.unique(line_owner * np.int64(max(1, len(flat.dictionary))) + flat.indices.to_numpy())
    kinds_of_line = np.bincount(different // max(1, len(flat.dictionary)), minlength=rows).astype(np.float64)

    share = _logit

    letters = counts[:, _LOWER] + counts[:, _UPPER]
    long = np.divide(solid + WEIGHT * 5, n + WEIGHT)
    return np.column_stack([
        np.log1p(n), np.log(long), share(counts[:, _UPPER], letters, 0.03), share(counts[:, _DIGIT], solid, 0.002), share(counts[:, _PUNCT], solid, 0.03), share(counts[:, _SYMBOL], solid, 0.001), share(counts[:, _BAR], solid, 0.001), share(distinct, n, 0.7), share(odd_end, n, 0.01), np.log1p((n + WEIGHT) / (lines + WEIGHT / 20)), share(lines - kinds_of_line, lines, 0.02), share(sentence, n, 0.1), share(counts[:, _SPACE], chars, 0.15), share(counts[:, _HIGH], solid, 0.05),
    ])


class Model:
    """Means, Cholesky factors (computed once, here) and log priors of the two classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: float = 0.2, ridge: float = 0.05):
        self.shift, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self.scaled(x)
        own = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
        share = [float((y == c).mean()) for c in (0, 1)]
        pooled = share[0] * own[0] + share[1] * own[1]
        d = x.shape[1]
        self.means, self.factors, self.constants = [], [], []
        for c in (0, 1):
            cov = (1 - alpha) * own[c] + alpha * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.means.append(z[y == c].mean(0))
            self.factors.append(np.linalg.inv(factor))
            self.constants.append(np.log(share[c]) - np.log(np.diag(factor)).sum())

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) / self.scale).clip(-FAR, FAR)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        log = [k - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.constants)]
        return log[1] - log[0]


_FEATURES = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def labelled(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `rows` labelled documents, the first by a hash of the id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most")).where("label = _most").select("doc_id", "label")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids of 12 bytes: the bound makes the broadcast safe at any size of the corpus
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "label", "text")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = statistics(texts_of(part, "text"))
                yield batch_of({"doc_id": part.column("doc_id"), "label": part.column("label"), "x": list(x)}, pa.schema([("doc_id", pa.int64()), *_FEATURES]))

    found = texts.mapInArrow(stats, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    x = np.array(found["x"].to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    return x[order], found["label"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "quality") -> Model | None:
    x, y = labelled(docs, labels, rows, label)
    if min((y == 0).sum(), (y == 1).sum()) < len(NAMES) + 2:
        return None
    return Model(x, y)


def _scored(model: Model | None, threshold: float, keep_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                score = np.full(part.num_rows, np.nan) if model is None else model.score(statistics(texts_of(part, "text")))
                keep = np.isnan(score) | (score >= threshold)
                if keep_only:
                    yield part.filter(pa.array(keep))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, from_pandas=True), pa.array(keep)], names=["doc_id", "score", "keep"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, keep): one row for each row of docs."""
    model = fit(docs, labels, rows)
    return docs.select("doc_id", "text").mapInArrow(_scored(model, threshold, False), "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay."""
    model = fit(docs, labels, rows)
    rows = packed_rows(docs)
    return unpacked(rows.mapInArrow(_scored(model, threshold, True), rows.schema), docs.columns)
