"""Helpers that the training-data operators share.

Conventions that hold for every operator here:

* Only the columns that an operator names are read; other columns, whatever they are called, don't matter to it.
* A row whose id is null can't be referred to, so the row-level operators leave it out of their reports; the
  pipeline's stages pass such rows on unless they say otherwise.
* A null text counts as the empty text, unless an operator says otherwise.
* A *word* is a maximal run of characters other than ASCII white space.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- columns that only pass through ---------------------------------------------------------------------------


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one struct, so that none of them clashes with a name used here."""
    rest = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(True).alias("none")]).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns again, in their order."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in columns))


def measured(docs: DataFrame, length: str | None) -> DataFrame:
    """docs whose column `length`, if it is named and one of whole numbers, holds the length of the text, where that isn't
    null, again."""
    if length is None or length not in docs.columns or not isinstance(docs.schema[length].dataType, T.IntegralType):
        return docs
    return docs.withColumn(length, F.coalesce(F.length("text").cast(docs.schema[length].dataType), F.col(quoted(length))))


# ---- cutting lineage ------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local session (as in tests) gets a
    temporary folder; on a cluster there is none that all machines see, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


class Written:
    """Tables written to the shared folder by one call of an operator. drop() removes those that no later step reads; the
    others go when the driver ends, as a result may be read until then, but for those that belong to the result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.root = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, stays: bool = False) -> DataFrame:
        """Writes df, and returns it read back: its lineage starts at the files, which outlive lost executors."""
        path = f"{self.root}-{name}" if stays else f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not stays and not self.paths:
            files, at = _files(self.spark, self.root)
            files.deleteOnExit(at)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))

    def keep(self, *names: str) -> None:
        """Drops all others."""
        self.drop(*(x for x in list(self.paths) if x not in names))


# ---- Arrow batches --------------------------------------------------------------------------------------------


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each part have about `most` bytes: bounds a worker's memory."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    got = batch.column(column)
    return pc.fill_null(got, "") if got.null_count else got


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin in them (one entry more than texts)."""
    split = pc.ascii_split_whitespace(texts)
    ends = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(int(ends[0]), int(ends[-1] - ends[0])) if len(ends) else split.values
    ends -= ends[0]
    real = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), kept[ends]


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes; each distinct word of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    named = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return named[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
