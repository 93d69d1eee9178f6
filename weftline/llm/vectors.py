"""Tables of vectors: which rows count, and packing them for exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix


def valid(table: DataFrame, zero: bool = True) -> tuple[DataFrame, int]:
    """((id, v), dimension): one row for each id with a vector that can be compared.

    Left out: null ids, null vectors, vectors with a null, NaN or infinite element, and those whose length isn't the
    table's (the commonest one, the shortest of equally common); with zero=False also zero vectors. Of rows that
    repeat an id, the one with the smallest vector counts.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null and size(v) > 0 and forall(v, x -> x is not null and x = x and abs(x) < float('infinity'))")
    if not zero:
        rows = rows.where("exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    rows = rows.where(F.size("v") == dim)
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows, dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim).astype(np.float32)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(ids, np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each array's rows there), for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(bucket) else [0]
    arrays = tuple(a[order] for a in arrays)
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[order[i]]), *(np.ascontiguousarray(a[i:j]).tobytes() for a in arrays)
