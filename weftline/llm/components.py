"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(edges: DataFrame, tables: Written, name: str = "cc") -> DataFrame:
    """edges: (a, b), longs. Returns (id, root): every id that occurs, with the smallest id of its component.

    Each round is written to the shared folder, which cuts the lineage; the table of the round before goes. A round's
    work is proportional to its edges, and there are about as many rounds as the logarithm of the longest path.
    Edges with a null end and loops are left out; repeated edges count once.
    """
    now = tables.put(f"{name}0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, turn = None, 0
    while True:
        turn += 1
        # large star: of every node, each larger neighbour is tied to the smallest of node and neighbours
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = tables.put(f"{name}{turn}l", large)
        # small star: each smaller neighbour and the node itself are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a <> b").distinct()
        after = tables.put(f"{name}{turn}", small)
        tables.drop(f"{name}{turn - 1}", f"{name}{turn}l")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        now, state = after, mark
    return after.select(F.col("a").alias("id"), F.col("b").alias("root")).union(after.select("b", "b").distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label: the smallest row known of each row's component; the pairs (a, b) are joined to it."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
