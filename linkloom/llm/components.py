"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.storage import kept


def local(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) of one worker as stars: every node that isn't the least of its component, with that least."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        np.minimum.at(fresh, label[a], least)
        np.minimum.at(fresh, label[b], least)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a long, b long): every node that isn't the least of its component as a, and that least as b.

    Alternating large-star and small-star steps, O(log nodes) rounds in practice; each round's edges are written to the
    shared folder. Loops and repeated edges have no effect; nodes of one edge to themselves alone don't appear.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    now = kept(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    sign = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == sign or mark[0] == 0:
            return now
        sign = mark
        both = now.select("a", "b").unionByName(now.select(b.alias("a"), a.alias("b")))
        large = both.where(b > a).join(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), "a").select(b.alias("a"), m.alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != m).select(b.alias("a"), m.alias("b"))
        now = kept(small.unionByName(least.select("a", m.alias("b"))).distinct())
