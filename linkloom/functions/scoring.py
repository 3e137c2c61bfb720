"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import hashing

ROBOTS, HOME, INTERESTING, OTHER, DEFAULT = 0.9, 0.8, 0.7, 0.5, 0.1


def breadth_first(depth: Column) -> Column:
    """1, 1/2, 1/3, .. by depth."""
    return F.lit(1.0) - depth / (depth + F.lit(1.0))


def depth_first(depth: Column) -> Column:
    """0, 1/2, 2/3, .. by depth."""
    return depth / (depth + F.lit(1.0))


def by_class(kind: Column) -> Column:
    """The score of a page's class: robots, sitemap, home, interesting, other."""
    return (
        F.when(kind.isin("robots", "sitemap"), F.lit(ROBOTS)).when(kind == "home", F.lit(HOME)).when(kind == "interesting", F.lit(INTERESTING))
        .when(kind == "other", F.lit(OTHER)).otherwise(F.lit(DEFAULT))
    )


def host_jitter(score: Column, host: Column, signed: bool = True) -> Column:
    """A tenth by the host's hash, hundredths by the score, so hosts interleave. ``signed=False`` divides the unsigned CRC
    by the same number, and scores of half the hosts then exceed 1."""
    crc = F.abs(hashing.signed_crc32(host).cast("bigint")) if signed else F.crc32(F.encode(host, "utf-8"))
    return F.floor(crc / F.lit(2147483647.0) * 10) / F.lit(10.0) + F.greatest(F.lit(0.01), score - F.lit(0.01)) / F.lit(10.0)


def bucket(score: Column, resolution: float = 0.01) -> Column:
    """The interval of a score in 0..1, by its number: every tenth boundary belongs to the interval below. Null outside."""
    at = (score / F.lit(float(resolution))).cast("int")
    return F.when((score >= 0) & (score <= 1), F.when((at % 10 == 0) & (at > 0), at - 1).otherwise(at))


def bucket_start(score: Column, resolution: float = 0.01) -> Column:
    """Where the score's interval starts."""
    return bucket(score, resolution) * F.lit(float(resolution))


def bucket_key(score: Column) -> Column:
    """Hundred times the start of the score's interval of a hundredth, as a whole number."""
    return (bucket_start(score) * F.lit(100.0)).cast("int")
