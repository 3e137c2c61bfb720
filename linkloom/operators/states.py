"""Link states and keyed tables: look-up with a default, exclusion of what is known, first and last wins, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.schema import NOT_CRAWLED


def with_state(batch: DataFrame, states: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Adds ``state``; a link that isn't in ``states`` (one row per key) is NOT_CRAWLED."""
    known = states.select(key, F.col("state").cast("int").alias("state"))
    return batch.drop("state").join(known, key, "left").withColumn("state", F.coalesce("state", F.lit(NOT_CRAWLED)))


def not_crawled(batch: DataFrame, states: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The rows whose link is NOT_CRAWLED or unknown."""
    return batch.join(states.where(F.col("state") != NOT_CRAWLED).select(key), key, "left_anti")


def first_wins(df: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """Of each key the row of least ``order``."""
    return _one(df, key, F.min_by, order)


def last_wins(df: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """Of each key the row of greatest ``order``."""
    return _one(df, key, F.max_by, order)


def _one(df: DataFrame, key: str, pick, order: str) -> DataFrame:
    # An aggregate, not a window: it is combined before the shuffle.
    names = df.columns
    return df.groupBy(F.col(key).alias("_key")).agg(pick(F.struct(*names), F.col(order)).alias("_row")).select("_row.*")


def upsert(table: DataFrame, changes: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """``table`` (one row per key) with ``changes`` applied in order: of each column the last value that isn't null wins,
    so a change need not carry all columns. New keys are inserted; columns of ``table`` only."""
    names = table.columns
    full = changes.select(*(F.col(c) if c in changes.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in names))
    return latest(table.unionByName(full), key, order)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of each column the value of greatest order that isn't null."""
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*picks, F.max(order).alias(order)).select(*rows.columns)


def misses(wanted: DataFrame, cached: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Distinct keys that are wanted and not cached."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")


