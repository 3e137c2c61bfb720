"""Counters of a crawl as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_status(events: DataFrame, status: str = "status_code") -> DataFrame:
    """Events by status and in total (status null), in one pass."""
    return events.rollup(status).agg(F.count("*").alias("n"), F.grouping(status).alias("total"))


def counters(events: DataFrame) -> DataFrame:
    """Events and links by type, and the last sequence number of each."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("links"), F.lit(0))).alias("links"), F.max("seq").alias("last_seq"))


def pushed_by_host(batches: DataFrame, seconds: int = 300) -> DataFrame:
    """Requests handed out by partition, host and interval."""
    return batches.groupBy("partition_id", "host", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select("partition_id", "host", F.col("w.start").alias("start"), "n")


def lag(produced: DataFrame, consumed: DataFrame, max_next: int) -> DataFrame:
    """By partition: how far its consumer is behind (a missing offset is 0), and whether it is ready for another batch."""
    gap = F.col("produced") - F.coalesce("consumed", F.lit(0))
    joined = produced.select("partition_id", F.col("offset").alias("produced")).join(consumed.select("partition_id", F.col("offset").alias("consumed")), "partition_id", "left")
    return joined.select("partition_id", gap.alias("lag"), (gap < max_next).alias("ready"))


def readiness(offsets: DataFrame, max_next: int) -> DataFrame:
    """By partition, from its latest offset event (partition_id, offset, producer_offset, seq) that isn't ahead of the
    producer: ready if it lags by less than max_next or hasn't begun."""
    behind = F.col("producer_offset") - F.col("offset")
    latest = offsets.where(behind >= 0).groupBy("partition_id").agg(F.max_by(F.struct("offset", behind.alias("lag")), "seq").alias("o"))
    return latest.select("partition_id", "o.offset", "o.lag", ((F.col("o.lag") < max_next) | (F.col("o.offset") == 0)).alias("ready"))


def gaps(messages: DataFrame) -> DataFrame:
    """Messages (partition_id, seq) that don't follow the one before by 1: how many are missing."""
    step = F.col("seq") - F.lag("seq").over(Window.partitionBy("partition_id").orderBy("seq"))
    return messages.withColumn("missing", step - 1).where("missing > 0")


def cache(lookups: DataFrame, batch: int) -> DataFrame:
    """Of look-ups (hit boolean): hits, misses, ratio, and batches of misses sent."""
    hits, missed = F.sum(F.col("hit").cast("int")), F.sum((~F.col("hit")).cast("int"))
    return lookups.agg(hits.alias("hits"), missed.alias("misses"), (hits / F.count("*")).alias("ratio"), F.ceil(missed / batch).alias("batches"))


def keyed(stats: DataFrame, prefixes: tuple[str, ...] = ("consumed", "pushed", "dropped")) -> DataFrame:
    """Rows (key, value) whose key begins with one of the prefixes, up to its first ``_``."""
    return stats.where(F.substring_index("key", "_", 1).isin(*prefixes))


def exported(stats: DataFrame, source: str) -> DataFrame:
    """Counters (ts, partition_id, key, value) as one map per tick, with the tick's key."""
    return stats.groupBy("ts", "partition_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("stats")).withColumn(
        "id", F.concat_ws("-", F.lit(source), "partition_id", F.unix_timestamp("ts").cast("string"))
    )


def logged(messages: DataFrame, include: dict[str, list[str]] | None = None, exclude: dict[str, list[str]] | None = None, width: int | None = None) -> DataFrame:
    """Log rows whose fields are null or among ``include`` and not among ``exclude``; message cut to ``width``, with dots."""
    for c, values in (include or {}).items():
        messages = messages.where(F.col(c).isNull() | F.col(c).isin(*values))
    for c, values in (exclude or {}).items():
        messages = messages.where(F.col(c).isNull() | ~F.col(c).isin(*values))
    if width is None:
        return messages
    return messages.withColumn("message", F.when(F.length("message") > width, F.concat(F.left("message", F.lit(width - 3)), F.lit("..."))).otherwise(F.col("message")))
