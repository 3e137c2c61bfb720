"""The priority queue as a table: scheduling, the next batch, and what remains.

A batch is one plan over the whole queue. Rows are ranked by host within each partition, those above the host cap go, and
the survivors are ranked by partition; Spark plans a ranking under a limit as a grouped top-k before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import hashing, scoring, urls


def order(kind: str | Sequence[Column] = "score_desc") -> tuple[Column, ...]:
    """score_desc, score_asc, fifo, lifo, random, bucket_desc (score's interval of a hundredth, oldest first within one), or
    columns of your own."""
    if not isinstance(kind, str):
        return tuple(kind)
    tie = (F.col("created_at").asc_nulls_last(), F.col("id").asc())
    return {
        "score_desc": (F.col("score").desc_nulls_last(), *tie),
        "score_asc": (F.col("score").asc_nulls_last(), *tie),
        "bucket_desc": (scoring.bucket(F.col("score")).desc_nulls_last(), *tie),
        "fifo": tie,
        "lifo": (F.col("created_at").desc_nulls_last(), F.col("id").desc()),
        "random": (F.xxhash64("id", F.lit(17)), F.col("id")),
    }[kind]


def scheduled(batch: DataFrame, partitions: int, now: int | None = None, key: str | None = None) -> DataFrame:
    """Queue rows of the batch rows to be scheduled: adds host, host_crc32, partition_id (by slot, else domain name, else
    host, or by column ``key``) and crawl_at. A URL without host is in partition 0 with CRC 0. Scores outside 0..1 are left
    out: see ``quarantined``."""
    host = urls.host(F.col("url"))
    names = [F.col(c) for c in ("slot", "domain.name") if c.split(".")[0] in batch.columns]
    by = F.col(key) if key else F.coalesce(*names, host) if names else host
    at = F.col("crawl_at") if "crawl_at" in batch.columns else F.lit(None).cast("bigint")
    return (
        batch.where("schedule and score between 0 and 1")
        .withColumns({"host": host, "host_crc32": F.coalesce(hashing.signed_crc32(host), F.lit(0)), "partition_id": hashing.crc_partition(by, partitions), "crawl_at": F.coalesce(at, F.lit(now), F.lit(0))})
    )


def quarantined(batch: DataFrame) -> DataFrame:
    """Rows to be scheduled whose score is null or outside 0..1."""
    return batch.where("schedule and not coalesce(score between 0 and 1, false)")


def next_batch(
    queue: DataFrame, max_n: int, *, by: str | Sequence[Column] = "score_desc", partitions: Sequence[int] | None = None, max_per_host: int | None = None,
    min_hosts: int = 0, now: int | None = None, host: str = "host", inclusive_cap: bool = False,
) -> DataFrame:
    """The rows to fetch next, with ``place`` in their partition (from 1).

    max_n: rows of each partition. max_per_host: of a host in a partition (``inclusive_cap``: one more). now: leaves out rows
    of a later crawl_at. min_hosts: rows beyond max_n are taken, in order, until so many hosts are in the batch."""
    rows = queue if partitions is None else queue.where(F.col("partition_id").isin(*partitions))
    rows = rows if now is None else rows.where(F.col("crawl_at") <= now)
    keys = order(by)
    of_host = Window.partitionBy("partition_id", host).orderBy(*keys)
    of_partition = Window.partitionBy("partition_id").orderBy(*keys)
    if max_per_host is not None:
        rows = rows.withColumn("_turn", F.row_number().over(of_host)).where(F.col("_turn") <= max_per_host + int(inclusive_cap)).drop("_turn")
    if min_hosts <= 1:
        return rows.withColumn("place", F.row_number().over(of_partition)).where(F.col("place") <= max_n)
    if max_per_host is not None:  # so many rows hold min_hosts hosts, if there are that many: a top-k before the shuffle
        most = max(max_n, min_hosts * (max_per_host + int(inclusive_cap)))
        rows = rows.withColumn("place", F.row_number().over(of_partition)).where(F.col("place") <= most)
        return _broad(rows, max_n, min_hosts, keys, host)
    if not isinstance(by, str):
        return _broad(rows, max_n, min_hosts, keys, host)
    # The batch ends at its max_n-th row, or where the min_hosts-th host of the partition begins. Both are top-k before their
    # shuffle; all other rows are compared with that one, so no partition is sorted whole.
    mark = F.struct(*(c.alias(f"k{k}") for k, c in enumerate(_ascending(by))))
    leads = rows.withColumn("_turn", F.row_number().over(of_host)).where(F.col("_turn") <= 1)
    leads = leads.withColumn("_lead", F.row_number().over(of_partition)).where(F.col("_lead") <= min_hosts)
    leads = leads.groupBy("partition_id").agg(F.max(mark).alias("_host"), F.count("*").alias("_hosts"))
    nth = rows.withColumn("place", F.row_number().over(of_partition)).where(F.col("place") <= max_n).groupBy("partition_id").agg(F.max(mark).alias("_nth"))
    ends = leads.join(nth, "partition_id", "left").select("partition_id", F.when(F.col("_hosts") >= min_hosts, F.greatest("_host", "_nth")).alias("_end"))
    taken = rows.join(ends, "partition_id").where(F.col("_end").isNull() | (mark <= F.col("_end"))).drop("_end")
    return taken.withColumn("place", F.row_number().over(of_partition))


def _ascending(kind: str) -> tuple[Column, ...]:
    """Columns whose ascending order, none of them null, is ``order(kind)``."""
    score, created = F.col("score"), F.col("created_at")
    tie = (created.isNull(), F.coalesce(created, F.lit(0)), F.col("id"))
    return {
        "score_desc": (score.isNull(), F.coalesce(-score, F.lit(0.0)), *tie),
        "score_asc": (score.isNull(), F.coalesce(score, F.lit(0.0)), *tie),
        "bucket_desc": (score.isNull(), F.coalesce(-scoring.bucket(score), F.lit(0)), *tie),
        "fifo": tie,
        "lifo": (created.isNull(), F.coalesce(-created, F.lit(0)), -F.col("id")),
        "random": (F.xxhash64("id", F.lit(17)), F.col("id")),
    }[kind]


def _broad(rows: DataFrame, max_n: int, min_hosts: int, keys: Sequence[Column], host: str) -> DataFrame:
    of_host = Window.partitionBy("partition_id", host).orderBy(*keys)
    of_partition = Window.partitionBy("partition_id").orderBy(*keys)
    rows = rows.withColumn("_turn", F.row_number().over(of_host))
    before = F.coalesce(F.sum((F.col("_turn") == 1).cast("int")).over(of_partition.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"place": F.row_number().over(of_partition), "_hosts": before})
    return rows.where((F.col("place") <= max_n) | (F.col("_hosts") < min_hosts)).drop("_turn", "_hosts")


def tiered_batch(queue: DataFrame, max_n: int, min_requests: int, min_hosts: int, max_per_host: int, by: str | Sequence[Column] = "score_desc", growth: float = 5.5, tries: int = 3, host: str = "host") -> DataFrame:
    """A broad batch with a scan that widens: of the first max_n * growth^k rows of a partition, for the least k < tries that
    gives min_requests rows of min_hosts hosts under the host cap (else the last k)."""
    keys = order(by)
    of_partition = Window.partitionBy("partition_id").orderBy(*keys)
    ranked = queue.withColumn("_at", F.row_number().over(of_partition)).where(F.col("_at") <= int(max_n * growth ** (tries - 1)))
    ranked = ranked.withColumn("_turn", F.row_number().over(Window.partitionBy("partition_id", host).orderBy(*keys))).where(F.col("_turn") <= max_per_host)
    reach = [int(max_n * growth**k) for k in range(tries)]
    sums = [F.least(F.sum((F.col("_at") <= r).cast("int")), F.lit(max_n)).alias(f"n{k}") for k, r in enumerate(reach)]
    hosts = [F.sum(((F.col("_at") <= r) & (F.col("_turn") == 1)).cast("int")).alias(f"h{k}") for k, r in enumerate(reach)]
    chosen = F.lit(reach[-1])
    for k in reversed(range(tries - 1)):
        chosen = F.when((F.col(f"n{k}") >= min_requests) & (F.col(f"h{k}") >= min_hosts), reach[k]).otherwise(chosen)
    tier = ranked.groupBy("partition_id").agg(*sums, *hosts).select("partition_id", chosen.alias("_tier"))
    kept = ranked.join(tier, "partition_id").where("_at <= _tier")
    return kept.withColumn("place", F.row_number().over(of_partition)).where(F.col("place") <= max_n).drop("_at", "_turn", "_tier")


def remaining(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """The queue without exactly the rows of the batch: rows are told apart by id, and by fingerprint where both have it."""
    keys = ["id", *(["fingerprint"] if "fingerprint" in queue.columns and "fingerprint" in batch.columns else [])]
    taken = batch.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = F.col("id") == F.col("_id")
    return queue.join(taken, same & F.col("fingerprint").eqNullSafe(F.col("_fingerprint")) if len(keys) > 1 else same, "left_anti")


def counts(queue: DataFrame) -> DataFrame:
    """Rows and distinct hosts by partition."""
    return queue.groupBy("partition_id").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def enough(batch: DataFrame, min_requests: int, min_hosts: int) -> DataFrame:
    """Of each partition of a batch: rows, hosts, and whether both minimums hold."""
    sized = batch.groupBy("partition_id").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))
    return sized.withColumn("enough", (F.col("n") >= min_requests) & (F.col("hosts") >= min_hosts))


def without_blacklisted(batch: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Rows whose host isn't in ``blacklist`` (host, in any case)."""
    return batch.join(blacklist.select(F.lower("host").alias("host")), "host", "left_anti")


def stamped(batch: DataFrame, jid: int) -> DataFrame:
    """The batch with the job's number."""
    return batch.withColumn("jid", F.lit(jid))


def clamp(max_next: int, max_requests: int, returned: int) -> int:
    """How many requests may still be returned: ``max_requests`` 0 is no limit."""
    return max_next if not max_requests else max(0, min(max_next, max_requests - returned))
