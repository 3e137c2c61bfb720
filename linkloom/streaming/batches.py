"""The batch generator: at each tick, one batch for every partition whose fetcher is ready for more, sent to the feed."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import queue, stats
from linkloom.plans.settings import Settings
from linkloom.sources.store import FrontierStore, kept
from linkloom.streaming import pipelines


def ready(partitions: DataFrame, offsets: DataFrame, max_next: int, assigned: Sequence[int] | None = None) -> DataFrame:
    """Of ``partitions`` (partition_id), those that may get a batch: this worker's (``assigned``; all if not given) whose fetcher
    lags by less than max_next, by its latest offset event, or hasn't reported yet."""
    own = partitions if assigned is None else partitions.where(F.col("partition_id").isin(*assigned))
    known = stats.readiness(offsets, max_next).select("partition_id", "ready")
    return own.distinct().join(known, "partition_id", "left").where(F.coalesce("ready", F.lit(True))).select("partition_id")


def planned(rows: DataFrame, offsets: DataFrame, settings: Settings = Settings(), assigned: Sequence[int] | None = None, jid: int = 0, now: int | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """The batches of a tick: the first max_next_requests of each ready partition, without blacklisted hosts (they leave the
    queue all the same), with the job's number; ``dropped`` says which rows are blacklisted."""
    some = rows.join(ready(rows.select("partition_id"), offsets, settings.max_next_requests, assigned), "partition_id", "left_semi")
    if settings.broad_crawl:
        some = some if now is None else some.where(F.col("crawl_at") <= now)
        batch = queue.tiered_batch(some, settings.max_next_requests, settings.bc_min_requests, settings.bc_min_hosts, settings.bc_max_requests_per_host, by=settings.queue_order)
    else:
        batch = queue.next_batch(some, settings.max_next_requests, by=settings.queue_order, max_per_host=settings.bc_max_requests_per_host, now=now)
    if blacklist is None:
        return queue.stamped(batch, jid).withColumn("dropped", F.lit(False))
    bad = blacklist.select(F.lower("host").alias("host"), F.lit(True).alias("dropped")).distinct()
    return queue.stamped(batch, jid).join(bad, "host", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def tick(store: FrontierStore, feed: str, settings: Settings = Settings(), assigned: Sequence[int] | None = None, now: int | None = None) -> dict[int, int]:
    """One tick over a store: how many requests each partition was sent. The batch is written to ``feed`` under the epoch that it
    takes the rows off the queue in; after a crash between the two, the same batch is written there again."""
    bad = store.spark.createDataFrame([(x,) for x in settings.domains_blacklist], "host string") if settings.domains_blacklist else None
    batch = kept(planned(store.read("queue"), store.read("offsets"), settings, assigned, store.jid, now, bad))
    sent = batch.where("not dropped")
    counts = {r["partition_id"]: r["n"] for r in sent.groupBy("partition_id").agg(F.count("*").alias("n")).collect()}
    if not batch.isEmpty():
        messages = pipelines.feed(sent, settings.spider_feed_partitions, settings.queue_hostname_partitioning)
        messages.write.mode("overwrite").partitionBy("partition_id").parquet(f"{feed}/batch={store.epoch + 1}")
        store.commit({"queue": [("drop", batch)]})
    return counts


def run(store: FrontierStore, feed: str, settings: Settings = Settings(), assigned: Sequence[int] | None = None, ticks: int | None = None, clock=time) -> int:
    """``tick`` for ever, or so many times, ``new_batch_delay`` seconds apart (``delay_on_empty`` where there was nothing to
    send); returns how many requests were sent."""
    total = n = 0
    while ticks is None or n < ticks:
        sent = sum(tick(store, feed, settings, assigned, int(clock.time())).values())
        total, n = total + sent, n + 1
        if ticks is None or n < ticks:
            clock.sleep(settings.new_batch_delay if sent else settings.delay_on_empty)
    return total


def sent(spark: SparkSession, feed: str) -> DataFrame:
    """Requests that a feed got, by partition and batch."""
    df = spark.read.parquet(feed)
    return df.groupBy("batch", "partition_id").agg(F.count("*").alias("n"))
