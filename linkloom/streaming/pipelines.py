"""Micro-batches over the event log: a strategy step, and statistics by time.

Each micro-batch becomes one epoch of the store, numbered by the batch. A batch that is replayed after a failure writes the
same epoch again, or finds it there and has no effect, so every event counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import hashing, urls
from linkloom.operators import metadata, queue, states
from linkloom.plans.strategies import Basic
from linkloom.sources import events as log
from linkloom.sources.store import FrontierStore, kept


def step(events: DataFrame, store: FrontierStore, strategy: Basic, partitions: int, epoch: int | None = None, jid: int | None = None, content: bool = False) -> int:
    """One batch of events (schema.EVENT) as one epoch, which is returned. States and metadata follow pages, errors, links and
    redirects; what the strategy schedules is queued; offsets and statistics go to their tables. With ``jid``, events of another
    job are dropped: jid is the store's job, or the one given if it has none yet, and new_job_id events change it for all that
    come after them."""
    if epoch is not None and epoch <= store.epoch:
        return store.epoch
    number = epoch if epoch is not None else store.epoch + 1
    job = None
    if jid is not None:
        job = store.jid or jid
        # Of a batch, the few events that change the job, in one row.
        changes = events.where("type = 'new_job_id'").agg(F.array_sort(F.collect_list(F.struct("seq", "jid"))).alias("_jobs"))
        last = F.try_element_at(F.filter("_jobs", lambda x: x["seq"] <= F.col("seq")), F.lit(-1))
        events = events.crossJoin(F.broadcast(changes)).where((F.col("type") == "new_job_id") | (F.col("jid") == F.coalesce(last["jid"], F.lit(job)))).drop("_jobs")
    events = kept(events)
    if jid is not None:
        job = events.where("type = 'new_job_id'").agg(F.max_by("jid", "seq")).first()[0] or job
    rows, domains = strategy.outcome(events, store)
    id_ = F.xxhash64("fingerprint", F.lit(number))  # of a link and an epoch: the same if the epoch is written again
    created = F.col("seq") * F.lit(1 << 20) + F.least("place", F.lit((1 << 20) - 1))  # an order; ties fall to id
    queued = queue.scheduled(rows, partitions).withColumns({"id": id_, "created_at": created}).drop("seq", "place")
    marks = metadata.changed_states(events.where("type in ('page_crawled', 'request_error')")).unionByName(rows.where("schedule").select("fingerprint", F.lit(1).cast("tinyint").alias("state"), "seq"))
    changes = metadata.page_crawled(events.where("type = 'page_crawled'"), content)
    moved = events.where("type = 'page_crawled' and size(redirect_urls) > 0")
    hops = metadata.redirects(moved.withColumn("redirect_fingerprints", F.transform("redirect_urls", lambda u: F.sha1(urls.canonical(u)))))
    for other in (metadata.request_error(events.where("type = 'request_error'")), rows.select("fingerprint", "url", "depth", "score", "meta", "seq"), hops):
        changes = changes.unionByName(other, allowMissingColumns=True)
    found = {
        "queue": [("put", queued)],
        "metadata": [("put", states.latest(changes.where("fingerprint is not null"), "fingerprint", "seq"))],
        "states": [("put", states.last_wins(marks))],
        "offsets": [("put", events.where("type = 'offset'").select("partition_id", "offset", "producer_offset", "seq"))],
        "stats": [("put", events.where("type = 'stats'").select("ts", "partition_id", F.explode("stats").alias("key", "value")))],
    }
    if domains is not None:
        found["domains"] = [("put", domains)]
    return store.commit(found, epoch, job)


def run(events: DataFrame, store: FrontierStore, strategy: Basic, checkpoint: str, partitions: int = 1, jid: int | None = None, every: str | None = None) -> StreamingQuery:
    """``step`` for each micro-batch of a stream of events; of what is there now, or every so often (``every='30 seconds'``)."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: step(df, store, strategy, partitions, n, jid) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counted(events: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Events by type and interval of event time, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def feed(batch: DataFrame, n: int, by_host: bool) -> DataFrame:
    """Requests of a batch as messages of the fetchers' feed, partitioned by host or by fingerprint."""
    host = urls.host(F.col("url"))
    at = hashing.crc_partition(host, n) if by_host else hashing.fingerprint_partition(F.col("fingerprint"), n)
    more = [c for c in ("jid", "depth", "meta") if c in batch.columns]
    body = F.to_json(F.struct(F.lit("request").alias("type"), "url", "fingerprint", "score", *more))
    return batch.select(F.col("fingerprint").alias("key"), body.alias("value"), at.alias("partition_id"))
