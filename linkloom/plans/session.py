"""The frontier of a crawl as a driver object over a store: seeds in, batches out, results in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.operators import enrich, metadata, order, queue
from linkloom.operators import overused as parking
from linkloom.plans.settings import Settings
from linkloom.plans.strategies import Basic
from linkloom.sources.store import FrontierStore, kept
from linkloom.streaming import pipelines


class FrontierSession:
    """add_seeds, get_next_requests, page_crawled, links_extracted, request_error, revisit. Each call is one epoch of the store;
    results are the events that ``pipelines.step`` takes from a stream. Use as a context manager, or call ``stop``."""

    def __init__(self, spark: SparkSession, path: str, strategy: Basic | None = None, settings: Settings = Settings(), auto_start: bool = True):
        self.spark, self.store, self.strategy, self.settings = spark, FrontierStore(spark, path), strategy or Basic(), settings
        self.iteration = self.n_requests = 0
        self.started = auto_start
        self.stopped = False

    def __enter__(self) -> FrontierSession:
        self.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()

    def start(self) -> None:
        if self.stopped:
            raise RuntimeError("the session has stopped")
        self.started = True

    def stop(self) -> None:
        self.stopped = True

    def _running(self) -> None:
        if not self.started or self.stopped:
            raise RuntimeError("the session isn't running")

    @property
    def finished(self) -> bool:
        limit = self.settings.max_requests
        return bool(limit and self.n_requests >= limit) or self.strategy.finished(self.store.read("queue"))

    def _requests(self, rows: DataFrame) -> DataFrame:
        s = self.settings
        solver = None
        if "redirect_urls" in rows.columns:
            solver = enrich.corporate_canonical if s.canonical_solver == "corporate" else enrich.basic_canonical
        steps = (enrich.with_domain(s.tldextract_domain_info), enrich.with_fingerprint(s.url_fingerprint_function), enrich.with_domain_fingerprint(s.domain_fingerprint_function))
        return enrich.requests(rows, steps, solver)

    def _step(self, kind: str, rows: DataFrame) -> None:
        """One epoch of the rows as events, numbered in the order of ``seq`` after those of earlier epochs."""
        self._running()
        base = (self.store.epoch + 1) << 22  # times 2^20 for the places of links, this leaves 2^21 epochs of 2^22 events
        rows = rows.withColumns({"type": F.lit(kind), "seq": F.col("seq").cast("bigint") + F.lit(base)})
        if dict(rows.dtypes).get("headers") == "map<string,string>":
            rows = rows.withColumn("headers", F.transform_values("headers", lambda _, v: F.array(v)))
        fields = self.spark.createDataFrame([], schema.EVENT).schema
        events = rows.select(*(rows[f.name].cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        pipelines.step(events, self.store, self.strategy, self.settings.spider_feed_partitions, content=self.settings.store_content)

    def add_seeds(self, seeds: DataFrame) -> None:
        """Rows of url (and seq, else in the order of url) that aren't known yet are scheduled, or what the strategy makes of them."""
        self._running()
        if "seq" not in seeds.columns:
            seeds = order.numbered(seeds, "url", name="seq")
        self._step("add_seeds", self._requests(seeds))

    def get_next_requests(self, max_next_requests: int = 0, overused: list[str] = [], partitions: list[int] | None = None, now: int | None = None) -> DataFrame:
        """The next batch, taken off the queue: at most so many of each partition, and of all, if the crawl has a limit. Rows of
        hosts that are overused are parked, and served first, host by host, when their hosts are free again. now: leaves out
        rows of a later crawl_at."""
        self._running()
        s = self.settings
        n = queue.clamp(max_next_requests or s.max_next_requests, s.max_requests, self.n_requests)
        busy = self.spark.createDataFrame([(h.lower(),) for h in overused], "host string")
        pending = self.store.read("pending")
        if partitions is not None:
            pending = pending.where(F.col("partition_id").isin(*partitions))
        served = kept(parking.round_robin(pending, busy, n).drop("turn"))
        rows = self.store.read("queue")
        if s.domains_blacklist:
            rows = queue.without_blacklisted(rows, self.spark.createDataFrame([(x,) for x in s.domains_blacklist], "host string"))
        if partitions is not None:
            rows = rows.where(F.col("partition_id").isin(*partitions))
        had = served.count()
        if s.broad_crawl:
            due = rows if now is None else rows.where(F.col("crawl_at") <= now)
            fresh = queue.tiered_batch(due, n, s.bc_min_requests, s.bc_min_hosts, s.bc_max_requests_per_host, by=s.queue_order)
        else:
            fresh = queue.next_batch(rows, n, by=s.queue_order, max_per_host=s.bc_max_requests_per_host, now=now)
        fresh = fresh.where(F.col("place") <= n - had)
        if s.max_requests:
            fresh = fresh.orderBy("place", "partition_id").limit(max(0, n - had))
        fresh = kept(fresh)
        from_queue = fresh.count()
        free, parked = (fresh, fresh.limit(0)) if busy.isEmpty() else parking.split(fresh, busy)
        batch = kept(served.withColumn("place", F.lit(0)).unionByName(free, allowMissingColumns=True).drop("seq").orderBy("partition_id", "place"))
        taken = batch.count()
        if from_queue or had:
            self.store.commit({"queue": [("drop", fresh)], "pending": [("drop", served), ("put", parked.withColumn("seq", F.col("created_at")))]})
            self._purge()
        if taken:
            self.n_requests += taken
            self.iteration += 1
        return batch

    def _purge(self) -> None:
        s = self.settings
        if s.overused_max_per_key is not None or s.overused_max_keys is not None:
            pending = kept(self.store.read("pending"))
            left = kept(parking.purged(pending, s.overused_max_per_key, s.overused_keep_per_key, s.overused_max_keys, s.overused_keep_keys))
            if left.count() < pending.count():
                self.store.commit({"pending": left})

    def page_crawled(self, pages: DataFrame) -> None:
        """Rows (url, status_code, ts, seq; headers, body, redirect_urls, meta if there) of pages that were fetched."""
        self._running()
        self._step("page_crawled", self._requests(pages))

    def links_extracted(self, links: DataFrame) -> None:
        """Rows (parent_url, url, seq) of links; those that aren't known yet are scheduled."""
        self._running()
        fp = self.settings.url_fingerprint_function
        link = enrich.with_fingerprint(fp)(links.withColumn("host", F.lit(None).cast("string")))
        parents = enrich.with_fingerprint(fp, column="parent_url")(link.withColumnRenamed("fingerprint", "_link")).withColumnRenamed("fingerprint", "_parent")
        known = self.store.lookup("metadata", parents.select(F.col("_parent").alias("fingerprint"))).select(F.col("fingerprint").alias("_parent"), "depth")
        rows = parents.join(known, "_parent", "left")
        one = F.array(F.struct("url", F.col("_link").alias("fingerprint"), "host", F.lit(None).cast("int").alias("depth")))
        self._step("links_extracted", rows.select(F.col("parent_url").alias("url"), F.col("_parent").alias("fingerprint"), "depth", one.alias("links"), "seq"))

    def request_error(self, requests: DataFrame) -> None:
        """Rows (url, error, ts, seq) of requests that failed."""
        self._running()
        self._step("request_error", self._requests(requests))

    def revisit(self, now: Column) -> int:
        """Queue the pages that were fetched longer than ``revisit_interval`` before ``now`` (a timestamp) and aren't queued;
        returns how many."""
        self._running()
        pages = metadata.due(self.store.read("metadata"), self.settings.revisit_interval, now)
        waiting = self.store.read("states").where(F.col("state") == schema.QUEUED).select("fingerprint")
        rows = pages.join(waiting, "fingerprint", "left_anti").withColumns({"schedule": F.lit(True), "score": F.coalesce("score", F.lit(1.0)), "crawl_at": F.unix_timestamp("crawl_at")})
        epoch = self.store.epoch + 1
        rows = rows.select("url", "fingerprint", "depth", "score", "schedule", "crawl_at", "meta", F.lit(epoch << 22).cast("bigint").alias("seq"))
        queued = kept(queue.scheduled(rows, self.settings.spider_feed_partitions).withColumns({"id": F.xxhash64("fingerprint", F.lit(epoch)), "created_at": F.col("seq") * F.lit(1 << 20)}))
        n = queued.count()
        if n:
            self.store.commit({"queue": [("put", queued)], "states": [("put", queued.select("fingerprint", F.lit(schema.QUEUED).alias("state"), "seq"))]})
        return n

