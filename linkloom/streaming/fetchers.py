"""A fetcher's side of the bus: it reads its partition of the feed, and writes what it found to the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.functions import hashing
from linkloom.sources import events as log


class Fetcher:
    """Requests of one partition of a feed, batch by batch, and results as events of its log."""

    def __init__(self, spark: SparkSession, feed: str, log_path: str, partition: int = 0, log_partitions: int = 1, jid: int = 0):
        self.spark, self.feed, self.log_path, self.partition, self.log_partitions, self.jid = spark, feed, log_path, partition, log_partitions, jid
        self.batch = -1

    def get_next_requests(self) -> DataFrame:
        """Requests (events of type request) of the batches that weren't read yet."""
        rows = self.spark.read.schema("key string, value string, partition_id int, batch bigint").parquet(self.feed)
        rows = rows.where((F.col("partition_id") == self.partition) & (F.col("batch") > self.batch))
        last = rows.agg(F.max("batch")).first()[0]
        until = self.batch if last is None else last
        fresh = rows.where(F.col("batch") <= until)
        self.batch = until
        return log.decoded(fresh)

    def send(self, kind: str, rows: DataFrame) -> None:
        """Rows (columns of schema.EVENT) as events of one type."""
        fields = self.spark.createDataFrame([], schema.EVENT).schema
        rows = rows.withColumns({"type": F.lit(kind), "jid": F.lit(self.jid)})
        events = rows.select(*(rows[f.name].cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        log.append(log.encoded(events).withColumn("partition_id", hashing.fingerprint_partition(F.col("key"), self.log_partitions)), self.log_path)

    def page_crawled(self, pages: DataFrame) -> None:
        self.send("page_crawled", pages)

    def links_extracted(self, pages: DataFrame) -> None:
        self.send("links_extracted", pages)

    def request_error(self, requests: DataFrame) -> None:
        self.send("request_error", requests)

    def offset(self, offset: int, produced: int, seq: int) -> None:
        """How far this fetcher is, and the feed's producer."""
        self.send("offset", self.spark.createDataFrame([(self.partition, offset, produced, seq)], "partition_id int, offset bigint, producer_offset bigint, seq bigint"))

    def stats(self, values: dict[str, float], ts: str, seq: int) -> None:
        row = self.spark.createDataFrame([(self.partition, {k: float(v) for k, v in values.items()}, ts, seq)], "partition_id int, stats map<string,double>, ts string, seq bigint")
        self.send("stats", row.withColumn("ts", F.col("ts").cast("timestamp")))
