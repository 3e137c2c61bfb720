"""The event log: its encoding, and the logs and feeds as folders of files that batches and streams both read.

A Kafka topic takes the folder's place by ``format='kafka'`` where that connector is on the cluster; the encoding is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.functions import hashing


def encoded(events: DataFrame) -> DataFrame:
    """key and value (JSON without nulls) of events."""
    return events.select(F.col("fingerprint").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def decoded(messages: DataFrame) -> DataFrame:
    """Events of messages (value); those that can't be read, or whose type isn't known, are left out: see ``broken``."""
    return _parsed(messages).where(_good()).select("e.*").drop("_bad")


def broken(messages: DataFrame) -> DataFrame:
    """The messages that ``decoded`` leaves out."""
    return _parsed(messages).where(~_good()).drop("e")


def _parsed(messages: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return messages.withColumn("e", F.from_json("value", schema.EVENT + ", _bad string", options))


def _good():
    return F.coalesce(F.col("e._bad").isNull() & F.col("e.type").isin(*schema.EVENT_TYPES), F.lit(False))


def of_job(events: DataFrame, jid: int) -> DataFrame:
    """Events of the current job; those of another or none are dropped."""
    return events.where(F.col("jid") == jid)


def partitioned(events: DataFrame, n: int, by_host: bool = False) -> DataFrame:
    """Adds the log's partition: by fingerprint, or by host so that a host's events stay together."""
    return events.withColumn("partition_id", hashing.crc_partition(F.col("host"), n) if by_host else hashing.fingerprint_partition(F.col("fingerprint"), n))


def per_host(links: DataFrame, most: int = 10_000) -> DataFrame:
    """Links (host, fingerprint, url) grouped by host, in order of fingerprint, as (host, part, links, n); those without host or
    fingerprint are left out. The links of a host of more than ``most`` are parted by fingerprint (hexadecimal), into about so many each."""
    links = links.where("host is not null and fingerprint is not null").select("host", "fingerprint", "url")
    parts = links.groupBy("host").agg(F.ceil(F.count("*") / most).alias("parts"))
    part = F.pmod(F.conv(F.right("fingerprint", F.lit(8)), 16, 10).cast("bigint"), F.col("parts")).cast("int")
    return links.join(parts, "host").withColumn("part", part).groupBy("host", "part").agg(F.array_sort(F.collect_list(F.struct("fingerprint", "url"))).alias("links"), F.count("*").alias("n"))


def append(messages: DataFrame, path: str) -> None:
    """Producer: add messages (key, value, partition_id) to a log."""
    messages.write.mode("append").partitionBy("partition_id").parquet(path)


def read(spark: SparkSession, path: str, partitions: list[int] | None = None) -> DataFrame:
    """Consumer of a whole log, or of some partitions (only their folders are read)."""
    df = spark.read.schema("key string, value string, partition_id int").parquet(path)
    return df if partitions is None else df.where(F.col("partition_id").isin(*partitions))


def stream(spark: SparkSession, path: str, partitions: list[int] | None = None, files_per_batch: int = 512, **kafka: str) -> DataFrame:
    """Consumer as a stream; with options for Kafka, of a topic instead of a folder."""
    if kafka:
        df = spark.readStream.format("kafka").options(**kafka).load().selectExpr("cast(key as string) key", "cast(value as string) value", "partition as partition_id")
    else:
        df = spark.readStream.schema("key string, value string, partition_id int").option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return df if partitions is None else df.where(F.col("partition_id").isin(*partitions))
