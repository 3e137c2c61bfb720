"""Overused hosts: detecting them, parking their rows, serving the parked rows in turn, and purging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overused(slots: DataFrame, factor: float = 5.0) -> DataFrame:
    """Hosts of ``slots`` (host, active, concurrency) that are busier than ``factor`` times their concurrency."""
    return slots.where(F.col("active") / F.col("concurrency") > factor).select("host")


def split(rows: DataFrame, busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hosts that aren't busy, and the rest."""
    return rows.join(busy.select("host"), "host", "left_anti"), rows.join(busy.select("host"), "host", "left_semi")


def round_robin(pending: DataFrame, busy: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Pending rows (host, seq, ..), one host after the other, hosts that are busy left out; with ``turn`` (from 1)."""
    free = pending if busy is None else split(pending, busy)[0]
    turned = free.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("seq")))
    return turned if limit is None else turned.orderBy("turn", "host").limit(limit)


def serve(pending: DataFrame, fresh: DataFrame, busy: DataFrame, max_n: int) -> tuple[DataFrame, DataFrame]:
    """A batch, and what stays pending: first the pending rows of free hosts, in turn, then fresh ones (of which the caller
    fetched what was lacking); fresh rows of busy hosts are parked. Both have host, seq and equal columns."""
    served = round_robin(pending, busy, max_n).drop("turn")
    free, parked = split(fresh, busy)
    keys = [c for c in ("host", "seq", "id") if c in pending.columns]  # rows of one place in the order are told apart by id
    left = pending.join(served.select(keys), keys, "left_anti")
    return served.unionByName(free), left.unionByName(parked)


def purged(pending: DataFrame, max_per_key: int | None = None, keep_per_key: int = 1000, max_keys: int | None = None, keep_keys: int = 100, seed: int = 0) -> DataFrame:
    """Pending rows after purging: a host of more than max_per_key rows keeps its latest keep_per_key; if there are more than
    max_keys hosts, keep_keys of them stay, chosen by hash."""
    if max_per_key is not None:
        by_host = Window.partitionBy("host")
        ranked = pending.withColumns({"_n": F.count("*").over(by_host), "_late": F.row_number().over(by_host.orderBy(F.col("seq").desc()))})
        pending = ranked.where((F.col("_n") <= max_per_key) | (F.col("_late") <= keep_per_key)).drop("_n", "_late")
    if max_keys is not None:
        hosts = pending.select("host").distinct()
        some = hosts.orderBy(F.md5(F.concat(F.coalesce("host", F.lit("")), F.lit(str(seed)))), "host").limit(keep_keys)
        many = hosts.agg((F.count("*") > max_keys).alias("_many"))
        chosen = some.withColumn("_stay", F.lit(True))
        pending = pending.join(chosen, "host", "left").crossJoin(F.broadcast(many)).where("_stay or not _many").drop("_stay", "_many")
    return pending


def sizes(pending: DataFrame) -> DataFrame:
    """Rows and hosts pending."""
    return pending.agg(F.count("*").alias("pending"), F.count_distinct("host").alias("hosts"))
