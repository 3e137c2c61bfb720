"""A crawl simulated over a graph of links: which URLs a frontier hands out, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.operators import queue
from linkloom.sources.store import kept

SCORES = {"basic": lambda d: F.lit(1.0), "breadth_first": scoring.breadth_first, "depth_first": scoring.depth_first}


def crawl(links: DataFrame, seeds: DataFrame, strategy: str = "breadth_first", order: str = "score_desc", max_next: int = 64, rate: int | None = None, rounds: int = 10_000, add_all: bool = False) -> DataFrame:
    """url, iteration, place of each request. links: parent, child, place (order on the page); seeds: url, place.

    Each round takes the first ``max_next`` of the queue by ``order``, fetches them, and queues their links that were not
    queued or fetched before. ``rate``: requests of a host (the URL up to its first ``/``, if there is no scheme) in a round;
    the others wait. add_all: every page and link is a seed, after those given."""
    if add_all:
        last = seeds.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
        all_ = links.select(F.col("parent").alias("url"), F.lit(0).alias("side")).union(links.select("child", F.lit(1))).groupBy("url").agg(F.min("side").alias("side")).join(seeds.select("url"), "url", "left_anti")
        seeds = seeds.select("url", "place").unionByName(all_.select("url", (F.row_number().over(Window.orderBy("side", "url")) - 1 + last).alias("place")))
    spark = links.sparkSession
    score = SCORES[strategy]
    # Links of one page lie in few rows: a round is a join of its batch with the links, and what it keeps is written out.
    waiting = kept(seeds.select("url", F.lit(0).alias("depth"), F.col("place").cast("bigint").alias("seq")).withColumn("score", score(F.col("depth"))))
    seen = kept(spark.createDataFrame([], "url string"))
    done = None
    base = waiting.count()
    for n in range(rounds):
        keys = queue.order(order) if isinstance(order, str) else order
        rows = waiting.withColumns({"id": F.col("seq"), "created_at": F.col("seq"), "host": F.regexp_extract("url", r"^(?:\w+://)?([^/]*)", 1)})
        if rate is not None:
            rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("host").orderBy(*keys))).where(F.col("_turn") <= rate).drop("_turn")
        batch = kept(rows.withColumn("place", F.row_number().over(Window.orderBy(*keys))).where(F.col("place") <= max_next).select("url", "depth", "seq", "place"))
        if batch.isEmpty():
            break
        out = batch.select("url", F.lit(n).alias("iteration"), "place")
        done = out if done is None else done.unionByName(out)
        seen = seen.unionByName(batch.select("url"))
        known = seen.unionByName(waiting.select("url")) if n else seen
        found = batch.select(F.col("url").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("place").alias("at")).join(links, "parent")
        first = found.groupBy(F.col("child").alias("url")).agg(F.min(F.struct("at", "place")).alias("o"), F.min_by("depth", F.struct("at", "place")).alias("depth"))
        fresh = first.join(known, "url", "left_anti").select("url", "depth", (F.row_number().over(Window.orderBy("o")) + F.lit(base)).cast("bigint").alias("seq"))
        left = waiting.join(batch.select("seq"), "seq", "left_anti").select("url", "depth", "seq", "score")
        waiting = kept(left.unionByName(fresh.withColumn("score", score(F.col("depth")))))
        base += 1 << 20
    return done if done is not None else spark.createDataFrame([], "url string, iteration int, place int")


def fetched(waiting: DataFrame, rate: int) -> tuple[DataFrame, DataFrame]:
    """A round of a fetcher that takes ``rate`` requests of each host (url, host, created_at, id): those taken, and the hosts that
    still have some waiting, as it reports them to be overused."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy("created_at", "id"))
    taken = waiting.withColumn("_turn", turn).where(F.col("_turn") <= rate).drop("_turn")
    more = waiting.groupBy("host").agg(F.count("*").alias("waiting")).where(F.col("waiting") > rate).select("host", (F.col("waiting") - rate).alias("waiting"))
    return taken, more


def run(spark: SparkSession, graph: list[tuple[str, list[str]]], seeds: list[str], **options) -> list[str]:
    """The order in which a small graph of (page, its links) is crawled."""
    links = spark.createDataFrame([(p, c, k) for p, own in graph for k, c in enumerate(own)] or [], "parent string, child string, place int")
    return [r["url"] for r in crawl(links, spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, place int"), **options).orderBy("iteration", "place").collect()]
