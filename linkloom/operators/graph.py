"""The crawl graph: pages and the links between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.order import numbered
from linkloom.sources.store import kept


def site(spark: SparkSession, prefix: str, depth: int, fan_out: int, self_links: bool = False) -> DataFrame:
    """A complete tree of pages as (parent, child): page names are the root's ``prefix1`` with a digit for each level."""
    level = spark.range(1).select(F.lit(f"{prefix}1").alias("url"))
    found = None
    for _ in range(depth - 1):
        edges = level.select(F.col("url").alias("parent"), F.explode(F.sequence(F.lit(1), F.lit(fan_out))).alias("n")).select("parent", F.concat("parent", F.col("n").cast("string")).alias("child"))
        found = edges if found is None else found.unionByName(edges)
        level = edges.select(F.col("child").alias("url"))
    if self_links and found is not None:
        own = found.select(F.col("parent").alias("url")).unionByName(found.select(F.col("child").alias("url"))).distinct()
        found = found.unionByName(own.select(F.col("url").alias("parent"), F.col("url").alias("child")))
    return found


def pages(rows: DataFrame) -> DataFrame:
    """Pages of rows (url, status, n_redirects, is_seed, seq): one per URL, as first seen, numbered in that order."""
    first = rows.groupBy("url").agg(F.min_by(F.struct("status", "n_redirects", "is_seed", "seq"), "seq").alias("p"))
    rows = first.select("url", "p.status", "p.n_redirects", "p.is_seed", "p.seq")
    return numbered(rows, "seq", "url").select("id", "url", "status", "n_redirects", "is_seed")


def edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (parent_id, child_id) of links (parent, child) between known pages."""
    ids = nodes.select("id", "url")
    by_parent = links.join(ids.select(F.col("id").alias("parent_id"), F.col("url").alias("parent")), "parent")
    return by_parent.join(ids.select(F.col("id").alias("child_id"), F.col("url").alias("child")), "child").select("parent_id", "child_id").distinct()


def seeds(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_seed")


def links_of(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """Of each page that has links: url, and the pages it links to."""
    child = nodes.select(F.col("id").alias("child_id"), F.col("url").alias("link"))
    return arcs.join(child, "child_id").join(nodes.select(F.col("id").alias("parent_id"), "url"), "parent_id").groupBy("url").agg(F.array_sort(F.collect_list("link")).alias("links"))


def degrees(links: DataFrame) -> DataFrame:
    """Links out of and into each page of links (parent, child), each distinct one once."""
    once = links.select("parent", "child").distinct()
    ends = once.select(F.col("parent").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(once.select(F.col("child").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("url").agg(F.sum("o").alias("links"), F.sum("i").alias("referers"))


def nodes(links: DataFrame) -> DataFrame:
    """Distinct pages of links (parent, child)."""
    return links.select(F.col("parent").alias("url")).union(links.select("child")).distinct()


def kinds(rows: DataFrame) -> DataFrame:
    """Adds ``is_error`` (status is no number) and ``is_redirect`` (300 to 399)."""
    code = F.col("status").try_cast("int")
    return rows.withColumns({"is_error": code.isNull() & F.col("status").isNotNull(), "is_redirect": F.coalesce(code.between(300, 399), F.lit(False))})


def recorded(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and edges of recorded events (url, status, parent, seq): pages that never got a status go, with the edges into
    them."""
    seen = events.groupBy("url").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.min("seq").alias("seq")).where("status is not null")
    arcs = events.where("parent is not null").select("parent", F.col("url").alias("child")).distinct().join(seen.select(F.col("url").alias("child")), "child", "left_semi")
    return seen, arcs


def recorder_counters(events: DataFrame) -> DataFrame:
    """Of recorded events (url, status, parent, is_seed, seq), one row: pages, seeds and links as they were added, how many pages
    and links were removed in the end since they never got a status, and what is left."""
    by_page = events.groupBy("url").agg(F.max(F.coalesce("is_seed", F.lit(False)).cast("int")).alias("seed"), (F.count("status") > 0).alias("answered"), F.count_distinct("parent").alias("parents"))
    gone = ~F.col("answered")
    return by_page.agg(
        F.count("*").alias("pages_added"), F.coalesce(F.sum("seed"), F.lit(0)).alias("seeds_count"), F.coalesce(F.sum("parents"), F.lit(0)).alias("links_added"),
        F.coalesce(F.sum(gone.cast("bigint")), F.lit(0)).alias("pages_removed"), F.coalesce(F.sum(F.when(gone, F.col("parents"))), F.lit(0)).alias("links_removed"),
    ).withColumns({"pages_count": F.col("pages_added") - F.col("pages_removed"), "links_count": F.col("links_added") - F.col("links_removed")})


def samples(spark: SparkSession) -> dict[str, DataFrame]:
    """Small sites to try a crawl on, as links (parent, child): trees, loops, shared pages, several hosts."""
    made = lambda rows: spark.createDataFrame(rows, "parent string, child string")
    one, two = site(spark, "http://one.test/", 4, 2), site(spark, "http://two.test/", 4, 2)
    hosts = [(f"http://h{k}.test/", f"http://h{(k * m + 1) % 7}.test/{m}") for k in range(7) for m in range(1, 4)]
    return {
        "tree": one, "two_trees": one.unionByName(two), "tree_with_loops": site(spark, "http://three.test/", 5, 2, True), "pair": made([("http://a.test/1", "http://a.test/2"), ("http://a.test/2", "http://a.test/1")]),
        "triangle": made([(f"http://a.test/{k}", f"http://a.test/{k % 3 + 1}") for k in (1, 2, 3)]), "shared": made([("http://a.test/1", "http://a.test/3"), ("http://a.test/2", "http://a.test/3")]),
        "loop": made([("http://a.test/1", "http://a.test/1")]), "hosts": made(hosts), "hosts_and_back": made(hosts + [(b, a) for a, b in hosts]),
    }


def dot(links: DataFrame) -> DataFrame:
    """The graph in the DOT language, a line per row, in order."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    lines = links.select("parent", "child").distinct().select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted("parent"), F.lit(" -> "), quoted("child"), F.lit(";")).alias("line"))
    ends = links.sparkSession.createDataFrame([(0, "digraph {"), (2, "}")], "part int, line string")
    return ends.unionByName(lines).orderBy("part", "line").select("line")


def depths(links: DataFrame, roots: DataFrame, limit: int = 100) -> DataFrame:
    """Least distance of each page reachable from ``roots`` (url) over links (parent, child), breadth first: each level is one
    join with the links and an exclusion of what was reached, written to the shared folder."""
    arcs = kept(links.select("parent", "child").distinct().repartition("parent"))  # found once, and laid out as each level joins it
    front = kept(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    fronts = [front]
    for level in range(1, limit + 1):
        found = reduce(DataFrame.unionByName, fronts)
        front = kept(arcs.join(front, arcs["parent"] == front["url"]).select(F.col("child").alias("url")).distinct().join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        fronts.append(front)  # a level is written once
    return reduce(DataFrame.unionByName, fronts)
