"""Changes of the metadata table that crawl events make. Each gives rows for ``states.upsert``, with seq."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.states import first_wins


def seeds(requests: DataFrame) -> DataFrame:
    """Inserts of seeds, at depth 0."""
    return requests.withColumn("depth", F.lit(0))


def page_crawled(events: DataFrame, content: bool = False) -> DataFrame:
    """Of crawled pages (url, fingerprint, status_code, ts, seq): fetched_at and status_code, and method, headers, cookies, meta
    and domain_fingerprint where the events have them; with ``content`` the body."""
    more = ["body"] if content and "body" in events.columns else []
    return _carried(events, "status_code", *more).withColumnsRenamed({"body": "content"})


def request_error(events: DataFrame) -> DataFrame:
    """Of failed requests (url, fingerprint, error, ts, seq): fetched_at and error, and what ``page_crawled`` carries."""
    return _carried(events, "error")


def _carried(events: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(events.dtypes)
    headers = F.transform_values("headers", lambda _, v: F.element_at(v, 1)) if kinds.get("headers", "").endswith("array<string>>") else F.col("headers")
    more = [headers.alias(c) if c == "headers" else F.col(c) for c in ("method", "headers", "cookies", "meta", "domain_fingerprint") if c in kinds]
    return events.select("fingerprint", "url", F.col("ts").alias("fetched_at"), *columns, *more, "seq")


def links(events: DataFrame) -> DataFrame:
    """The links of links_extracted events (fingerprint, url, depth, links, seq), one row each, a level below; ``host`` of the
    link, ``parent``, and place among the links."""
    each = events.select(F.col("fingerprint").alias("parent"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"), "seq", F.posexplode("links").alias("place", "link"))
    return each.select("parent", "depth", "seq", "place", "link.url", "link.fingerprint", "link.host")


def links_extracted(events: DataFrame) -> DataFrame:
    """Inserts of links, the first of each fingerprint."""
    ordered = links(events).where("fingerprint is not null").withColumn("_at", F.struct("seq", "place"))
    return first_wins(ordered, "fingerprint", "_at").select("fingerprint", "url", "depth", "seq")


def redirects(events: DataFrame) -> DataFrame:
    """One row for each redirect of a page (redirect_urls, redirect_fingerprints): its own URL and fingerprint, and as
    dest_fingerprint the last one of the chain."""
    chain = F.arrays_zip(F.col("redirect_urls").alias("url"), F.col("redirect_fingerprints").alias("fingerprint"))
    each = events.select("seq", F.element_at("redirect_fingerprints", -1).alias("dest_fingerprint"), F.explode(chain).alias("hop"))
    return each.select("hop.fingerprint", "hop.url", "dest_fingerprint", "seq")


def scores(updates: DataFrame) -> DataFrame:
    """Of update_score rows (fingerprint, score, seq): the score."""
    return updates.select("fingerprint", "score", "seq")


def due(table: DataFrame, interval: timedelta, now: Column) -> DataFrame:
    """Pages (fetched_at, other columns) that are to be fetched again: adds crawl_at, ``interval`` after they were last fetched,
    and leaves out those it isn't time for."""
    at = F.col("fetched_at") + F.make_dt_interval(secs=F.lit(float(interval.total_seconds())))
    return table.where(F.col("fetched_at").isNotNull()).withColumn("crawl_at", at).where(F.col("crawl_at") <= now)


def changed_states(events: DataFrame) -> DataFrame:
    """State changes (fingerprint, state, seq) of events: crawled 2, failed 3, scheduled 1."""
    state = F.when(F.col("type") == "page_crawled", 2).when(F.col("type") == "request_error", 3).when((F.col("type") == "update_score") & F.col("schedule"), 1)
    return events.select("fingerprint", state.cast("tinyint").alias("state"), "seq").where("state is not null and fingerprint is not null")
