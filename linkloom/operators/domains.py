"""Per-domain state: look-up with defaults, budgets of pages, accumulated sets, seeded samples, which domains to ignore."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_domain_state(rows: DataFrame, domains: DataFrame, defaults: dict[str, object], on_get: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds columns of ``domains`` (one row per domain), or their defaults. on_get: what is done with a state that is read."""
    known = (domains if on_get is None else on_get(domains)).select("domain", *defaults)
    return rows.join(known, "domain", "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def new_domains(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains of ``rows`` that have no state yet."""
    return rows.select("domain").where("domain is not null").distinct().join(domains.select("domain"), "domain", "left_anti")


def accessible() -> Column:
    return F.col("fatal_error").isNull()


def ignored(max_pages: int) -> Column:
    """Inaccessible, banned, or with its pages used up."""
    return F.coalesce(F.col("fatal_error").isNotNull() | F.col("banned") | (F.col("queued_pages") >= max_pages), F.lit(False))


def shuffled(key: Column, seed: int) -> Column:
    """A random order that is the same in every run, and in SQL elsewhere."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def sampled(rows: DataFrame, limit: Column | int, by: str, key: str, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows of each ``by``, chosen at random."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(shuffled(F.col(key), seed), key))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= limit).drop("_turn")


def within_budget(rows: DataFrame, max_pages: int, seed: int = 0, rank: str = "class_rank", key: str = "fingerprint") -> DataFrame:
    """Rows (domain, queued_pages, rank, key) that still fit their domain's budget: taken by rank, at random within one."""
    turn = F.row_number().over(Window.partitionBy("domain").orderBy(rank, shuffled(F.col(key), seed), key))
    ranked = rows.withColumn("_turn", turn).where(F.col("_turn") <= max_pages)  # Spark plans this one as a top-k of each domain
    return ranked.where(F.col("_turn") + F.col("queued_pages") <= max_pages).drop("_turn")


def queued(rows: DataFrame) -> DataFrame:
    """Pages of each domain among ``rows``, to be added to queued_pages."""
    return rows.groupBy("domain").agg(F.count("*").cast("int").alias("queued_pages"))


def collected(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """The distinct values of ``column`` by domain, in order; the first ``limit`` of them."""
    values = rows.select("domain", column).where(F.col(column).isNotNull()).distinct()
    if limit is not None:  # a top-k of each domain, before any array is made
        values = values.withColumn("_turn", F.row_number().over(Window.partitionBy("domain").orderBy(column))).where(F.col("_turn") <= limit)
    return values.groupBy("domain").agg(F.array_sort(F.collect_list(column)).alias(column))


def storable(rows: DataFrame, key: str = "domain", limit: int = 255, field_limit: int = 1_992_294) -> DataFrame:
    """Rows whose key has 1 to ``limit`` characters, with text fields above ``field_limit`` bytes nulled and columns whose name
    begins with ``_`` left out."""
    names = [c for c in rows.columns if not c.startswith("_")]
    texts = {c for c, kind in rows.dtypes if kind == "string" and c != key}
    cut = [F.when(F.octet_length(c) <= field_limit, F.col(c)).alias(c) if c in texts else F.col(c) for c in names]
    return rows.where(F.length(key).between(1, limit)).select(*cut)
