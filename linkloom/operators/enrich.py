"""Row enrichment: domains, fingerprints, canonical URLs of redirects, depth. Each step is DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import hashing, urls

Step = Callable[[DataFrame], DataFrame]


def domain(url: Column, full: bool = False) -> Column:
    """Domain struct of a URL: netloc, name, scheme, sld, tld, subdomain. ``full`` splits the name at its public suffix (and
    drops user and port from netloc); otherwise the name is the host and the rest is empty."""
    host = F.coalesce(urls.host(url), F.lower(F.regexp_extract(url, r"^([^/:?#@]+)", 1)))
    if not full:
        return F.struct(urls.netloc(url).alias("netloc"), F.coalesce(urls.host(url), F.lit("")).alias("name"), urls.scheme(url).alias("scheme"), *(F.lit("").alias(k) for k in ("sld", "tld", "subdomain")))
    registered = urls.registered_domain(host)
    tld = urls.suffix(host)
    label = F.when(F.length(tld) > 0, F.substring_index(registered, ".", 1)).otherwise(F.substring_index(host, ".", -1))
    sub = F.when(F.length(host) > F.length(registered), F.substring(host, F.lit(1), F.length(host) - F.length(registered) - 1)).otherwise("")
    return F.struct(host.alias("netloc"), registered.alias("name"), urls.scheme(url).alias("scheme"), label.alias("sld"), tld.alias("tld"), sub.alias("subdomain"))


def with_domain(full: bool = False, column: str = "url") -> Step:
    """Adds ``domain``; of redirects (``redirect_urls``, if there) also ``redirect_domains``."""

    def step(df: DataFrame) -> DataFrame:
        out = df.withColumn("domain", domain(F.col(column), full))
        return out.withColumn("redirect_domains", F.transform("redirect_urls", lambda u: domain(u, full))) if "redirect_urls" in df.columns else out

    return step


def with_fingerprint(kind: str = "sha1", canonical: bool = True, column: str = "url") -> Step:
    """Adds ``fingerprint``, of the canonical URL unless told otherwise; of redirects also ``redirect_fingerprints``."""
    of = hashing.FINGERPRINTS[kind]

    def one(u: Column) -> Column:
        return of(urls.canonical(u) if canonical else u)

    def step(df: DataFrame) -> DataFrame:
        out = df.withColumn("fingerprint", one(F.col(column)))
        return out.withColumn("redirect_fingerprints", F.transform("redirect_urls", one)) if "redirect_urls" in df.columns else out

    return step


def with_domain_fingerprint(kind: str = "sha1") -> Step:
    """Adds ``domain_fingerprint``, of the domain's name."""
    return lambda df: df.withColumn("domain_fingerprint", hashing.FINGERPRINTS[kind](F.col("domain.name")))


def basic_canonical(df: DataFrame) -> DataFrame:
    """A redirected row (``redirect_urls``, ``redirect_fingerprints`` not empty) takes the URL and fingerprint it was asked
    by; its own are appended to the chains."""
    moved = F.coalesce(F.size("redirect_urls"), F.lit(0)) > 0
    return _moved(df, moved, F.element_at("redirect_urls", 1), F.element_at("redirect_fingerprints", 1))


def corporate_canonical(df: DataFrame) -> DataFrame:
    """As ``basic_canonical``, but the target stays if the first URL is a home page or the redirect stays on its host."""
    first = F.element_at("redirect_urls", 1)
    bare = (urls.query(first) == "") & urls.path(first).isin("", "/", "index.html", "index.htm", "default.htm")
    stays = bare | (urls.host(first) == urls.host(F.col("url")))
    moved = (F.coalesce(F.size("redirect_urls"), F.lit(0)) > 0) & ~F.coalesce(stays, F.lit(False))
    return _moved(df, moved, first, F.element_at("redirect_fingerprints", 1))


def _moved(df: DataFrame, moved: Column, url: Column, fingerprint: Column) -> DataFrame:
    redirected = F.coalesce(F.size("redirect_urls"), F.lit(0)) > 0
    return df.withColumns(
        {
            "url": F.when(moved, url).otherwise(F.col("url")),
            "fingerprint": F.when(moved, fingerprint).otherwise(F.col("fingerprint")),
            "redirect_urls": F.when(redirected, F.array_append("redirect_urls", F.col("url"))).otherwise(F.col("redirect_urls")),
            "redirect_fingerprints": F.when(redirected, F.array_append("redirect_fingerprints", F.col("fingerprint"))).otherwise(F.col("redirect_fingerprints")),
        }
    )


def with_depth(parent_depth: str = "parent_depth") -> Step:
    """Adds ``depth``, one below the parent's; 0 without a parent."""
    return lambda df: df.withColumn("depth", F.coalesce(F.col(parent_depth) + 1, F.lit(0)).cast("int"))


def only(condition: Column) -> Step:
    """A step that drops rows: what comes later doesn't see them."""
    return lambda df: df.where(condition)


def chain(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """All steps in order."""
    for step in steps:
        df = df.transform(step)
    return df


def requests(seeds: DataFrame, steps: Iterable[Step] | None = None, solver: Step | None = None) -> DataFrame:
    """Rows of ``url`` as requests: method GET unless given, enriched by ``steps`` (domain and fingerprint by default), last
    the canonical solver."""
    method = F.upper(F.col("method")) if "method" in seeds.columns else F.lit("GET")
    df = chain(seeds.withColumn("method", method), (with_domain(), with_fingerprint()) if steps is None else steps)
    return df.transform(solver) if solver else df


def slot_key(df: DataFrame, kind: str = "domain", dns: DataFrame | None = None) -> DataFrame:
    """Adds ``slot``: the host, or with ``kind='ip'`` its address in ``dns`` (host, ip), the host where that has none."""
    if kind == "domain":
        return df.withColumn("slot", urls.host(F.col("url")))
    hosts = df.withColumn("slot_host", urls.host(F.col("url")))
    known = dns.groupBy(F.col("host").alias("slot_host")).agg(F.min("ip").alias("slot_ip"))
    return hosts.join(known, "slot_host", "left").withColumn("slot", F.coalesce("slot_ip", "slot_host")).drop("slot_host", "slot_ip")
