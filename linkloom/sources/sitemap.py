"""Sitemaps and page links as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls

_LOC = r"(?s)<(?:\w+:)?{0}>\s*(?:<(?:\w+:)?(?!loc)\w+>[^<]*</[^>]*>\s*)*<(?:\w+:)?loc>\s*([^<\s]+)\s*</(?:\w+:)?loc>"


def parsed(files: DataFrame) -> DataFrame:
    """Entries of sitemaps (url, body): base, url, is_sitemap (an entry that names another sitemap), place. Pages first, each
    kind from the end, entities decoded, links made absolute."""
    plain = F.regexp_replace(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")

    def of(tag: str, sub: bool):
        found = F.reverse(F.regexp_extract_all(plain, F.lit(_LOC.format(tag)), 1))
        return F.transform(found, lambda u, i: F.struct(F.replace(u, F.lit("&amp;"), F.lit("&")).alias("link"), F.lit(sub).alias("is_sitemap"), i.alias("n")))

    each = files.select(F.col("url").alias("base"), F.posexplode(F.concat(of("url", False), of("sitemap", True))).alias("place", "e"))
    return each.select("base", urls.join(F.col("base"), F.col("e.link")).alias("url"), F.col("e.is_sitemap").alias("is_sitemap"), "place")


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links of pages (url, html, other columns): base, url (absolute), place, the other columns. Script, mail and empty links are
    left out."""
    others = [c for c in pages.columns if c not in ("url", "base", "place", "link", html)]
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"']"), 1)
    each = pages.select(F.col("url").alias("base"), *others, F.posexplode(found).alias("place", "link")).where("trim(link) <> '' and not lower(link) rlike '^(javascript|mailto|tel|data):'")
    return each.select("base", urls.join(F.col("base"), F.replace(F.trim("link"), F.lit("&amp;"), F.lit("&"))).alias("url"), "place", *others)
