"""robots.txt: validity, sitemaps, and which URLs a crawler may fetch."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls

RULES = "array<struct<path:string,allow:boolean>>"

def valid(body: Column) -> Column:
    """Whether the first line that is neither empty nor a comment begins with user-agent: or sitemap:."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(body, "^﻿", ""), r"\r\n|\r|\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.lower(F.try_element_at(lines, F.lit(1))).rlike(r"^(user-agent|sitemap):"), F.lit(False))


def sitemaps(files: DataFrame) -> DataFrame:
    """The sitemaps that robots files (url, body) name, as absolute URLs, with the file's url as ``base``."""
    named = F.regexp_extract_all("body", F.lit(r"(?m)^Sitemap:[ \t]*(\S+)"), 1)
    return files.where(valid(F.col("body"))).select(F.col("url").alias("base"), F.explode(named).alias("link")).select("base", urls.join(F.col("base"), F.col("link")).alias("url")).distinct()


def _rules(agent: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for body in frame["body"]:
                parser = RobotFileParser()
                parser.parse((body or "").splitlines())
                group = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                out.append([{"path": unquote(r.path), "allow": r.allowance} for r in group.rulelines] if group else [])
            yield frame.drop(columns=["body"]).assign(rules=out)

    return run


def rules(files: DataFrame, agent: str) -> DataFrame:
    """Of robots files (body, other columns), with ``rules`` for body: the paths of the group for ``agent`` in their order. A file
    is parsed once, here; ``with_allowed`` needs no parser."""
    names = [c for c in files.columns if c != "body"]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names) + f", rules {RULES}"
    return files.select(*names, "body").mapInPandas(_rules(agent), kinds)


def allowed(url: Column, own: Column) -> Column:
    """Whether ``own`` (rules; null: all is allowed) let ``url`` be fetched: the first whose path begins the URL's path decides."""
    decoded = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    url = F.coalesce(decoded, url)
    query, mark = urls.query(url), urls.fragment(url)
    path = F.concat(urls.part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(mark != "", F.concat(F.lit("#"), mark)).otherwise(""))
    path = F.when(path == "", "/").otherwise(path)
    first = F.try_element_at(F.filter(own, lambda r: (r["path"] == "*") | path.startswith(r["path"])), F.lit(1))
    return F.coalesce(first["allow"], F.lit(True))


def with_allowed(rows: DataFrame, agent: str, by: str = "rp_body") -> DataFrame:
    """Adds ``allowed`` to rows of url and ``by`` (the robots file of its domain; null: all is allowed). Each distinct file is
    parsed once, and its rules are joined to the rows."""
    known = rules(rows.where(F.col(by).isNotNull()).select(F.col(by).alias("_file"), F.col(by).alias("body")).distinct(), agent)
    return rows.join(known, F.col(by) == F.col("_file"), "left").withColumn("allowed", allowed(F.col("url"), F.col("rules"))).drop("_file", "rules")
