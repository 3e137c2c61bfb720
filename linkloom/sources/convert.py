"""Rows of other crawling tools as requests and responses of this one, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: By tool, its column for each of ours.
COLUMNS = {
    "plain": {"url": "url", "method": "method", "headers": "headers", "cookies": "cookies", "meta": "meta", "body": "body", "status_code": "status_code"},
    "http": {"url": "url", "method": "method", "headers": "headers", "cookies": "cookies", "meta": "params", "body": "data", "status_code": "status_code"},
    "scraper": {"url": "url", "method": "method", "headers": "headers", "cookies": "cookies", "meta": "meta", "body": "body", "status_code": "status"},
}


def to_frontier(rows: DataFrame, tool: str = "plain") -> DataFrame:
    """Rows of a tool under our names: method in upper case (GET if there is none), header values as lists; other columns stay."""
    names = {theirs: ours for ours, theirs in COLUMNS[tool].items() if theirs in rows.columns}
    out = rows.withColumnsRenamed(names)
    out = out.withColumn("method", F.upper(F.coalesce("method", F.lit("GET"))) if "method" in out.columns else F.lit("GET"))
    if dict(out.dtypes).get("headers") == "map<string,string>":
        out = out.withColumn("headers", F.transform_values("headers", lambda _, v: F.array(v)))
    return out


def from_frontier(rows: DataFrame, tool: str = "plain") -> DataFrame:
    """Our rows under a tool's names; of a header with several values, one value with commas between."""
    if dict(rows.dtypes).get("headers") == "map<string,array<string>>":
        rows = rows.withColumn("headers", F.transform_values("headers", lambda _, v: F.array_join(v, ", ")))
    return rows.withColumnsRenamed({ours: theirs for ours, theirs in COLUMNS[tool].items() if ours in rows.columns})
