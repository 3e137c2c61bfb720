"""Seeds: one URL per line, from any path that Spark reads (local, object store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import scoring, urls


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the file or folder, stripped, without empty ones: url."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def completed(lines: DataFrame) -> DataFrame:
    """Lines without comments (``#``); those that don't begin with http get ``http://`` before and ``/`` after."""
    bare = lines.where(~F.col("url").startswith("#"))
    return bare.withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("http://"), "url", F.lit("/"))))


def robots(seeds: DataFrame) -> DataFrame:
    """The robots.txt of each seed's host, once, scored to come first; seeds without a host are left out."""
    at = F.concat(urls.scheme(F.col("url")), F.lit("://"), F.lower(urls.netloc(F.col("url"))), F.lit("/robots.txt"))
    return seeds.where(urls.host(F.col("url")).isNotNull()).select(at.alias("url")).distinct().withColumns({"kind": F.lit("robots"), "score": F.lit(scoring.ROBOTS)})
