"""Row numbers over whole tables, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.store import kept


def numbered(df: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """Adds ``name``, 1, 2, 3, .. in the order of ``keys`` (unique, or ties are numbered in any order). Rows are range-partitioned
    and sorted, and counted within their partition; only a count for each partition is added up in one place."""
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    inner = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_row")
    rows = kept(parts.select("*", F.spark_partition_id().alias("_part"), inner))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_row")).cast("bigint").alias(name))
