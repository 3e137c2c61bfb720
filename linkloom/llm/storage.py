"""Where intermediate results go: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine is made in
    local mode; on a cluster, whose machines don't share one, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not named:
        if not found.isDefined() and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="linkloom-")
    if found.isEmpty():
        context.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, with its lineage cut; it outlives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession) -> str:
    """A path of its own in the shared folder, for a table written there."""
    return f"{shared(spark).rstrip('/')}/linkloom-{uuid.uuid4().hex}"


def removed(spark: SparkSession, at: str) -> None:
    """Takes away a table that was written to a ``place``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def size(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads; above 2^60 if that isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))


def width(df: DataFrame, per_mb: float) -> int:
    """A number of partitions for ``df``: the session's, or more where the tables it reads, if their size is known, ask
    for more than ``per_mb`` MB each."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return few if size(df) > 1 << 60 else max(few, -(-size(df) // int(per_mb * 1e6)))


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text: what documents are told apart by."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
