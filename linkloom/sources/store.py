"""The frontier's tables as Parquet files that a manifest for each epoch names.

A commit writes what changed in directories of its own: rows that were put, and keys that were dropped. Its manifest, written
under another name and renamed last, carries all other directories over by name, so a commit costs what it changes. Readers see
the highest epoch whose manifest is there, whole; a job that dies at any point leaves the epoch before in place. Keyed tables
are merged when they are read: of each column the last value that isn't null. A table of more than ``compact_after`` directories
is written anew, and directories that the last ``keep`` manifests don't name are deleted then. There is one writer at a time.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.operators import states

TABLES = {"metadata": schema.METADATA, "states": schema.STATES, "queue": schema.QUEUE, "domains": schema.DOMAINS, "pending": schema.PENDING, "offsets": schema.OFFSETS, "stats": schema.STATS}
KEYS = {"metadata": "fingerprint", "states": "fingerprint", "domains": "domain", "offsets": "partition_id"}
_EMPTY = {"epoch": -1, "jid": 0, "tables": {}}


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine is made in
    local mode; on a cluster, whose machines don't share one, that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = context._jsc.sc().getCheckpointDir()
    if not named:
        if not found.isDefined() and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="linkloom-")
    if found.isEmpty():
        context.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder, with its lineage cut."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared(spark).rstrip('/')}/linkloom-{uuid.uuid4().hex}"


class FrontierStore:
    """metadata, states, queue, domains, pending (rows of busy hosts), offsets and stats in a folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] | None = None, compact_after: int = 16, keep: int = 4):
        self.spark, self.path, self.tables, self.compact_after, self.keep = spark, path.rstrip("/"), tables or TABLES, compact_after, keep

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._file(folder)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _epochs(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self._names("manifests") if x.endswith(".json") and x[:-5].isdigit())

    @property
    def epoch(self) -> int:
        """The epoch that readers see; -1 before any."""
        found = self._epochs()
        return found[-1] if found else -1

    @property
    def jid(self) -> int:
        """The number of the current job."""
        return self.manifest()["jid"]

    def manifest(self, epoch: int | None = None) -> dict:
        epoch = self.epoch if epoch is None else epoch
        if epoch < 0:
            return json.loads(json.dumps(_EMPTY))
        fs, at = self._file(f"manifests/{epoch:020d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _load(self, table: str, folders: list[str], kind: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], kind)
        df = self.spark.read.option("basePath", f"{self.path}/{table}").schema(kind).parquet(*(f"{self.path}/{table}/{x}" for x in folders))
        return df.select(*(f.name for f in self.spark.createDataFrame([], kind).schema))

    def _merged(self, table: str, own: dict, keys: DataFrame | None = None) -> DataFrame:
        rows = self._load(table, own["put"], self.tables[table])
        key = KEYS.get(table)
        if keys is not None:
            rows = rows.join(keys.select(key).distinct(), key, "left_semi")
        if own["drop"]:
            return rows.join(self._load(table, own["drop"], schema.GONE), ["id", "fingerprint"], "left_anti").select(*rows.columns)
        return states.latest(rows, key, "seq") if key and not own["whole"] else rows

    def read(self, table: str) -> DataFrame:
        """The table as of the current epoch; empty if it was never written."""
        return self._merged(table, self.manifest()["tables"].get(table, _none()))

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a keyed table whose key is among ``keys``: only they are merged."""
        return self._merged(table, self.manifest()["tables"].get(table, _none()), keys)

    def _write(self, table: str, df: DataFrame, kind: str, epoch: int, what: str) -> str:
        folder = f"part={epoch:020d}-{what}-{uuid.uuid4().hex[:12]}"
        fields = self.spark.createDataFrame([], kind).schema
        out = df.select(*(df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        writer = out.write
        (writer.partitionBy("partition_id") if table == "queue" and what == "put" else writer).parquet(f"{self.path}/{table}/{folder}")
        return folder

    def commit(self, changes: dict[str, object], epoch: int | None = None, jid: int | None = None) -> int:
        """Show changes of tables all at once as the next epoch (or as ``epoch``; one that readers see already is left as it is,
        so a replayed micro-batch has no effect). Of each table: a DataFrame that replaces it, or a list of ("put", rows) and
        ("drop", rows of id and fingerprint)."""
        old = self.manifest()
        epoch = old["epoch"] + 1 if epoch is None else epoch
        if epoch <= old["epoch"]:
            return old["epoch"]
        tables = old["tables"]
        for name, change in changes.items():
            own = tables.setdefault(name, _none())
            if isinstance(change, DataFrame):
                tables[name] = own = _none()
                change = [("put", change)]
            for what, df in change:
                own[what].append(self._write(name, df, self.tables[name] if what == "put" else schema.GONE, epoch, what))
                own["whole"] = False
            if len(own["put"]) + len(own["drop"]) > self.compact_after:
                tables[name] = _none() | {"put": [self._write(name, self._merged(name, own), self.tables[name], epoch, "put")], "whole": True}
        self._show({"epoch": epoch, "jid": old["jid"] if jid is None else jid, "tables": tables})
        if any(x["whole"] for x in tables.values()):
            self.vacuum()
        return epoch

    def _show(self, manifest: dict) -> None:
        fs, at = self._file(f"manifests/{manifest['epoch']:020d}.json")
        _, fresh = self._file(f"manifests/new-{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.rename(fresh, at)

    def vacuum(self) -> None:
        """Delete manifests before the last ``keep``, and the directories that no manifest left names."""
        found = self._epochs()
        used: dict[str, set[str]] = {}
        for epoch in found[-self.keep :]:
            for name, own in self.manifest(epoch)["tables"].items():
                used.setdefault(name, set()).update(own["put"], own["drop"])
        for epoch in found[: -self.keep]:
            self._delete(f"manifests/{epoch:020d}.json")
        last = f"part={found[-1]:020d}" if found else ""
        for name in self.tables:
            for folder in self._names(name):
                if folder not in used.get(name, ()) and folder[:25] <= last:
                    self._delete(f"{name}/{folder}")

    def _delete(self, name: str) -> None:
        fs, at = self._file(name)
        fs.delete(at, True)

    def clear(self) -> None:
        """Drop all tables."""
        self._delete("")


def _none() -> dict:
    return {"put": [], "drop": [], "whole": False}
