"""Best-fit packing of documents into sequences of a fixed capacity, in bounded space.

A document longer than a sequence is cut into pieces, of which all but the last fill a sequence each. Pieces are placed
one by one: each goes to the open bin with the least free space that still holds it. The open bins lie in a bitset keyed by
free space, so the best fit is the lowest set bit at or above the piece's length. At most ``open_bins`` are open: to open one
more, the fullest is closed. A bin that is full closes at once.

Documents are packed in groups by a hash of doc_id and length, each in the order of doc_id and length; the groups follow
from the total length alone, so the result is the same on every cluster. Lengths are bytes of UTF-8. Rows equal in doc_id and
length are counted before they are shuffled, and spread over the groups in runs of about a megabyte, so that a doc_id (or a
missing one) that many rows share fills no group beyond its share; such rows can stand for one another.

A null or empty text has no piece. A null doc_id is packed (first in its group) and stays null. Rows of equal doc_id are packed
each on their own. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.storage import kept

_PACKED = "doc_id long, piece int, begin long, length int, bin long, place int"


@dataclass(frozen=True)
class Rules:
    """capacity: bytes of a sequence. open_bins: most open at a time. group_mb: text packed together."""

    capacity: int = 8192
    open_bins: int = 64
    group_mb: int = 64


def pack(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bin of each piece (lengths 1..capacity), numbered as they were opened, and its place in it."""
    bins, places = [], []
    free = 0  # bit f: some open bin has f free
    by_free: dict[int, list[int]] = {}
    opened = now_open = 0
    for n in lengths:
        fits = free >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            same = by_free[space]
            own = same.pop()
            if not same:
                free ^= 1 << space
        else:
            if now_open == open_bins:
                fullest = (free & -free).bit_length() - 1
                same = by_free[fullest]
                same.pop()
                if not same:
                    free ^= 1 << fullest
                now_open -= 1
            own, space = opened, capacity
            opened += 1
            now_open += 1
        bins.append(own)
        places.append(capacity - space)
        rest = space - n
        if rest:
            by_free.setdefault(rest, []).append(own)
            free |= 1 << rest
        else:
            now_open -= 1
    return bins, places


def _pack_group(group: int, ids: pa.Array, lengths: np.ndarray, times: np.ndarray, rules: Rules) -> pa.RecordBatch:
    ids, lengths = ids.take(pa.array(np.repeat(np.arange(len(times)), times))), np.repeat(lengths, times)
    pieces = -(-lengths // rules.capacity)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = number * rules.capacity
    size = np.minimum(rules.capacity, lengths[owner] - begin)
    bins, places = pack(size.tolist(), rules.capacity, rules.open_bins)
    columns = [ids.take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(begin), pa.array(size, pa.int32()), pa.array(np.array(bins, np.int64) + (group << 32)), pa.array(places, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PACKED.split(", ")])


def _run(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return _pack_group(now, table.column("doc_id").combine_chunks(), table.column("length").to_numpy(), table.column("times").to_numpy(), rules)

        for batch in batches:  # in order of group
            group = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and group[a] != now:
                    yield done()
                    held = []
                now = int(group[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return run


def packed(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), begin (byte in the document), length, bin, place (byte in the bin)."""
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.col("text").cast("string")).cast("long").alias("length")).where("length > 0")
    sizes = kept(lengths.groupBy("doc_id", "length").agg(F.count("*").alias("n")))
    groups = -(-(sizes.agg(F.sum(F.col("length") * F.col("n"))).first()[0] or 0) // (rules.group_mb << 20)) or 1
    # Runs of rows that are alike, by thousands of runs, so that no array of their numbers is long.
    many = sizes.withColumn("most", F.greatest(F.lit(1), F.expr(f"{1 << 20} div length")))
    many = many.withColumn("thousand", F.explode(F.expr("sequence(0, (n - 1) div most div 1024)")))
    many = many.withColumn("run", F.explode(F.expr("sequence(thousand * 1024, least(thousand * 1024 + 1023, (n - 1) div most))")))
    grouped = many.select(F.pmod(F.xxhash64("doc_id", "length", "run"), F.lit(groups)).cast("long").alias("group"), "doc_id", "length", F.expr("least(most, n - run * most)").alias("times"))
    return grouped.repartition("group").sortWithinPartitions("group", "doc_id", "length").mapInArrow(_run(rules), _PACKED)
