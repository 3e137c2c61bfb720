"""Near-duplicate documents by SimHash: all pairs within the radius, none left out.

A document's fingerprint has 128 bits, by majority over its distinct words (runs of letters and digits, case folded).
Documents within ``radius`` bits of each other are near duplicates, and classes are the connected components of that. Equal
fingerprints are collapsed first, so thousands of copies cost as much as one.

Candidates are found by parts. Some of the bits are dealt out to parts, and each part allows so many differing bits that
allowed + 1, summed over the parts, is radius + 1. A pair beyond what is allowed in every part would differ in more bits than
the radius, so each pair within it is within what some part allows: fingerprints are ordered by a part's bits, and each cell
of equal bits is compared with the cells that few enough bits tell apart. How many parts there are, and of how many bits,
follows from the number of fingerprints; it decides what is compared, never what is found. A pair counts in the first part
that allows it only, so links are counted once.

Fingerprints are dealt out to blocks by hash, and a task holds two blocks (or one) and compares them under some or all parts.
So a task's memory is bounded, whatever cells hold. Shuffle and comparisons grow with the square of the number of
fingerprints in the end (comparisons with a small factor), as an exact join at such a radius does.

Defined results: a document is a row's doc_id and text. Rows equal in both are one document, of which ``deduplicated`` keeps
one and ``classes`` gives one row; rows of equal doc_id and other text are other documents, judged by their texts. In each
class the document of least doc_id (null last, then least hash of doc_id and text) stays. Texts without letters or digits
(null, empty) have no duplicates and stay, each of them. Extra columns are ignored, and passed through by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx
from linkloom.llm.components import components, local
from linkloom.llm.storage import kept, row_key

WIDTH = 128
_SPREAD = "cell long, rep long, hi long, lo long"


@dataclass(frozen=True)
class Rules:
    """radius: most differing bits of near duplicates. block: most fingerprints of a block, of which a task holds two."""

    radius: int = 24
    block: int = 1 << 20
    seed: int = 7


@dataclass(frozen=True)
class Parts:
    """bits: those of each part. allowed: how many of them may differ. blocks: into how many the fingerprints are dealt out.
    groups: over how many tasks the parts of two blocks are spread."""

    bits: list[np.ndarray]
    allowed: list[int]
    blocks: int
    groups: int

    @classmethod
    def sized(cls, n: int, rules: Rules) -> Parts:
        """For n distinct fingerprints: the parts of least cost."""
        blocks = max(ceil(n / rules.block), 2 if n > 1 << 17 else 1)
        rows = n / blocks

        def cut(count: int, most: int) -> list[tuple[int, int]]:
            """Bits and allowed differences of each part."""
            free = rules.radius + 1 - count
            return [(min(most, WIDTH // count + (k < WIDTH % count)), free // count + (k < free % count)) for k in range(count)]

        def cost(parts: list[tuple[int, int]]) -> float:
            """Nanoseconds of two blocks: a pair compared, a cell, a look at another cell. Cells of texts hold twice what those
            of random bits would."""
            total = 0.0
            for wide, free in parts:
                ball = sum(comb(wide, d) for d in range(min(free, wide) + 1))
                total += 6 * rows * rows * min(1, 2 * ball / 2**wide) + min(2**wide, rows) * (40_000 + 10 * ball)
            return total

        chosen = min((cut(count, most) for count in range(1, min(rules.radius + 1, 32) + 1) for most in range(21)), key=cost)
        ends = np.cumsum([wide for wide, _ in chosen])
        bits = np.split(np.random.default_rng(rules.seed).permutation(WIDTH)[: ends[-1]], ends[:-1])
        return cls(bits, [free for _, free in chosen], blocks, min(len(chosen), ceil(48 / (blocks * (blocks + 1) / 2))))


def masks(picks: list[np.ndarray]) -> np.ndarray:
    """The bits of each part as two words."""
    out = np.zeros((len(picks), 2), np.uint64)
    for t, own in enumerate(picks):
        for at in own.tolist():
            out[t, at // 64] |= np.uint64(1 << at % 64)
    return out


def fingerprint(piece: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a slice (documents x 2 words of 64 bits), and which documents have one."""
    data = tx.fold(piece.data)
    begins, ends, where = tx.tokens(data, piece.offsets, tx.WORD)
    hashed = tx.hashes(data, begins, ends)
    out = np.zeros((piece.count, 2), np.uint64)
    for k in range(piece.count):
        own = hashed[where[k] : where[k + 1]]
        if len(own):
            own = np.unique(own)
            wide = np.stack([own, tx.mix(own + np.uint64(0x9E3779B97F4A7C15))], axis=1)
            votes = _votes(wide.view(np.uint8).reshape(len(own), WIDTH // 8))
            out[k] = np.packbits(2 * votes > len(own)).view(np.uint64)
    return out, where[1:] > where[:-1]


def _votes(raw: np.ndarray) -> np.ndarray:
    """How many rows have each bit."""
    total = np.zeros(WIDTH, np.int64)
    for k in range(0, len(raw), 255):
        total += np.unpackbits(raw[k : k + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return total


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in tx.slices(batch.column(2)):
            found, there = fingerprint(piece)
            key, ids = (batch.column(k).slice(piece.first, piece.count) for k in range(2))
            hi, lo = (pa.array(x, mask=~there) for x in found.view(np.int64).T)
            yield pa.RecordBatch.from_arrays([key, ids, hi, lo], ["key", "doc_id", "hi", "lo"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """key (of doc_id and text), doc_id, hi, lo of each row; hi and lo are null where it has no words."""
    own = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_fingerprints, "key long, doc_id long, hi long, lo long")


def keys(hi: np.ndarray, lo: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint that a part has, as a number."""
    words = (hi.view(np.uint64), lo.view(np.uint64))
    key = np.zeros(len(hi), np.uint64)
    for at in picks.tolist():
        key = (key << np.uint64(1)) | ((words[at // 64] >> np.uint64(at % 64)) & np.uint64(1))
    return key.view(np.int64)


def _block(rep: np.ndarray, blocks: int) -> np.ndarray:
    return (tx.mix(rep.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _spread(parts: Parts):
    """Each row once for each block that its own is paired with and each group of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _block(batch.column(0).to_numpy(), parts.blocks)
            for other in range(parts.blocks):
                cell = (np.minimum(own, other) * parts.blocks + np.maximum(own, other)) * parts.groups
                for group in range(parts.groups):
                    yield pa.RecordBatch.from_arrays([pa.array(cell + group), *batch.columns], [x.split()[0] for x in _SPREAD.split(", ")])

    return run


def _within(a: np.ndarray, b: np.ndarray, radius: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of a and one of b (each two words by rows) within ``radius`` bits, ``block`` pairs at a time or so."""
    for left in range(0, b.shape[1], block):
        hi, lo = b[:, left : left + block]
        step = max(1, block // len(hi))
        for top in range(0, a.shape[1], step):
            far = np.bitwise_count(a[0, top : top + step, None] ^ hi)
            far += np.bitwise_count(a[1, top : top + step, None] ^ lo)
            at = np.flatnonzero(far <= radius)
            if len(at):
                yield top + at // len(hi), left + at % len(hi)


def close(hi: np.ndarray, lo: np.ndarray, ends: np.ndarray, radius: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j < ends[i] of fingerprints within ``radius`` bits, some at a time; ends[i] is where the run of row i ends."""
    words = np.stack([hi, lo]).view(np.uint64)
    begin = 0
    while begin < len(hi):
        end = int(ends[begin])
        step = max(1, min(end - begin, max(64, block // (end - begin))))
        for top in range(begin, end if end - begin > 1 else begin, step):
            for i, j in _within(words[:, top : min(end, top + step)], words[:, top:end], radius, block):
                later = i < j
                yield top + i[later], top + j[later]
        begin = end


def across(a: np.ndarray, a_key: np.ndarray, b: np.ndarray, b_key: np.ndarray, wide: int, allowed: int, radius: int, own: bool, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of a and one of b within ``radius`` bits whose keys of ``wide`` bits, in order, differ in ``allowed``
    bits at most; if a and b are one (own), those of which b's key is the larger."""
    masks = np.array([sum(1 << at for at in some) for d in range(min(allowed, wide) + 1) for some in combinations(range(wide), d)], np.int64)
    starts = np.searchsorted(b_key, np.arange((1 << wide) + 1))
    begins = tx.runs(a_key)
    ends = np.append(begins[1:], len(a_key))
    for first in range(0, len(begins), max(1, (1 << 18) // len(masks))):
        some = slice(first, first + max(1, (1 << 18) // len(masks)))
        cells = a_key[begins[some], None]
        near = cells ^ masks
        sizes = starts[near + 1] - starts[near]
        if own:
            sizes[near <= cells] = 0
        edges = np.append(0, np.cumsum(sizes.sum(axis=1)))
        low = 0
        while low < len(cells):  # cells whose neighbours are looked up at once
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 18), "right")) - 1)
            at = tx.ragged(starts[near[low:high]].ravel(), sizes[low:high].ravel())
            found = b.take(at, axis=1)
            for k in range(low, high):
                left, right = edges[k] - edges[low], edges[k + 1] - edges[low]
                if left < right:
                    begin = begins[first + k]
                    for i, j in _within(a[:, begin : ends[first + k]], found[:, left:right], radius, block):
                        yield begin + i, at[left + j]
            low = high


def linked(rep: np.ndarray, hi: np.ndarray, lo: np.ndarray, block: np.ndarray | None, some: range, parts: Parts, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what ``some`` of the parts are the first to allow: the stars (every node that isn't the least of its component
    here, and that least), and how many links each row has. block: which of two each row is in, if pairs between them count
    and not those within."""
    words = np.stack([hi, lo]).view(np.uint64)
    counts = np.zeros(len(rep), np.int64)
    stars: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    bits = masks(parts.bits)

    def settle(part: int) -> None:
        if not waiting:
            return
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        for q in range(part):
            x, y = (words[k, i] ^ words[k, j] for k in range(2))
            fresh = np.bitwise_count(x & bits[q, 0]) + np.bitwise_count(y & bits[q, 1]) > parts.allowed[q]
            i, j = i[fresh], j[fresh]
        if len(i):
            counts[:] += np.bincount(i, minlength=len(rep)) + np.bincount(j, minlength=len(rep))
            stars.append(local(i, j))
            if sum(len(a) for a, _ in stars) > 1 << 20:
                stars[:] = [local(*(np.concatenate(x) for x in zip(*stars)))]

    for part in some:
        key = keys(hi, lo, parts.bits[part])
        wide, allowed = len(parts.bits[part]), parts.allowed[part]
        sides = [np.flatnonzero(block == k) for k in range(2)] if block is not None else [np.arange(len(rep))]
        orders = [own[np.argsort(key[own], kind="stable")] for own in sides]
        a, b = orders[0], orders[-1]
        pairs = [across(words[:, a], key[a], words[:, b], key[b], wide, allowed, radius, own=block is None)]
        if block is None:
            pairs.append(close(hi[a], lo[a], np.searchsorted(key[a], key[a], "right"), radius))
        held = 0
        for i, j in (x for found in pairs for x in found):
            waiting.append((a[i], b[j]))
            held += len(i)
            if held > 1 << 18 or len(waiting) > 1 << 14:
                settle(part)
                held = 0
        settle(part)
    a, b = local(*(np.concatenate(x) for x in zip(*stars))) if stars else (np.zeros(0, np.int64),) * 2
    return rep[a], rep[b], counts


def _compare(parts: Parts, rules: Rules):
    def one(table: pa.Table) -> pa.RecordBatch:
        cell, group = divmod(table.column(0)[0].as_py(), parts.groups)
        rep, hi, lo = (table.column(k).to_numpy() for k in (1, 2, 3))
        block = (_block(rep, parts.blocks) == cell % parts.blocks).astype(np.int64) if cell // parts.blocks != cell % parts.blocks else None
        a, b, counts = linked(rep, hi, lo, block, range(group, len(parts.bits), parts.groups), parts, rules.radius)
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, rep[some]])), pa.concat_arrays([pa.array(b, pa.int64()), none]), pa.array(np.concatenate([np.zeros(len(a), np.int64), counts[some]]))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted by cell
            if batch.num_rows:
                mark = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
                for begin, end in zip(cuts, cuts[1:]):
                    if held and mark[begin] != last:
                        yield one(pa.Table.from_batches(held))
                        held = []
                    last = mark[begin]
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def near(reps: DataFrame, n: int, rules: Rules, parts: Parts | None = None) -> DataFrame:
    """Of n fingerprints (rep, hi, lo; distinct): edges a, b between those within the radius, as stars of each task's
    components, and rows of a and no b with how many links a has in a task."""
    parts = parts or Parts.sized(n, rules)
    tasks = min(parts.blocks**2 * parts.groups, 1 << 15)
    spread = reps.mapInArrow(_spread(parts), _SPREAD)
    return spread.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell").mapInArrow(_compare(parts, rules), "a long, b long, links long")


def _classes(docs: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """All rows' fingerprints (key, doc_id, hi, lo), and those with a near copy or copies: hi, lo, head (doc_id, key), links."""
    prints = kept(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    reps = kept(prints.where("hi is not null").groupBy("hi", "lo").agg(first.alias("first"), (F.count("*") > 1).alias("several")).withColumn("rep", F.monotonically_increasing_id()))
    found = kept(near(reps.select("rep", "hi", "lo"), reps.count(), rules))
    stars = components(found.where("b is not null").select("a", "b"))
    member = stars.select(F.col("a").alias("rep"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("rep"), F.col("b").alias("root")).distinct())
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    near_ = reps.join(member, "rep").join(links, "rep", "left")
    heads = near_.groupBy("root").agg(F.min("first").alias("head"))
    copies = reps.where("several").join(member, "rep", "left_anti").select("hi", "lo", F.col("first").alias("head"), F.lit(0).cast("long").alias("links"))
    return prints, near_.join(heads, "root").select("hi", "lo", "head", "links").unionByName(copies)


def classes(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id; class_id, the same for all documents of a class and no others (a hash of the first's
    doc_id and text); duplicate_of, the first's doc_id (null for the first itself); links, how many other fingerprints lie
    within the radius of its own (0 where there are none or exact copies only); keep, whether it is the first."""
    prints, found = _classes(docs, rules)
    own = prints.join(found, ["hi", "lo"], "left")
    first = F.col("head").isNull() | ((F.col("key") == F.col("head.key")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")))
    own = own.select("key", "doc_id", F.coalesce("head.key", "key").alias("class_id"), F.when(~first, F.col("head.doc_id")).alias("duplicate_of"), F.coalesce("links", F.lit(0)).alias("links"), first.alias("keep"))
    return own.groupBy("key", "doc_id").agg(*(F.first(c).alias(c) for c in ("class_id", "duplicate_of", "links", "keep"))).drop("key")


def duplicates(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Of ``classes`` the documents that aren't their class's first: doc_id, duplicate_of, links."""
    return classes(docs, rules).where("not keep").select("doc_id", "duplicate_of", "links")


def deduplicated(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with one document of each group, and one row of each document."""
    prints, found = _classes(docs, rules)
    prints = prints.where("hi is not null")
    names = docs.columns
    key, doc = (f"{x}_{'_'.join(names)}" for x in ("key", "doc"))  # names that no column has
    gone = prints.join(found, ["hi", "lo"]).where((F.col("key") != F.col("head.key")) | ~F.col("doc_id").eqNullSafe(F.col("head.doc_id")))
    gone = gone.select(F.col("key").alias(f"{key}_"), F.col("doc_id").alias(doc)).distinct()
    some = kept(prints.groupBy("key", "doc_id").count().where("count > 1").select(F.col("key").alias(f"{key}_"), F.col("doc_id").alias(doc)))
    own = docs.withColumn(key, row_key(docs))
    same = (F.col(key) == F.col(f"{key}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    left = own.join(gone, same, "left_anti")
    if some.isEmpty():
        return left.select(names)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    once = left.join(some, same, "left_semi").groupBy(key, F.col("doc_id").alias(doc)).agg(F.min_by(F.struct(*names), F.struct(*plain)).alias("row")).select("row.*")
    return left.join(some, same, "left_anti").select(names).unionByName(once)
