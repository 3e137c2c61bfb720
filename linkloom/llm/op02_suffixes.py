"""Repeated passages by a distributed suffix array, and their removal.

A passage is a run of ``min_words`` words (separated by white space, compared byte for byte). Every passage that stands
at two places or more is found, in whole texts. The array holds the suffixes that begin at an anchor: of each passage, the
first of the positions in its first half whose three words have the least hash. Equal passages have equal anchors, so the
array loses no repeat, and it is a twelfth of the full one. Each anchor carries a hash of every passage that chose it. With
``every``, and for passages of under eight words, all suffixes are in the array, each with its own passage.

Splitters are sampled from the suffixes and range-partition them by their leading words; the sample and the ranges are bounded
(``ranges``), and a range is cut evenly between its splitters into the buckets that the size of the table asks for. Each bucket
sorts its suffixes by multikey quicksort and compares the passages of suffixes that agree. A suffix that occurs often may itself
be a splitter and then lie in several ranges, which keeps them even; within a range, those that the sample holds several times
are spread over its buckets. Such runs are compared across the boundaries in a second step.

Of the places of a passage, the one of least doc_id (null last), then least text hash, then position is the original; the
others are repeats. Rows equal in doc_id and text are one document. Rows of equal doc_id but different text are different
documents. A null, empty or short text has no passages. An empty table gives no rows. Extra columns are ignored by
``repeats`` and passed through by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import text as tx
from linkloom.llm.storage import kept, row_key, size, width

_SPLIT = "w0 long, w1 long, w2 long, tie long"
_PACKED = "bucket int, sub int, ids binary, nulls binary, keys binary, docs binary, starts binary, counts binary, hots binary, w0 binary, w1 binary, w2 binary, windows binary"
_FOUND = "key long, doc_id long, original boolean, begin int, end int, window long, places int"


@dataclass(frozen=True)
class Rules:
    """min_words: length of a passage, 2 at least. bucket_mb: text aimed at for a bucket. sample: suffixes sampled for each range.
    ranges: most ranges, and so what the driver sees. every: all suffixes instead of the anchored ones."""

    min_words: int = 50
    bucket_mb: int = 8
    sample: int = 128
    ranges: int = 1 << 13
    every: bool = False
    flush: int = 1 << 23

    def __post_init__(self) -> None:
        if not 2 <= self.min_words < 1 << 20 or self.ranges < 1:
            raise ValueError("a passage has 2 to 1048575 words, and there is one range at least")

    @property
    def reach(self) -> int:  # an anchor is one of the first so many words of its passage
        return 1 if self.every or self.min_words < 8 else self.min_words // 2


@dataclass
class Suffixes:
    """Anchors in order: doc (index in the slice), start (of its first passage, in words of the document), count of passages,
    three words of key (two leading tokens, two more, a fingerprint up to where every passage of the anchor reaches); and
    the passages' hashes, of all anchors in order."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    words: np.ndarray
    windows: np.ndarray


def _spans(sums: np.ndarray, downs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return tx.mix((sums[at + n] - sums[at]) * downs[at])


def _least(order: np.ndarray, size: int) -> np.ndarray:
    """Of each window of ``size`` entries, where its first least one is."""
    found = []
    for begin in range(0, len(order) - size + 1, 1 << 22):
        part = order[begin : begin + (1 << 22) + size - 1]
        low = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < size:
            step = min(have, size - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        found.append((low & np.uint64(0xFFFFFF)).astype(np.int64) + begin)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def suffixes(piece: tx.Slice, rules: Rules) -> Suffixes:
    """The anchored suffixes of a slice of documents."""
    size, reach = rules.min_words, rules.reach
    begins, ends, where = tx.tokens(piece.data, piece.offsets, tx.NOT_SPACE)
    n = len(begins)
    doc = np.repeat(np.arange(piece.count), np.diff(where))
    starts = np.flatnonzero(np.arange(n) + size <= where[1:][doc]) if n else np.zeros(0, np.int64)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return Suffixes(none, none, none, np.zeros((3, 0), np.uint64), np.zeros(0, np.uint64))
    hashed = tx.hashes(piece.data, begins, ends)
    ups, downs = tx.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashed * ups[:n], out=sums[1:])
    half = np.uint64(32)
    top = np.append(hashed >> half, np.zeros(3, np.uint64))
    if reach == 1:
        passages = _spans(sums, downs, starts, size)
        lead = [np.where(k < size, top[starts + k], np.uint64(0)) for k in range(4)]
        return Suffixes(doc[starts], starts - where[doc[starts]], np.ones(len(starts), np.int64), np.stack([(lead[0] << half) | lead[1], (lead[2] << half) | lead[3], passages]), passages)
    order = tx.mix(hashed[:-2] + hashed[1:-1] * np.uint64(0x9FB21C651E98DF25) + hashed[2:] * np.uint64(0xD1B54A32D192ED03))
    anchor = _least(order, reach)[starts]
    first = tx.runs(anchor)
    at = anchor[first]
    words = np.stack([(top[at] << half) | top[at + 1], (top[at + 2] << half) | top[at + 3], _spans(sums, downs, at + 4, size - reach + 1 - 4)])
    owner = doc[at]
    return Suffixes(owner, starts[first] - where[owner], np.diff(np.append(first, len(starts))), words, _spans(sums, downs, starts, size))


def multikey(words: np.ndarray) -> np.ndarray:
    """Multikey quicksort of the columns of ``words`` (keys x suffixes), of all segments at once: each segment is split in
    three by a pivot of its current key, and the equal part goes on to the next key. Short segments are sorted directly."""
    depth_end, n = words.shape
    order = np.arange(n)
    begin, end, depth = np.array([0]), np.array([n]), np.array([0])
    small: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        size = end - begin
        tiny = (size > 1) & (size <= 48)
        if tiny.any():
            small.append((begin[tiny], end[tiny]))
        busy = size > 48
        begin, end, depth, size = begin[busy], end[busy], depth[busy], size[busy]
        if len(begin) == 0:
            break
        segment = np.repeat(np.arange(len(begin)), size)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = begin[segment] + offset
        item = order[place]
        key = words[depth[segment], item]
        three = np.stack([words[depth, order[begin]], words[depth, order[begin + size // 2]], words[depth, order[end - 1]]])
        pivot = np.sort(three, axis=0)[1]
        side = (key > pivot[segment]).astype(np.int64) - (key < pivot[segment]) + 1
        slot = segment * 3 + side
        counts = np.bincount(slot, minlength=3 * len(begin))
        firsts = np.repeat(begin, 3) + (np.cumsum(counts.reshape(-1, 3), axis=1) - counts.reshape(-1, 3)).ravel()
        target = np.empty(len(item), np.int64)
        for s in range(3):
            own = side == s
            rank = np.cumsum(own) - own
            base = rank[np.cumsum(size) - size]
            target[own] = firsts[slot[own]] + (rank[own] - base[segment[own]])
        order[target] = item
        depth = np.repeat(depth, 3)
        depth[1::3] += 1
        begin, end = firsts, firsts + counts
        done = depth >= depth_end
        begin, end, depth = begin[~done], end[~done], depth[~done]
    if small:
        begin, end = (np.concatenate([x[k] for x in small]) for k in range(2))
        size = end - begin
        segment = np.repeat(np.arange(len(begin)), size)
        place = begin[segment] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        item = order[place]
        again = np.lexsort((*(words[k, item] for k in reversed(range(depth_end))), segment))
        order[place] = item[again]
    return order


def _tie(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return tx.mix(keys.view(np.uint64) ^ (starts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def bucket(words: np.ndarray, tie: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many splitters (4 x splitters, in order) are at or before each suffix, and whether its three keys are those of
    a splitter, so that equal ones may lie in other buckets."""
    at = np.searchsorted(splits[0], words[0], "left")
    last = np.searchsorted(splits[0], words[0], "right")
    hot = np.zeros(len(at), bool)
    rows = np.flatnonzero(last > at)
    begin = at.copy()
    k = 0
    while len(rows):
        own = begin[rows] + k
        before, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for d, col in enumerate((words[1][rows], words[2][rows], tie[rows])):
            if d == 2:
                hot[rows] |= same
            split = splits[d + 1][own]
            before |= same & (split < col)
            same &= split == col
        at[rows] += before | same
        k += 1
        rows = rows[begin[rows] + k < last[rows]]
    return at, hot


def _code(words: np.ndarray) -> np.ndarray:
    """One number for the three keys of each suffix."""
    return tx.mix(words[0] + tx.mix(words[1] + tx.mix(words[2])))


def _within(words: np.ndarray, at: np.ndarray, splits: np.ndarray, subs: int) -> np.ndarray:
    """Which of ``subs`` even parts of its range each suffix lies in, by its first key; keys are hashes, so they lie evenly."""
    lows = np.append(np.uint64(0), splits[0]).astype(np.float64)
    highs = np.append(splits[0], np.uint64((1 << 64) - 1)).astype(np.float64)
    low, size = lows[at], np.maximum(highs[at] - lows[at], 1.0)
    return np.clip(((words[0].astype(np.float64) - low) / size * subs).astype(np.int64), 0, subs - 1).astype(np.int32)


def _pack(held: list, splits: np.ndarray, often: np.ndarray, subs: int) -> Iterator[pa.RecordBatch]:
    """Rows by bucket of what was collected: (ids, nulls, keys, suffixes) of slices. often: the codes of suffixes that are
    spread over the parts of a range."""
    base = np.cumsum([0, *(len(x[0]) for x in held)])
    ids, nulls, keys = (np.concatenate([x[k] for x in held]) for k in range(3))
    doc = np.concatenate([x[3].doc + b for x, b in zip(held, base)])
    start, count = (np.concatenate([getattr(x[3], k) for x in held]) for k in ("start", "count"))
    words = np.concatenate([x[3].words for x in held], axis=1)
    windows = np.concatenate([x[3].windows for x in held])
    if len(doc) == 0:
        return
    tie = _tie(keys[doc], start)
    to, hot = bucket(words, tie, splits)
    to = to.astype(np.int64)
    if subs > 1:
        part = _within(words, to, splits, subs)
        spread = np.isin(_code(words), often)
        part[spread] = tx.mix(tie[spread]) % np.uint64(subs)
        to, hot = to * subs + part, hot | spread
    flags = hot.astype(np.uint8)
    order = np.argsort(to, kind="stable")
    windows = windows[tx.ragged((np.cumsum(count) - count)[order], count[order])]
    to, doc, start, count, flags, words = to[order], doc[order], start[order], count[order], flags[order], words[:, order]
    seen = np.cumsum(np.append(0, count))
    firsts = tx.runs(to)
    rows: list[list] = [[] for _ in range(13)]
    for a, b in zip(firsts, np.append(firsts[1:], len(to))):
        used, local = np.unique(doc[a:b], return_inverse=True)
        own = (ids[used], nulls[used], keys[used], local.astype(np.int32), start[a:b].astype(np.int32), count[a:b].astype(np.int32), flags[a:b], words[0, a:b], words[1, a:b], words[2, a:b], windows[seen[a] : seen[b]])
        rows[0].append(int(to[a]) // subs)
        rows[1].append(int(to[a]) % subs)
        for k, x in enumerate(own):
            rows[k + 2].append(x.tobytes())
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in rows[:2]), *(pa.array(x, pa.binary()) for x in rows[2:])], [x.split()[0] for x in _PACKED.split(", ")])


def _emit(cuts, subs: int, rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            nulls = np.asarray(pc.is_null(batch.column(1))).astype(np.uint8)
            ids = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in tx.slices(batch.column(2)):
                own = slice(piece.first, piece.first + piece.count)
                held.append((ids[own], nulls[own], keys[own], suffixes(piece, rules)))
                size += len(piece.data)
                if size >= rules.flush:
                    yield from _pack(held, *cuts.value, subs)
                    held, size = [], 0
        if held:
            yield from _pack(held, *cuts.value, subs)

    return run


def _sample(rules: Rules, share: float):
    most = np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in tx.slices(batch.column(2)):
                found = suffixes(piece, rules)
                tie = _tie(keys[piece.first + found.doc], found.start)
                some = tie <= most
                yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (*found.words, tie)], ["w0", "w1", "w2", "tie"])

    return run


def splitters(keyed: DataFrame, ranges: int, size: int, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the suffixes of a table of ``size`` bytes into ``ranges`` about even ranges, from a sample of about
    ``rules.sample`` suffixes for each; and the codes of those that the sample holds three times or more. They decide where
    suffixes are compared, never what is found."""
    if ranges <= 1:
        return np.zeros((4, 0), np.uint64), np.zeros(0, np.uint64)
    share = min(1.0, rules.sample * ranges / max(1.0, 2 * size / (72 if rules.reach > 1 else 6)))  # a word is about six bytes, files are packed to half
    some = min(1.0, 16 * share)  # of the documents, of whose suffixes the rest
    rows = keyed.sample(some, seed=5).mapInArrow(_sample(rules, share / some), _SPLIT).toPandas()
    found = np.stack([rows[k].to_numpy(np.int64).view(np.uint64) for k in ("w0", "w1", "w2", "tie")]) if len(rows) else np.zeros((4, 0), np.uint64)
    found = found[:, np.lexsort(found[::-1])]
    codes, times = np.unique(_code(found[:3]), return_counts=True)
    often = codes[times > 2]
    if found.shape[1] < ranges:
        return found[:, :0], often
    return found[:, (np.arange(1, ranges) * found.shape[1]) // ranges], often


def _islands(rank: np.ndarray, start: np.ndarray, original: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of passages one word apart, as (rank, original, begin, end)."""
    order = np.lexsort((start, original, rank))
    rank, start, original = rank[order], start[order], original[order]
    fresh = np.ones(len(rank), bool)
    fresh[1:] = (rank[1:] != rank[:-1]) | (original[1:] != original[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(rank)) - 1 if len(first) else first
    return rank[first], original[first], start[first], start[last] + size


def _compare(rules: Rules):
    kinds = (np.int64, np.uint8, np.int64, np.int32, np.int32, np.int32, np.uint8, np.uint64, np.uint64, np.uint64, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in kinds]
        base, last = 0, None
        for batch in batches:  # one range, sorted by part
            for r, sub in enumerate(batch.column(1).to_pylist()):
                if base and sub != last:
                    yield from compared(cols)
                    cols, base = [[] for _ in kinds], 0
                last = sub
                row = [np.frombuffer(batch.column(k + 2)[r].as_buffer(), kind) for k, kind in enumerate(kinds)]
                for k, x in enumerate(row):
                    cols[k].append(x + np.int32(base) if k == 3 else x.copy())
                base += len(row[0])
        if base:
            yield from compared(cols)

    def compared(cols: list[list]) -> Iterator[pa.RecordBatch]:
        ids, nulls, keys, doc, start, count, flags, w0, w1, w2, windows = (np.concatenate(x) for x in cols)
        cols.clear()
        words = np.stack([w0, w1, w2])
        del w0, w1, w2
        order = multikey(words)
        words = words[:, order]
        same = (words[:, 1:] == words[:, :-1]).all(axis=0) if len(order) > 1 else np.zeros(0, bool)
        shared = np.zeros(len(order), bool)
        shared[1:] |= same
        shared[:-1] |= same
        hot = flags[order] > 0
        take = order[shared | hot]
        hot = hot[shared | hot]
        del words, same, shared
        count = count.astype(np.int64)
        first = np.cumsum(count) - count
        size = count[take]
        window = windows[tx.ragged(first[take], size)]
        del windows
        # Documents by rank: doc_id with null last, then key. Copies of a row share a rank.
        by = np.lexsort((keys, ids, nulls))
        step = np.ones(len(by), bool)
        step[1:] = (keys[by][1:] != keys[by][:-1]) | (ids[by][1:] != ids[by][:-1]) | (nulls[by][1:] != nulls[by][:-1])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(step) - 1
        named = by[step]
        at = (np.repeat(rank[doc[take]], size) << 32) | (np.repeat(start[take].astype(np.int64), size) + tx.ragged(np.zeros(len(size), np.int64), size))
        hot = np.repeat(hot, size)
        order = np.lexsort((at, window))
        window, at, hot = window[order], at[order], hot[order]
        fresh = np.ones(len(window), bool)
        fresh[1:] = (window[1:] != window[:-1]) | (at[1:] != at[:-1])
        window, at, hot = window[fresh], at[fresh], hot[fresh]
        begins = tx.runs(window)
        sizes = np.diff(np.append(begins, len(window)))
        lead = np.zeros(len(window), bool)
        lead[begins] = True
        several = np.repeat(sizes > 1, sizes)
        closed = several & ~(lead & hot)  # whether the first place of a hot passage is the first of all is settled later
        who, original, begin, end = _islands(at[closed] >> 32, at[closed] & 0xFFFFFFFF, lead[closed], rules.min_words)
        open_ = np.flatnonzero(lead & hot)
        who = np.concatenate([who, at[open_] >> 32])
        begin = np.concatenate([begin, at[open_] & 0xFFFFFFFF])
        n = len(end)
        end = np.concatenate([end, begin[n:] + rules.min_words])
        original = np.concatenate([original, np.ones(len(open_), bool)])
        left = np.arange(len(who)) >= n
        spread = np.concatenate([np.zeros(n, np.int64), np.repeat(sizes, sizes)[open_]])
        code = np.concatenate([np.zeros(n, np.uint64), window[open_]]).view(np.int64)
        at = named[who]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[at]), pa.array(ids[at], mask=nulls[at] > 0), pa.array(original), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(code, mask=~left), pa.array(spread, pa.int32())],
            [x.split()[0] for x in _FOUND.split(", ")],
        )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """key (of doc_id and text together), doc_id, text."""
    return docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _repeats(docs: DataFrame, rules: Rules) -> DataFrame:
    spark = docs.sparkSession
    texts = keyed(docs)
    buckets = width(docs, rules.bucket_mb)
    ranges = min(buckets, rules.ranges)
    subs = -(-buckets // ranges)
    cuts = spark.sparkContext.broadcast(splitters(texts, ranges, size(docs), rules))
    packed = texts.mapInArrow(_emit(cuts, subs, rules), _PACKED).repartitionById(ranges, F.col("bucket"))
    found = kept((packed.sortWithinPartitions("sub") if subs > 1 else packed).mapInArrow(_compare(rules), _FOUND))
    first = Window.partitionBy("window").orderBy(F.col("doc_id").asc_nulls_last(), "key", "begin")
    crossing = (
        found.where("window is not null")
        .withColumn("turn", F.row_number().over(first))
        .withColumn("everywhere", F.sum("places").over(Window.partitionBy("window")))
        .where("everywhere > 1")
        .select("key", "doc_id", (F.col("turn") == 1).alias("original"), "begin", "end")
    )
    spans = found.where("window is null").select("key", "doc_id", "original", "begin", "end").unionByName(crossing).repartition("key")
    same = Window.partitionBy("key", "doc_id", "original").orderBy("begin", "end")
    reach = F.max("end").over(same.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("fresh", F.when(F.col("begin") < reach, 0).otherwise(1))
        .withColumn("island", F.sum("fresh").over(same))
        .groupBy("key", "doc_id", "original", "island")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .drop("island")
    )


def repeats(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per maximal run of repeated passages: doc_id, begin_word, end_word (exclusive, counted from 0), words, and
    original: whether these are the first places of their passages."""
    found = _repeats(docs, rules)
    return found.select("doc_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("begin")).alias("words"), "original")


def _cut(text: str, begins: list[int], ends: list[int]) -> str:
    """``text`` without the words begins[k]..ends[k]-1 and the white space after them."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    at, _, _ = tx.tokens(data, np.array([0, len(data)]), tx.NOT_SPACE)
    at = np.append(at, len(raw))
    out, done = [], 0
    for a, b in zip(begins, ends):
        out.append(raw[done : at[a]])
        done = int(at[b])
    out.append(raw[done:])
    return b"".join(out).decode()


def deduplicated(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` without the repeats: of each passage the original stays. n_chars, if there, follows the text. Documents of
    which no word is left go."""
    names = docs.columns
    key, doc, spans = (f"{x}_{'_'.join(names)}" for x in ("key", "doc", "spans"))
    gone = (
        _repeats(docs, rules).where("not original").groupBy("key", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(spans))
        .withColumnsRenamed({"key": key, "doc_id": doc})
    )
    own = docs.select("*", row_key(docs).alias(f"{key}_own"))
    joined = own.join(gone, (F.col(f"{key}_own") == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").select(*names, spans)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(len(names))
            if where.null_count < len(where):
                touched = np.flatnonzero(np.asarray(pc.is_valid(where)))
                at = {name: k for k, name in enumerate(names)}
                texts = batch.column(at["text"]).to_pylist()
                columns = batch.columns[: len(names)]
                keep = np.ones(len(texts), bool)
                for r in touched:
                    parts = where[int(r)].as_py()
                    texts[r] = _cut(texts[r], [p["begin"] for p in parts], [p["end"] for p in parts])
                    keep[r] = bool(texts[r].strip())
                columns[at["text"]] = pa.array(texts, columns[at["text"]].type)
                if "n_chars" in at:
                    sizes = columns[at["n_chars"]].to_pylist()
                    for r in touched:
                        sizes[r] = len(texts[r])
                    columns[at["n_chars"]] = pa.array(sizes, columns[at["n_chars"]].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))
            else:
                yield batch.select(list(range(len(names))))

    return joined.mapInArrow(run, schema)


def sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL for the rows of ``repeats`` over ``documents`` (of distinct doc_id): all passages, grouped."""
    n = rules.min_words
    return rf"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, s, md5(array_to_string(ws[s + 1 : s + {n}], ' ')) as h from w, unnest(range(0, len(ws) - {n} + 1)) as t(s)),
r as (select doc_id, s, row_number() over (partition by h order by doc_id, s) = 1 as original, count(*) over (partition by h) as n from g),
f as (select doc_id, s, original, case when s < max(s + {n}) over (partition by doc_id, original order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from r where n > 1),
i as (select doc_id, s, original, sum(fresh) over (partition by doc_id, original order by s) as island from f)
select doc_id, cast(min(s) as integer) as begin_word, cast(max(s) + {n} as integer) as end_word, cast(max(s) + {n} - min(s) as integer) as words, original from i group by doc_id, original, island
"""
