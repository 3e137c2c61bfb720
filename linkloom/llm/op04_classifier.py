"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each document (lengths, shares of character classes, repetition of words and lines) are standardised and
mapped to ``features`` cosines of random projections, whose products approximate a Gaussian kernel. The ridge scores solve
the normal equations, which partitions of the labelled documents sum and Spark adds up; only the sums reach the driver. A
share of the labelled documents, by a hash of doc_id, is held back: on their scores, counted in bins, isotonic regression
gives each score its probability of good quality.

A null or empty text has statistics of zero and is scored as such. Labels of null doc_id or null quality, and labels whose
document is missing, count for nothing; a document with contradicting labels counts once for each, and repeated rows of a
labelled document count each. Without two classes among the labels every score and probability is null and every document
is kept. Repeated rows are scored each. An empty table gives no rows. Extra columns are ignored by ``scored`` and passed
through by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx
from linkloom.llm.storage import kept

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "stop", "symbol", "beyond", "line_length", "short_lines", "distinct_words", "common_word", "symbol_words", "upper_words", "distinct_lines",
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[list(tx.SPACES)], _CLASS[list(b".,;:'\"-()")] = 1, 2, 3, 4
_CLASS[list(b"!#$%&*+/<=>?@[\\]^_`{|}~")] = 5
_CLASS[128:] = 6
_NOT_LINE = tx.table(b"\n", other=True)


_GROUPS, _WIDE = 8, 4096  # of sums; most partitions that make one, half a megabyte each


@dataclass(frozen=True)
class Rules:
    """features: cosines. width: of the Gaussian kernel, in standard deviations. ridge: per labelled document. held: percent
    of the labelled documents held back for calibration. bins: of scores there. floor: least probability that is kept."""

    features: int = 256
    width: float = 3.0
    ridge: float = 1e-3
    held: int = 25
    bins: int = 200
    floor: float = 0.5
    seed: int = 11


def statistics(piece: tx.Slice) -> np.ndarray:
    """The statistics of each document of a slice: documents x STATISTICS."""
    data, offsets = piece.data, piece.offsets
    out = np.zeros((piece.count, len(STATISTICS)))
    if len(data) == 0:
        return out
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    sums = np.zeros((7, len(offsets)))
    kind = _CLASS[data]
    for k in range(1, 7):
        sums[k] = np.append(0, np.cumsum(kind == k))[offsets]
    share = np.diff(sums, axis=1) / some
    begins, ends, words = tx.tokens(data, offsets, tx.NOT_SPACE)
    codes = tx.hashes(tx.LOWER[data], begins, ends)
    lines_at, lines_to, lines = tx.tokens(data, offsets, _NOT_LINE)
    line_codes = tx.hashes(data, lines_at, lines_to)
    n, m = np.diff(words), np.diff(lines)
    first, last = kind[begins], kind[ends - 1]
    by = lambda x, at: np.diff(np.append(0, np.cumsum(x))[at])
    distinct, common = np.zeros(piece.count), np.zeros(piece.count)
    for k in range(piece.count):
        if n[k]:
            own = np.sort(codes[words[k] : words[k + 1]])
            at = tx.runs(own)
            distinct[k] = len(at) / n[k]
            common[k] = np.diff(np.append(at, len(own))).max() / n[k]
    order = np.lexsort((line_codes, np.repeat(np.arange(piece.count), m)))
    fresh = np.ones(len(order), bool)
    fresh[1:] = line_codes[order][1:] != line_codes[order][:-1]
    fresh[lines[:-1][lines[:-1] < len(order)]] = True
    some_words, some_lines = np.maximum(n, 1), np.maximum(m, 1)
    columns = (
        np.log1p(size), np.log1p(n), (size - share[3] * size) / some_words, share[1], share[2], share[3], share[4], share[5], share[6],
        np.log1p(size / some_lines), by(lines_to - lines_at < 40, lines) / some_lines, distinct, common, by(last == 5, words) / some_words, by((first == 1) & (last != 0), words) / some_words, by(fresh, lines) / some_lines,
    )
    return np.stack(columns, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in tx.slices(batch.column(1)):
            found = statistics(piece)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.count), lists], ["doc_id", "stats"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and stats (of STATISTICS) of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    """mean and scale of the statistics; projection, shift and weights of the cosines; bias; edges of scores and their
    probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    chances: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        return np.cos((stats - self.mean) / self.scale @ self.projection + self.shift) * np.sqrt(2 / len(self.shift))

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights[:-1] + self.weights[-1]

    def probability(self, score: np.ndarray) -> np.ndarray:
        return self.chances[np.searchsorted(self.edges, score, "right")]


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rising means nearest to sums / counts (weights: counts), by pooling adjacent violators; empty bins take the mean
    of the one before (the first ones of the one after)."""
    blocks: list[list[float]] = []  # sum, count, bins
    for s, c in zip(sums.tolist(), counts.tolist()):
        if c == 0:
            if blocks:
                blocks[-1][2] += 1
            else:
                blocks.append([0.0, 0, 1])
            continue
        if blocks and blocks[-1][1] == 0:
            blocks[-1] = [s, c, blocks[-1][2] + 1]
        else:
            blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / c if c else np.nan) for s, c, n in blocks])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(STATISTICS)
    total = np.zeros(2 * width + 2)
    for batch in batches:
        x = _matrix(batch.column(0))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), y.sum()]])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "total"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _sums(of) -> np.ndarray:
    """The totals that partitions made, added up by Spark."""
    rows = of.groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").toPandas()
    return rows["total"].to_numpy()


def fit(stats: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Model | None:
    """The model of all labelled documents (``stats`` as of ``measured``); None without two classes."""
    named = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") > 0).cast("double").alias("y"))
    known = kept(stats.join(named, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(100)) < rules.held).alias("held")))
    free = known.where("not held").select("stats", "y")
    total = _sums(free.mapInArrow(_moments, "at int, total double"))
    width = len(STATISTICS)
    if len(total) == 0 or not 0 < total[-1] < total[-2]:
        return None
    n = total[-2]
    mean = total[:width] / n
    scale = np.sqrt(np.maximum(total[width : 2 * width] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    random = np.random.default_rng(rules.seed)
    empty = Model(mean, scale, random.normal(size=(width, rules.features)) / rules.width, random.uniform(0, 2 * np.pi, rules.features), np.zeros(rules.features + 1), np.zeros(0), np.zeros(1))
    side = rules.features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((side, side + 1))
        for batch in batches:
            z = empty.cosines(_matrix(batch.column(0)))
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            gram[:, :-1] += z.T @ z
            gram[:, -1] += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        group = TaskContext.get().partitionId() % _GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([gram.tobytes()], pa.binary())], ["group", "gram"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros(side * (side + 1))
        for batch in batches:
            for x in batch.column(1):
                gram += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([gram.tobytes()], pa.binary())], ["group", "gram"])

    # A sum of each partition, then of each of a few groups of partitions: what reaches the driver doesn't grow.
    few = free.mapInArrow(equations, "group int, gram binary") if free.rdd.getNumPartitions() <= _WIDE else free.coalesce(_WIDE).mapInArrow(equations, "group int, gram binary")
    grams = few.repartition(_GROUPS, "group").mapInArrow(added, "group int, gram binary").collect()
    gram = sum(np.frombuffer(r["gram"]) for r in grams).reshape(side, side + 1)
    penalty = np.eye(side) * rules.ridge * n
    penalty[-1, -1] = 0
    fitted = Model(empty.mean, empty.scale, empty.projection, empty.shift, np.linalg.solve(gram[:, :-1] + penalty, gram[:, -1]), np.zeros(0), np.zeros(1))
    edges = np.linspace(-0.25, 1.25, rules.bins - 1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, rules.bins))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, fitted.score(_matrix(batch.column(0))), "right")
            count += [np.bincount(at, y, rules.bins), np.bincount(at, minlength=rules.bins)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count.size), pa.int32()), pa.array(count.ravel())], ["at", "total"])

    count = _sums(known.where("held").select("stats", "y").mapInArrow(binned, "at int, total double"))
    if len(count) == 0 or count[rules.bins :].sum() == 0:
        count = np.concatenate([np.clip(np.append(edges, edges[-1]), 0, 1), np.ones(rules.bins)])
    chances = isotonic(count[: rules.bins], count[rules.bins :])
    return Model(fitted.mean, fitted.scale, fitted.projection, fitted.shift, fitted.weights, edges, chances)


def _judge(stats: np.ndarray, model: Model | None, rules: Rules) -> tuple[pa.Array, pa.Array, pa.Array]:
    if model is None:
        return pa.nulls(len(stats), pa.float64()), pa.nulls(len(stats), pa.float64()), pa.array(np.ones(len(stats), bool))
    score = model.score(stats)
    chance = model.probability(score)
    return pa.array(score), pa.array(chance), pa.array(chance >= rules.floor)


def scored(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, score (of the ridge regression), probability (calibrated, of good quality), keep."""
    stats = kept(measured(docs))
    model = stats.sparkSession.sparkContext.broadcast(fit(stats, labels, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_judge(_matrix(batch.column(1)), model.value, rules)], ["doc_id", "score", "probability", "keep"])

    return stats.mapInArrow(run, "doc_id long, score double, probability double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(measured(docs), labels, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            keep = [x for piece in tx.slices(column) for x in _judge(statistics(piece), model.value, rules)[2].to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
