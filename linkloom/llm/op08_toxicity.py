"""Toxic spans by a linear-chain conditional random field, and documents scored by what it tags.

Words (runs of letters and digits, case folded) are observed by features: the word itself, its beginnings and endings of a few
bytes, its shape (length, digits, capital, letters beyond ASCII), and the words before and after it; features of too few
labelled documents are left out. Labels are given to documents, so labelled tokens are made from them: in a document labelled
toxic, the words that are, or begin as, what is significantly more frequent among toxic documents are toxic; all other words of
labelled documents aren't. The same word is thus labelled either way, and what surrounds it counts.

The chain of two states is trained by maximum likelihood with a ridge: the labelled sample lies as arrays of word types in
partitions, each round sums the partitions' gradients under the weights sent to them, and the driver takes a step of a limited-
memory quasi-Newton method over these sums alone.

The forward-backward marginals of a document's words are summed: toxic documents have them at a higher rate per word than
others. Two Poisson rates, over the labelled documents, and the labels' proportion turn sum and length into the document's
score, the probability of being toxic. A long document's score is at least that of its most toxic stretch of ``stretch`` words,
discounted by how many stretches it has. Offending spans are maximal runs of words whose marginal is above a half.

The model is fitted on at most ``sample`` labelled documents, by a hash of doc_id; everything else is over all documents
and whole texts. A null or empty text has score of no words and no spans. Labels of null doc_id or null toxic count for
nothing; contradicting labels count each; of the rows of a labelled doc_id one counts, that of least hash of the text. Without labels of both kinds every
score is null and no document is toxic. Repeated rows are scored each. An empty table gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx
from linkloom.llm.storage import kept

_SCORED = "doc_id long, score double, toxic boolean, toxic_words double, words int, spans array<struct<begin:int,end:int>>"
_BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
_ENDINGS = (3, 4)
_EVIDENCE = 1 + len(_BEGINNINGS)  # the kinds of features, of the word itself, that labels are made from
_BEFORE, _AFTER = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_BLOCK = 64


@dataclass(frozen=True)
class Rules:
    """sample: most labelled documents that the model is fitted on (a third at most are toxic ones). significance: least G² of
    evidence. documents: least documents that have a feature, or toxic ones that have evidence. rounds: of training. ridge: weight
    of the squared weights. floor: score of toxic documents. stretch: words of a stretch."""

    sample: int = 3000
    significance: float = 20.0
    documents: int = 4
    rounds: int = 18
    ridge: float = 1.0
    floor: float = 0.7
    stretch: int = 512


@dataclass(frozen=True)
class Model:
    """codes, weights: of the features, in order of code. rest: bias, log transitions from state to state, log weight of a toxic
    first word. rates: toxic words per word in toxic and in other documents. prior: log-odds of the labels."""

    codes: np.ndarray
    weights: np.ndarray
    rest: np.ndarray
    rates: tuple[float, float]
    prior: float


class Words(NamedTuple):
    """The words of a slice: begins, ends, how many lie before each text, which are first of a text, the type of each; and the
    codes of the features of each type (kinds x types, 0 where it has none), the last two as a neighbour before and after."""

    begins: np.ndarray
    ends: np.ndarray
    where: np.ndarray
    first: np.ndarray
    type: np.ndarray
    codes: np.ndarray


def words(piece: tx.Slice) -> Words:
    data = tx.fold(piece.data)
    begins, ends, where = tx.tokens(data, piece.offsets, tx.WORD)
    first = np.zeros(len(begins), bool)
    first[where[:-1][where[:-1] < where[1:]]] = True
    sums = tx.sums(data)
    hashed = tx.spans(sums, begins, ends)
    changed = data != piece.data
    capital = changed[begins] | (np.append(changed, False)[begins + 1] & (piece.data[begins] == 0xC3)) if len(begins) else np.zeros(0, bool)
    _, at, kind = np.unique(hashed ^ capital.astype(np.uint64), return_index=True, return_inverse=True)
    a, b, capital = begins[at], ends[at], capital[at]
    own = [hashed[at]]
    for size in (*_BEGINNINGS, *(-x for x in _ENDINGS)):
        long = np.flatnonzero(b - a > abs(size))
        code = np.zeros(len(a), np.uint64)
        code[long] = (tx.spans(sums, a[long], a[long] + size) if size > 0 else tx.spans(sums, b[long] + size, b[long])) ^ np.uint64(size if size > 0 else 16 - size)
        own.append(code)
    marks = np.append(0, np.cumsum((data >= 48) & (data < 58)))
    wide = np.append(0, np.cumsum(data >= 128))
    own.append(tx.mix(np.minimum(b - a, 12).astype(np.uint64) * np.uint64(8) + (marks[b] > marks[a]) * np.uint64(4) + (wide[b] > wide[a]) * np.uint64(2) + capital.astype(np.uint64) + np.uint64(1)))
    return Words(begins, ends, where, first, kind.astype(np.int32), np.stack([*own, tx.mix(own[0] ^ _BEFORE), tx.mix(own[0] ^ _AFTER)]))


def places(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each code lies in ``known`` (in order); len(known) if it doesn't."""
    if len(known) == 0:
        return np.zeros(codes.shape, np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, at, len(known))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By code: whether it may be evidence, how many toxic and other documents have it."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for piece in tx.slices(batch.column(0)):
            own = words(piece)
            doc = np.repeat(np.arange(piece.count), np.diff(own.where))
            pair = np.unique(doc * len(own.codes[0]) + own.type) if len(doc) else doc
            for k, codes in enumerate(own.codes[:-2]):
                doc, code = pair // max(len(codes), 1), codes[pair % max(len(codes), 1)]
                doc, code = doc[code != 0], code[code != 0]
                order = np.lexsort((doc, code))
                doc, code = doc[order], code[order]
                fresh = np.ones(len(code), bool)
                fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                bad, code = toxic[piece.first + doc[fresh]], code[fresh]
                at = tx.runs(code)
                t = np.add.reduceat(bad, at, dtype=np.int64) if len(at) else at
                n = np.diff(np.append(at, len(code)))
                yield pa.RecordBatch.from_arrays([pa.array(code[at].view(np.int64)), pa.array(np.full(len(at), k == 0)), pa.array(np.full(len(at), k < _EVIDENCE)), pa.array(t), pa.array(n - t)], ["code", "word", "evidence", "t", "c"])


def _significant(t, c, n1: int, n0: int, rules: Rules):
    """Whether a code of t toxic and c other documents is evidence (columns)."""
    share = n1 / (n1 + n0)
    g = 2 * (F.when(t > 0, t * F.log(t / ((t + c) * share))).otherwise(0.0) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    more = (t + 0.5) / (n1 + 1) > (c + 0.5) / (n0 + 1)
    return F.coalesce((g >= rules.significance) & (t >= rules.documents) & more, F.lit(False))


def chain(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward messages (words x 2 states, each normalised) of all documents of a slice, and the log of the sum
    over all taggings. ``scores``: log weight of the toxic state of each word. A document's first word forgets what was before:
    its step has two equal rows.

    Words are cut in blocks; the steps of all blocks are multiplied side by side, the products are chained, and then the
    messages within all blocks are found side by side."""
    n = len(scores)
    blocks = -(-n // _BLOCK)
    heavy = np.exp(np.clip(np.append(scores, np.zeros(blocks * _BLOCK - n)), -50, 50)).reshape(blocks, _BLOCK)
    fresh = np.append(first, np.ones(blocks * _BLOCK - n, bool)).reshape(blocks, _BLOCK)  # nothing comes back from the padding
    m = np.exp(moves)
    # steps[i][j]: from state i before to state j at the word
    steps = [[np.where(fresh, 1.0, m[i, 0]), np.where(fresh, np.exp(start), m[i, 1]) * heavy] for i in range(2)]
    size = steps[0][0] + steps[0][1] + steps[1][0] + steps[1][1]
    steps = [[x / size for x in row] for row in steps]
    product = [[np.ones(blocks), np.zeros(blocks)], [np.zeros(blocks), np.ones(blocks)]]
    for k in range(_BLOCK):
        s = [[steps[i][j][:, k] for j in range(2)] for i in range(2)]
        product = [[product[i][0] * s[0][j] + product[i][1] * s[1][j] for j in range(2)] for i in range(2)]
        total = product[0][0] + product[0][1] + product[1][0] + product[1][1]
        product = [[x / total for x in row] for row in product]
    p = [[x.tolist() for x in row] for row in product]
    heads, tails = np.empty((blocks, 2)), np.empty((blocks, 2))
    a, b = 0.5, 0.5
    for k in range(blocks):
        heads[k] = a, b
        a, b = a * p[0][0][k] + b * p[1][0][k], a * p[0][1][k] + b * p[1][1][k]
        a, b = a / (a + b), b / (a + b)
    a, b = 0.5, 0.5
    for k in reversed(range(blocks)):
        tails[k] = a, b
        a, b = p[0][0][k] * a + p[0][1][k] * b, p[1][0][k] * a + p[1][1][k] * b
        a, b = a / (a + b), b / (a + b)
    ahead, back, scale = np.empty((blocks, _BLOCK, 2)), np.empty((blocks, _BLOCK, 2)), size
    a, b = heads[:, 0], heads[:, 1]
    for k in range(_BLOCK):
        a, b = a * steps[0][0][:, k] + b * steps[1][0][:, k], a * steps[0][1][:, k] + b * steps[1][1][:, k]
        total = a + b
        scale[:, k] *= total
        a, b = a / total, b / total
        ahead[:, k, 0], ahead[:, k, 1] = a, b
    a, b = tails[:, 0], tails[:, 1]
    for k in reversed(range(_BLOCK)):
        back[:, k, 0], back[:, k, 1] = a, b
        a, b = steps[0][0][:, k] * a + steps[0][1][:, k] * b, steps[1][0][:, k] * a + steps[1][1][:, k] * b
        total = a + b
        a, b = a / total, b / total
    return ahead.reshape(-1, 2)[:n], back.reshape(-1, 2)[:n], float(np.log(scale.ravel()[:n]).sum())


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """The probability that each word is toxic."""
    if len(scores) == 0:
        return np.zeros(0)
    ahead, back, _ = chain(scores, first, moves, start)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1)


class Part(NamedTuple):
    """Words of a slice for training: which are first of a text, type, label, side (their document's label); and the features of
    each type: which type, which kind (0 its own, 1 as the word before, 2 as the word after), which weight."""

    first: np.ndarray
    type: np.ndarray
    label: np.ndarray
    side: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    weight: np.ndarray

    @property
    def types(self) -> int:
        return int(self.owner.max(initial=-1)) + 1


_PART = (np.bool_, np.int32, np.bool_, np.bool_, np.int32, np.int8, np.int32)


def part(piece: tx.Slice, toxic: np.ndarray, known: np.ndarray, evidence: np.ndarray) -> Part:
    own = words(piece)
    side = np.repeat(toxic, np.diff(own.where))
    bad = (places(own.codes[:_EVIDENCE], evidence) < len(evidence)).any(axis=0) if len(evidence) else np.zeros(own.codes.shape[1], bool)
    at = places(own.codes, known)
    kind, owner = np.nonzero(at < len(known))
    last = len(own.codes) - 1
    weight = at[kind, owner]
    if own.codes.shape[1] == 0:
        return Part(own.first, own.type, np.zeros(0, bool), side, *(np.zeros(0, x) for x in _PART[4:]))
    # One more of no weight, for the last type to be there.
    return Part(own.first, own.type, side & bad[own.type], side, np.append(owner, own.codes.shape[1] - 1).astype(np.int32), np.append(np.where(kind == last, 2, np.where(kind == last - 1, 1, 0)), 0).astype(np.int8), np.append(weight, len(known)).astype(np.int32))


def scores(own: Part, w: np.ndarray) -> np.ndarray:
    """The log weight of each word's toxic state, without the bias."""
    by_kind = [np.bincount(own.owner[own.kind == k], w[own.weight[own.kind == k]], own.types) for k in range(3)]
    return _around(own.type, own.first, *by_kind)


def _around(kind: np.ndarray, first: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    out = own[kind].astype(float)
    out[1:] += np.where(first[1:], 0.0, before[kind[:-1]])
    out[:-1] += np.where(first[1:], 0.0, after[kind[1:]])
    return out


def likelihood(own: Part, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The log-likelihood of the labels, and its gradient. w: the weights of the features (the last is of none, and 0), then
    bias, transitions (row by row), first."""
    n = len(own.first)
    features, (bias, *moves, start) = w[:-6], w[-6:]
    if n == 0:
        return 0.0, np.zeros(len(w))
    moves = np.array(moves).reshape(2, 2)
    s = scores(own, features) + bias
    ahead, back, total = chain(s, own.first, moves, start)
    both = ahead * back
    p = both[:, 1] / both.sum(axis=1)
    y = own.label.astype(np.int64)
    at = np.flatnonzero(~own.first)
    at = at[at > 0]
    flow = ahead[at - 1][:, :, None] * np.exp(moves)[None] * (back[at] * np.stack([np.ones(len(at)), np.exp(np.clip(s[at], -50, 50))], axis=1))[:, None, :]
    flow /= flow.sum(axis=(1, 2), keepdims=True)
    seen = np.bincount(2 * y[at - 1] + y[at], minlength=4)
    value = float((s * y).sum() + (seen * moves.ravel()).sum() + start * y[own.first].sum()) - total
    r = y - p
    inner = ~own.first[1:]
    sums = (np.bincount(own.type, r, own.types), np.bincount(own.type[:-1][inner], r[1:][inner], own.types), np.bincount(own.type[1:][inner], r[:-1][inner], own.types))
    gradient = np.zeros(len(w))
    gradient[:-6] = np.bincount(own.weight, np.choose(own.kind, [x[own.owner] for x in sums]), len(w) - 6)
    gradient[len(w) - 7] = 0.0
    gradient[-6:] = [r.sum(), *(seen - flow.sum(axis=0).ravel()), r[own.first].sum()]
    return value, gradient


def maximise(of: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, ridge: float, memory: int = 6) -> np.ndarray:
    """The best weights that a limited-memory quasi-Newton ascent meets in so many calls of ``of`` (value and gradient)."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = of(w)
        return value - ridge / 2 * float(w @ w), gradient - ridge * w

    value, g = at(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    length = 1.0 / max(1.0, float(np.abs(g).max()))
    for _ in range(rounds - 1):
        d, left = g.copy(), []
        for s, y in reversed(steps):
            a = float(s @ d) / float(s @ y)
            d -= a * y
            left.append(a)
        if steps:
            s, y = steps[-1]
            d *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(steps, reversed(left)):
            d += (a - float(y @ d) / float(s @ y)) * s
        fresh = w + (d if steps else g) * length
        better, h = at(fresh)
        if better <= value:
            length *= 0.25
            if length < 1e-8:
                break
            continue
        s, y = fresh - w, g - h
        if float(s @ y) > 1e-10:
            steps = [*steps, (s, y)][-memory:]
        w, value, g, length = fresh, better, h, 1.0
    return w


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Model | None:
    """The model of a bounded sample of the labelled documents; None without labels of both kinds."""
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).alias("y"))
    some = lambda toxic, n: known.where(F.col("y") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = some(True, rules.sample // 3).unionByName(some(False, rules.sample - rules.sample // 3))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most are broadcast
    found = found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # however many rows share a doc_id
    # Hashed to a fixed number of partitions: a sum depends on the order. The sample is bounded, and each sends its sums to the driver.
    sample = kept(found.select("text", "y").repartition(8, F.xxhash64("doc_id", "text", "y")))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    codes = sample.mapInArrow(_frequencies, "code long, word boolean, evidence boolean, t long, c long").groupBy("code", "word", "evidence").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t"), F.col("c")
    codes = codes.where(t + c >= rules.documents).withColumn("evidence", F.col("evidence") & _significant(t, c, sizes[True], sizes[False], rules))
    rows = codes.select("code", "word", "evidence").toPandas()  # of a bounded sample, what several of its documents have
    names = rows["code"].to_numpy(np.int64).view(np.uint64)
    own = names[rows["word"].to_numpy(bool)]
    vocabulary = np.unique(np.concatenate([names, tx.mix(own ^ _BEFORE), tx.mix(own ^ _AFTER)]))
    evidence = np.unique(names[rows["evidence"].to_numpy(bool)])
    shared = context.broadcast((vocabulary, evidence))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for piece in tx.slices(batch.column(0)):
                own = part(piece, toxic[piece.first : piece.first + piece.count], *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in own], list(Part._fields))

    parts = kept(sample.mapInArrow(cut, ", ".join(f"{x} binary" for x in Part._fields)))
    size = len(vocabulary) + 1 + 6

    def summed(job: Callable[[Part, np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, width: int) -> tuple[float, np.ndarray]:
        sent = context.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, total = 0.0, np.zeros(width)
            for batch in batches:
                for r in range(batch.num_rows):
                    more, vector = job(Part(*(np.frombuffer(batch.column(k)[r].as_buffer(), kind) for k, kind in enumerate(_PART))), sent.value)
                    value, total = value + more, total + vector
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["value", "total"])

        found = parts.mapInArrow(run, "value double, total binary").collect()  # a vector of each of 8 partitions
        sent.destroy()
        return sum(r["value"] for r in found), sum(np.frombuffer(r["total"], np.float32).astype(float) for r in found)

    start = np.zeros(size)
    start[-6] = -4.0
    w = maximise(lambda x: summed(likelihood, x, size), start, rules.rounds, rules.ridge)

    def masses(own: Part, w: np.ndarray) -> tuple[float, np.ndarray]:
        p = marginals(scores(own, w[:-6]) + w[-6], own.first, w[-5:-1].reshape(2, 2), w[-1])
        return 0.0, np.concatenate([np.bincount(own.side, p, 2), np.bincount(own.side, minlength=2)])

    _, (mass0, mass1, words0, words1) = summed(masses, w, 4)
    shared.destroy()
    rates = (float((mass1 + 0.5) / (words1 + 1)), float((mass0 + 0.5) / (words0 + 1)))
    used = np.flatnonzero(np.abs(w[: len(vocabulary)]) > 1e-6)
    return Model(vocabulary[used], w[used], w[-6:], rates, float(np.log(counts[True] / counts[False])))


def tagged(own: Words, model: Model) -> np.ndarray:
    """The probability that each word is toxic."""
    w = np.append(model.weights, 0.0)[places(own.codes, model.codes)]
    if len(own.type) == 0:
        return np.zeros(0)
    s = _around(own.type, own.first, w[:-2].sum(axis=0) + model.rest[0], w[-2], w[-1])
    return marginals(s, own.first, model.rest[1:5].reshape(2, 2), model.rest[5])


def odds(toxic_words: np.ndarray, words: np.ndarray, model: Model) -> np.ndarray:
    """Log-odds that a text of so many words, of which so many are expected to be toxic, is toxic."""
    high, low = model.rates
    return model.prior + toxic_words * np.log(high / low) - words * (high - low)


def document_score(mass: np.ndarray, where: np.ndarray, model: Model, stretch: int) -> np.ndarray:
    """The score of each document, or that of its most toxic stretch if it has several. mass: the sum of marginals before each
    word (one more entry than words)."""
    size = np.diff(where)
    best = odds(mass[where[1:]] - mass[where[:-1]], size, model)
    long = np.flatnonzero(size > stretch)
    if len(long):
        half = max(1, stretch // 2)
        n = -(-(size[long] - stretch) // half) + 1  # stretches overlap by a half
        doc = np.repeat(long, n)
        begin = np.minimum(where[doc] + tx.ragged(np.zeros(len(n), np.int64), n) * half, where[doc + 1] - stretch)
        of = odds(mass[begin + stretch] - mass[begin], np.full(len(begin), stretch), model) - np.log(np.repeat(n, n))
        np.maximum.at(best, doc, of)
    return 1 / (1 + np.exp(-np.clip(best, -500, 500)))


def scored(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, score, toxic, toxic_words (sum of marginals), words, spans (characters, from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in tx.slices(batch.column(1)):
                ids = batch.column(0).slice(piece.first, piece.count)
                own = words(piece)
                begins, ends, where = own[:3]
                p = tagged(own, model) if model else np.zeros(len(begins))
                sums = np.append(0, np.cumsum(p))
                mass, n = sums[where[1:]] - sums[where[:-1]], np.diff(where)
                score = document_score(sums, where, model, rules.stretch) if model else np.zeros(piece.count)
                hit = np.flatnonzero(p > 0.5)
                doc = np.searchsorted(where, hit, "right") - 1
                lead = np.ones(len(hit), bool)
                lead[1:] = (hit[1:] != hit[:-1] + 1) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(lead)
                last = hit[np.append(at[1:], len(hit)) - 1] if len(at) else hit
                chars = np.append(0, np.cumsum((piece.data & 0xC0) != 0x80))
                base = chars[piece.offsets[:-1]][doc[at]]
                pairs = pa.StructArray.from_arrays([pa.array(chars[begins[hit[at]]] - base, pa.int32()), pa.array(chars[ends[last]] - base, pa.int32())], ["begin", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(piece.count + 1)), pa.int32()), pairs)
                judged = pa.array(score) if model else pa.nulls(piece.count, pa.float64())
                yield pa.RecordBatch.from_arrays([ids, judged, pa.array(score > rules.floor), pa.array(mass), pa.array(n, pa.int32()), spans], ["doc_id", "score", "toxic", "toxic_words", "words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCORED)


def toxic(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``scored`` of toxic documents."""
    return scored(docs, labels, rules).where("toxic")
