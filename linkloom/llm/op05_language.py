"""Language identification by mixture inference.

Each language has a model of byte trigrams (letters folded, everything else a space), counted over every labelled
document. A document is a mixture of languages: expectation-maximisation estimates the proportions from its trigram
likelihoods, and languages are added one by one while the gain in log-likelihood exceeds a penalty per language, and taken away again where
later ones make up for them. A uniform model, ``und``, competes with the languages and takes what none of them explains.

Defined results: a null, empty or letterless text has languages ``['und']``, no grams and is not kept; a text with letters
but no trigram is ``und`` too, and kept, being too short to judge. A null ``lang`` counts for no model and never conflicts. Ties go to the language that sorts first. Repeated rows are scored each on its
own. A language of too few trigrams has no model and never conflicts. Without any labelled document all texts are ``und`` but kept, since there is no model to reject them. Extra columns
are ignored by ``identify`` and passed through untouched by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx

BITS = 15
UNKNOWN = "und"
_SPACE = np.uint8(32)
_LETTER = tx.WORD.copy()
_LETTER[48:58] = False


@dataclass(frozen=True)
class Rules:
    """penalty: nats per added language and per log of the trigram count (trigrams overlap, hence more than the 0.5 of
    BIC). smooth: pseudo-counts per bucket. least_grams: trigrams that a language's model needs. declared_floor: a document of at least declared_grams trigrams whose declared
    language has a lower proportion is rejected. und_ceiling: rejected if ``und`` has a higher proportion."""

    penalty: float = 1.5
    smooth: float = 0.05
    least_grams: int = 1000
    steps: int = 15
    declared_floor: float = 0.1
    declared_grams: int = 200
    und_ceiling: float = 0.5


def grams(piece: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of a slice, and where each document's begin (one more entry than documents)."""
    data = tx.fold(piece.data)
    data[~_LETTER[data]] = _SPACE
    n = len(data)
    if n < 3:
        return np.zeros(0, np.uint16), np.zeros(piece.count + 1, np.int64)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    gap = data == _SPACE
    good = ~((gap[:-2] & gap[1:-1]) | (gap[1:-1] & gap[2:]))
    for back in (1, 2):  # trigrams that would reach into the next document
        at = piece.offsets[1:-1] - back
        good[at[(at >= 0) & (at < n - 2)]] = False
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)
    where = np.concatenate(([0], np.cumsum(good)))
    return bucket[good], where[np.minimum(piece.offsets, n - 2)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        names = batch.column(0).to_pylist()
        for piece in tx.slices(batch.column(1)):
            found, where = grams(piece)
            for k in range(piece.count):
                name = names[piece.first + k]
                if name is not None and where[k + 1] > where[k]:
                    if name not in totals:
                        if len(totals) == 64:  # more than a task holds: the sums are added up later anyway
                            yield from counted()
                        totals[name] = np.zeros(1 << BITS, np.int64)
                    totals[name] += np.bincount(found[where[k] : where[k + 1]], minlength=1 << BITS)
    yield from counted()


@dataclass(frozen=True)
class Models:
    """names: the languages in order, then ``und``. chance: buckets x names, the probability of each trigram."""

    names: tuple[str, ...]
    chance: np.ndarray


def train(docs: DataFrame, rules: Rules = Rules()) -> Models:
    """Trigram models from all documents with a declared language. What reaches the driver is a count per language and
    bucket, however many documents there are."""
    counted = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language; values of lang that aren't languages don't reach the driver, however many there are.
    rows = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).where(F.col("total") >= rules.least_grams).toArrow()
    found = {lang: (buckets.values.to_numpy(), counts.values.to_numpy()) for lang, buckets, counts in zip(rows["lang"].to_pylist(), rows["buckets"], rows["counts"])}
    names = sorted(x for x in found if x != UNKNOWN)
    chance = np.full((1 << BITS, len(names) + 1), rules.smooth)
    for k, name in enumerate(names):
        chance[found[name][0], k] += found[name][1]
    chance[:, -1] = 1
    return Models((*names, UNKNOWN), chance / chance.sum(axis=0))


def mixture(chance: np.ndarray, counts: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``chance`` (trigrams of one document x languages) and their log-likelihood."""
    share = np.full(chance.shape[1], 1 / chance.shape[1])
    total = counts.sum()
    for _ in range(steps):
        fresh = share * ((counts / (chance @ share)) @ chance) / total
        moved = abs(fresh - share).max()
        share = fresh
        if moved < 1e-3:
            break
    return share, float(counts @ np.log(chance @ share))


def infer(found: np.ndarray, models: Models, rules: Rules) -> tuple[list[int], np.ndarray]:
    """The languages of one document (columns of the models, by falling proportion) and their proportions."""
    if len(found) == 0:
        return [len(models.names) - 1], np.ones(1)
    ordered = np.sort(found)
    at = tx.runs(ordered)
    counts = np.diff(np.append(at, len(ordered))).astype(np.float64)
    chance = models.chance[ordered[at]]
    single = counts @ np.log(chance)
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single[chosen[0]])
    fee = rules.penalty * np.log(len(found))
    while len(chosen) < len(models.names):
        # The log-likelihood is concave in the proportions, so a language can't add more than its slope.
        slope = (counts / (chance[:, chosen] @ share)) @ chance - len(found)
        slope[chosen] = -np.inf
        tried = [(int(k), *mixture(chance[:, [*chosen, int(k)]], counts, rules.steps)) for k in np.flatnonzero(slope > fee)]
        tried = [x for x in tried if x[2] - best > fee]
        if not tried:
            break
        k, share, best = max(tried, key=lambda x: x[2])
        chosen.append(k)
        while len(chosen) > 1:  # what came first may be needed no longer
            fewer = ([x for x in chosen if x != k] for k in chosen)
            left, less, worse = max(((own, *mixture(chance[:, own], counts, rules.steps)) for own in fewer), key=lambda x: x[2])
            if best - worse >= fee:
                break
            chosen, share, best = left, less, worse
    order = np.argsort(-share, kind="stable")
    return [chosen[k] for k in order], share[order]


def _decide(names: list, texts: pa.Array, models: Models, rules: Rules) -> Iterator[tuple[list[str], list[float], int, bool]]:
    for piece in tx.slices(texts):
        found, where = grams(piece)
        for k in range(piece.count):
            own = found[where[k] : where[k + 1]]
            chosen, share = infer(own, models, rules)
            part = {models.names[x]: float(y) for x, y in zip(chosen, share)}
            declared = names[piece.first + k]
            known = declared in models.names and declared != UNKNOWN
            conflict = known and len(own) >= rules.declared_grams and part.get(declared, 0.0) < rules.declared_floor
            if len(own) == 0:  # too short to judge, if it has letters at all
                alien = not _LETTER[piece.data[piece.offsets[k] : piece.offsets[k + 1]]].any()
            else:
                alien = part.get(UNKNOWN, 0.0) > rules.und_ceiling
            keep = len(models.names) == 1 or not (conflict or alien)
            yield list(part), list(part.values()), len(own), keep


def identify(docs: DataFrame, rules: Rules = Rules(), models: Models | None = None) -> DataFrame:
    """One row per document: doc_id, languages and proportions (by falling proportion), language (the first), grams and
    keep (see ``Rules`` for what is rejected)."""
    models = models or train(docs, rules)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_decide(batch.column(1).to_pylist(), batch.column(2), shared.value, rules))
            langs, parts, n, keep = ([x[k] for x in rows] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in langs], pa.string()), pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(keep, pa.bool_())],
                ["doc_id", "language", "languages", "proportions", "grams", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, language string, languages array<string>, proportions array<double>, grams long, keep boolean"
    )


def accepted(docs: DataFrame, rules: Rules = Rules(), models: Models | None = None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with all their columns."""
    models = models or train(docs, rules)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            keep = [x[3] for x in _decide(batch.column(at["lang"]).to_pylist(), batch.column(at["text"]), shared.value, rules)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
