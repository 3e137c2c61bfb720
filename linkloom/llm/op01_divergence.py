"""Quality rules: distribution divergence.

Two histograms are taken of each document, of its characters by class and of its words (the common words of its language,
and all others as one bin). Each is compared with the language's reference, the mean histogram of all documents of that
language that are long enough, by the Jensen-Shannon distance (base 2: 0 is equal, 1 is disjoint). A document is rejected
if a distance exceeds its ceiling; one shorter than a minimum length is never judged by that histogram.

Words are runs without white space, in lower case (ASCII). Languages without a list of common words, and documents whose
language is null (taken as one language of their own), are judged by characters alone.

Defined results: a null text counts as empty; an empty or short text has null distances and is kept. Repeated rows are
judged each on its own, and each counts for the reference. If fewer than least_docs documents of a language are long
enough, its distances are null and its documents are kept. Extra columns are ignored by ``divergence`` and passed through by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx

COMMON = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so dass kann".split(),
    "en": "the of and to in is for that with on as by was it an are at from this be a he or his had not but have".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha me".split(),
    "fr": "de la le les et des en un du une que est pour qui dans a par plus pas au sur ne se ce il elle son avec".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond")
_KIND = np.full(256, 5, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[list(tx.SPACES)] = 3
_KIND[list(b".,;:'\"()-")] = 4
_KIND[:32][[x not in tx.SPACES for x in range(32)]] = 6
_KIND[127] = 6
_KIND[0x80:0xC0] = 8  # a character of several bytes counts at its first
_KIND[0xC0:] = 7


@dataclass(frozen=True)
class Rules:
    """min_chars, min_words: lengths below which a histogram is no evidence. max_chars: ceiling of the distance of characters.
    max_words + noise / sqrt(words): that of words, whose histogram is noisy in a short text. common: words by language.
    least_docs: documents that a reference needs."""

    min_chars: int = 200
    min_words: int = 60
    max_chars: float = 0.32
    max_words: float = 0.22
    noise: float = 1.4
    common: dict = field(default_factory=lambda: COMMON)
    least_docs: int = 10


def _words(rules: Rules) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sorted hashes of all common words, and by language the column of each of them (-1: not of this language)."""
    every = sorted({w for own in rules.common.values() for w in own})
    known = np.array([tx.hash_of(w) for w in every], np.uint64)
    order = np.argsort(known)
    columns = {}
    for lang, own in rules.common.items():
        at = np.full(len(every), -1, np.int64)
        for k, w in enumerate(dict.fromkeys(own)):
            at[every.index(w)] = k
        columns[lang] = at[order]
    return known[order], columns


def counts(langs: list, texts: pa.Array, rules: Rules) -> Iterator[tuple[str, int, np.ndarray, int, np.ndarray | None]]:
    """Of each document: language, characters, their number by class, words, and their number by common word and last all
    others (None where the language has no list)."""
    known, columns = _words(rules)
    none = np.zeros(len(CLASSES), np.int64)
    for piece in tx.slices(texts):
        kind = _KIND[piece.data]
        begins, ends, where = tx.tokens(piece.data, piece.offsets, tx.NOT_SPACE)
        hashed = tx.hashes(tx.LOWER[piece.data], begins, ends)
        near = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
        near = np.where(known[near] == hashed, near, -1) if len(known) else np.full(len(hashed), -1)
        for k in range(piece.count):
            a, b = piece.offsets[k], piece.offsets[k + 1]
            chars = np.bincount(kind[a:b], minlength=9)[:8] if b > a else none
            lang = langs[piece.first + k]
            words, n = None, int(where[k + 1] - where[k])
            if lang in columns:
                size = len(dict.fromkeys(rules.common[lang]))
                found = near[where[k] : where[k + 1]]
                found = columns[lang][found[found >= 0]]
                words = np.bincount(found[found >= 0], minlength=size + 1)
                words[size] = n - words.sum()
            yield "" if lang is None else lang, int(chars.sum()), chars, n, words


def _sum(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], list] = {}

        def summed() -> pa.RecordBatch:
            rows = [(lang, what, k, float(v), x[0]) for (lang, what), x in totals.items() for k, v in enumerate(x[1])]
            totals.clear()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "what", "bin", "total", "docs"])

        for batch in batches:
            for lang, n, chars, m, words in counts(batch.column(0).to_pylist(), batch.column(1), rules):
                for what, size, least, own in (("chars", n, rules.min_chars, chars), ("words", m, rules.min_words, words)):
                    if own is not None and size >= max(1, least):
                        x = totals.setdefault((lang, what), [0, np.zeros(len(own))])
                        x[0] += 1
                        x[1] += own / size
            if len(totals) > 10_000:
                yield summed()
        yield summed()

    return run


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[tuple[str, str], np.ndarray]:
    """The mean histogram of each language, over all documents long enough; its size doesn't depend on their number."""
    rows = (
        docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(_sum(rules), "lang string, what string, bin int, total double, docs long")
        .groupBy("lang", "what", "bin").agg((F.sum("total") / F.sum("docs")).alias("mean"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= rules.least_docs)  # values of lang that aren't languages don't reach the driver
        .orderBy("lang", "what", "bin").collect()
    )
    found: dict[tuple[str, str], list] = {}
    for r in rows:
        found.setdefault((r["lang"], r["what"]), []).append(r["mean"])
    return {k: np.array(v) for k, v in found.items()}


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that each sum to 1, to the base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, both / 2)))


def _judge(langs: list, texts: pa.Array, found: dict, rules: Rules) -> Iterator[tuple]:
    for lang, n, chars, m, words in counts(langs, texts, rules):
        a = distance(chars / n, found[lang, "chars"]) if n >= max(1, rules.min_chars) and (lang, "chars") in found else None
        b = distance(words / m, found[lang, "words"]) if words is not None and m >= max(1, rules.min_words) and (lang, "words") in found else None
        a, b = (None if x is None else round(x, 6) for x in (a, b))
        yield n, m, a, b, not ((a or 0) > rules.max_chars or (b or 0) > rules.max_words + rules.noise / max(1, m) ** 0.5)


def divergence(docs: DataFrame, rules: Rules = Rules(), found: dict | None = None) -> DataFrame:
    """One row per document: doc_id, chars, words, js_chars, js_words (rounded to 6 places; null where not judged), keep."""
    found = references(docs, rules) if found is None else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_judge(batch.column(1).to_pylist(), batch.column(2), found, rules))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "chars", "words", "js_chars", "js_words", "keep"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, chars long, words long, js_chars double, js_words double, keep boolean"
    )


def accepted(docs: DataFrame, rules: Rules = Rules(), found: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that ``divergence`` keeps, with all their columns."""
    found = references(docs, rules) if found is None else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            keep = [r[4] for r in _judge(batch.column(at["lang"]).to_pylist(), batch.column(at["text"]), found, rules)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL for the rows of ``divergence`` over ``documents``."""
    members = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r" \t\n\r\x0b\x0c", "stop": r".,;:''\"()\-", "other": r"\x00-\x08\x0e-\x1f\x7f", "beyond": r"\x{80}-\x{10FFFF}"}
    count = {k: f"length(regexp_replace(text, '[^{v}]', '', 'g'))" for k, v in members.items()}
    chars = ", ".join([*(count[k] for k in CLASSES if k in count and CLASSES.index(k) < 5), "length(text) - " + " - ".join(count.values()), count["other"], count["beyond"]])
    common = ", ".join(f"('{lang}', {k}, '{w}')" for lang, own in rules.common.items() for k, w in enumerate(dict.fromkeys(own)))
    sizes = ", ".join(f"('{lang}', {len(dict.fromkeys(own))})" for lang, own in rules.common.items())
    js = "round(sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)), 6)"
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
common(lang, bin, word) as (values {common}), lists(lang, size) as (values {sizes}),
c as (select r, doc_id, lang, cast(length(text) as bigint) as n, list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') as ws, [{chars}] as counts from d),
base as (select r, doc_id, lang, n, cast(len(ws) as bigint) as m from c),
ch as (select r, lang, n, bin, v::double as v from (select r, lang, n, unnest(range(0, {len(CLASSES)})) as bin, unnest(counts) as v from c)),
word as (select r, lang, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word from (select r, lang, unnest(ws) as w from c)),
hit as (select w.r, k.bin, count(*) as v from word w join common k on k.lang = w.lang and k.word = w.word group by 1, 2),
bins as (select b.r, b.lang, b.m, unnest(range(0, l.size)) as bin from base b join lists l on l.lang = b.lang),
part as (select x.r, x.lang, x.m, x.bin, coalesce(h.v, 0) as v from bins x left join hit h on h.r = x.r and h.bin = x.bin),
wd as (select r, lang, m, bin, v::double as v from part union all select p.r, p.lang, p.m, l.size, (p.m - sum(p.v))::double from part p join lists l on l.lang = p.lang group by p.r, p.lang, p.m, l.size),
cref as (select lang, bin, sum(v / n) / count(*) as q from ch where n >= {max(1, rules.min_chars)} group by lang, bin having count(*) >= {rules.least_docs}), wref as (select lang, bin, sum(v / m) / count(*) as q from wd where m >= {max(1, rules.min_words)} group by lang, bin having count(*) >= {rules.least_docs}),
cjs as (select r, {js} as js from (select ch.r, ch.v / ch.n as p, cref.q from ch join cref using (lang, bin) where ch.n >= {max(1, rules.min_chars)}) group by r),
wjs as (select r, {js} as js from (select wd.r, wd.v / wd.m as p, wref.q from wd join wref using (lang, bin) where wd.m >= {max(1, rules.min_words)}) group by r)
select b.doc_id, b.n as chars, b.m as words, cjs.js as js_chars, wjs.js as js_words,
not (coalesce(cjs.js, 0) > {rules.max_chars}::double or coalesce(wjs.js, 0) > {rules.max_words}::double + {rules.noise}::double / sqrt(greatest(1, b.m))) as keep
from base b left join cjs on cjs.r = b.r left join wjs on wjs.r = b.r
"""
