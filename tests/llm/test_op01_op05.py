import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.helpers import WORDS, edge_docs, edge_rows, empty_docs, prose

from linkloom.llm import op01_divergence as op1
from linkloom.llm import op05_language as op5
from linkloom.llm import text as tx


def test_distance_is_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert abs(op1.distance(p, q) - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12
    assert op1.distance(p, p) == 0 and op1.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_histograms_against_brute_force():
    rules = op1.Rules()
    texts = ["The THE of, x!\n", None, "é1 \x01*", ""]
    found = list(op1.counts(["en", "en", "xx", None], pa.array(texts), rules))
    own = list(dict.fromkeys(rules.common["en"]))
    for text, (_, n, chars, m, words) in zip(texts, found):
        text = text or ""
        assert n == len(text) == chars.sum() and m == len(text.split())
        if words is not None:
            count = Counter(w if w in own else None for w in text.lower().split())
            assert words.tolist() == [count[w] for w in own] + [count[None]]
    assert found[2][2].tolist() == [0, 0, 1, 1, 0, 1, 1, 1]


def test_divergence_rejects_odd_documents_and_keeps_clean_ones(spark):
    good = [(k, prose(k, 300), "en", "s", 1) for k in range(40)]
    bad = [(100, " ".join(f"{w.upper()}!!" for w in prose(1, 300).split()), "en", "s", 1), (101, " ".join(f"{w}&&&***" for w in prose(2, 300).split()), "en", "s", 1), (102, "@#" * 2, "en", "s", 1)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    keep = {r.doc_id: r.keep for r in op1.divergence(docs).collect()}
    assert [k for k, v in keep.items() if not v] == [100, 101]  # 102 is too short to judge
    assert op1.accepted(docs).count() == len(good) + 1


def test_divergence_edges(spark):
    docs = edge_docs(spark)
    out = op1.divergence(docs).collect()
    assert len(out) == len(edge_rows())
    assert all(r.keep and r.js_chars is None and r.js_words is None for r in out if r.chars < 200)
    assert op1.accepted(docs).schema == docs.schema
    assert op1.divergence(empty_docs(spark)).count() == 0 and op1.accepted(empty_docs(spark)).count() == 0


def _rows():
    out = []
    for lang in WORDS:
        out += [(len(out) + k, prose(f"{lang}{k}", 200, lang), lang, "s", 1) for k in range(30)]
    return out


def test_mixture_finds_languages_and_proportions(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    models = op5.train(docs)
    mixed = prose("x", 300, "en") + " " + prose("y", 100, "de")
    other = [(1, prose("z", 200, "fr"), "fr", "s", 1), (2, mixed, "en", "s", 1), (3, prose("w", 300, "de"), "en", "s", 1), (4, "qxzw kjqx zzqk " * 60, None, "s", 1)]
    out = {r.doc_id: r for r in op5.identify(spark.createDataFrame(other, docs.schema), models=models).collect()}
    assert out[1].languages == ["fr"] and out[1].keep
    assert set(out[2].languages) == {"en", "de"} and abs(dict(zip(out[2].languages, out[2].proportions))["de"] - 0.27) < 0.12
    assert out[3].language == "de" and not out[3].keep  # declared English
    assert out[4].language == "und" and not out[4].keep
    own = {r.doc_id: r for r in op5.identify(docs, models=models).collect()}
    assert sum(own[d].language == lang for d, _, lang, _, _ in _rows()) >= 0.98 * len(own) and all(r.keep for r in own.values())


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(0)
    chance = rng.random((50, 3)) + 0.01
    chance /= chance.sum(axis=0)
    counts = rng.integers(1, 5, 50).astype(float)
    values = [op5.mixture(chance, counts, steps)[1] for steps in range(1, 12)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))
    share, best = op5.mixture(chance, counts, 500)
    for _ in range(200):  # no other mixture is much better
        x = rng.dirichlet(np.ones(3))
        assert counts @ np.log(chance @ x) <= best + 0.05


def test_trigrams_against_brute_force():
    texts = ["Ab c1d", "", "éÉ ab", "xyz"]
    piece = next(tx.slices(pa.array(texts)))
    found, where = op5.grams(piece)
    for k, text in enumerate(texts):
        raw = bytes(b if tx.WORD[b] and not 48 <= b < 58 else 32 for b in text.lower().encode())
        want = [raw[i : i + 3] for i in range(len(raw) - 2) if b"  " not in raw[i : i + 3]]
        code = [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17 for a, b, c in want]
        assert found[where[k] : where[k + 1]].tolist() == code


def test_language_edges(spark):
    docs = edge_docs(spark)
    out = op5.identify(docs).collect()
    assert len(out) == len(edge_rows())
    assert not any(r.keep for r in out if r.doc_id in (1, 2, 3, 4))
    assert op5.accepted(docs).schema == docs.schema
    assert op5.identify(empty_docs(spark)).count() == 0 and op5.accepted(empty_docs(spark)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert all(r.keep and r.language == "und" for r in op5.identify(unlabelled).collect())


def test_divergence_against_sql(spark):
    import duckdb

    docs = edge_docs(spark).select("doc_id", "text", "lang").where("doc_id is not null").dropDuplicates(["doc_id"])
    more = spark.createDataFrame([(1000 + k, prose(k, 50 + 7 * k, lang), lang) for k in range(12) for lang in ("en", "de", "fr")], "doc_id long, text string, lang string")
    docs = docs.unionByName(more).toPandas()
    db = duckdb.connect()
    table = pa.Table.from_pandas(docs)
    db.register("documents", table)
    plain = lambda rows: sorted(([None if x != x else x for x in r] for r in rows), key=str)
    got = op1.divergence(spark.createDataFrame(docs.astype(object).where(docs.notna(), None), "doc_id long, text string, lang string")).collect()
    assert plain(got) == plain(db.execute(op1.sql()).fetchall())


def test_language_sets_against_all_subsets():
    rng = np.random.default_rng(12)
    side = 300
    chance = rng.dirichlet(np.full(side, 0.2), size=5).T
    models = op5.Models(("a", "b", "c", "d", "und"), chance)
    rules = op5.Rules(steps=400)
    same = 0
    for _ in range(30):
        own = rng.choice(5, rng.integers(1, 4), replace=False)
        share = rng.dirichlet(np.ones(len(own)))
        found = rng.choice(side, 800, p=chance[:, own] @ share).astype(np.uint16)
        counts = np.bincount(found, minlength=side).astype(float)
        used = counts > 0
        fee = rules.penalty * np.log(len(found))
        value = lambda x: op5.mixture(chance[used][:, list(x)], counts[used], rules.steps)[1] - fee * (len(x) - 1)
        best = max((x for n in range(1, 6) for x in itertools.combinations(range(5), n)), key=value)
        got, shares = op5.infer(found, models, rules)
        assert abs(shares.sum() - 1) < 1e-9 and value(sorted(got)) >= value(best) - 0.5
        same += set(got) == set(best)
    assert same >= 29
