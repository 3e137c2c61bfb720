import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose

from linkloom.llm import op02_suffixes as op


def brute(docs, size):
    """All repeated passages of distinct (doc_id, text), by doc_id."""
    places = defaultdict(list)
    for d, text in sorted(set(docs)):
        words = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", text) if w]
        for s in range(len(words) - size + 1):
            places[tuple(words[s : s + size])].append((d, s))
    starts = defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            for k, (d, s) in enumerate(sorted(found)):
                starts[d, k == 0].append(s)
    out = set()
    for (d, original), own in starts.items():
        own.sort()
        begin, end = own[0], own[0] + size
        for s in own[1:]:
            if s >= end:
                out.add((d, begin, end, original))
                begin = s
            end = s + size
        out.add((d, begin, end, original))
    return out


def found(df, rules):
    return {(r.doc_id, r.begin_word, r.end_word, r.original) for r in op.repeats(df, rules).collect()}


def corpus(seed):
    pick = random.Random(seed)
    passages = [prose(f"p{k}", pick.randint(10, 60)) for k in range(6)]
    out = []
    for d in range(60):
        parts = [prose(f"{seed}-{d}-{k}", pick.randint(0, 40)) for k in range(3)] + pick.choices(passages, k=pick.randint(0, 3))
        pick.shuffle(parts)
        out.append((d, " \n".join(parts)))
    out += [(100 + k, out[0][1] + " " + out[1][1]) for k in range(15)] + [(200, "same " * 90), (201, "a b " * 60)]
    return out


@pytest.mark.parametrize("size", [12, 20, 50])
@pytest.mark.parametrize("mb", [1.0, 0.0005])
def test_repeats_against_brute_force(spark, tmp_path, size, mb):
    docs = corpus(size)
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    df = spark.read.parquet(path)
    # small buckets and few samples: many boundaries, and frequent suffixes as splitters
    assert found(df, op.Rules(min_words=size, bucket_mb=mb, flush=1 << 12)) == brute(docs, size)


def test_what_is_cut_is_gone_and_the_rest_stays(spark):
    docs = corpus(3)
    rules = op.Rules(min_words=20)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as key", "cast(length(text) as bigint) n_chars")
    out = op.deduplicated(df, rules)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns
    drop = defaultdict(set)
    for d, a, b, original in brute(docs, 20):
        if not original:
            drop[d] |= set(range(a, b))
    for d, text in docs:
        left = [w for k, w in enumerate(text.split()) if k not in drop[d]]
        assert (d in got) == bool(left)
        if left:
            assert got[d].text.split() == left and got[d].n_chars == len(got[d].text) and (drop[d] or got[d].text == text)


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    for high in (2, 5, 1 << 60):
        words = rng.integers(0, high, (3, 5000)).astype(np.uint64)
        order = op.multikey(words)
        assert sorted(order) == list(range(5000)) and (words[:, order] == words[:, np.lexsort(words[::-1])]).all()
    assert len(op.multikey(np.zeros((3, 0), np.uint64))) == 0


def test_buckets_are_in_order_of_the_splitters():
    rng = np.random.default_rng(2)
    words, tie = rng.integers(0, 4, (3, 3000)).astype(np.uint64), rng.integers(0, 4, 3000).astype(np.uint64)
    splits = np.unique(rng.integers(0, 4, (4, 40)).astype(np.uint64), axis=1)
    splits = splits[:, np.lexsort(splits[::-1])]
    at, hot = op.bucket(words, tie, splits)
    keys = [tuple(x) for x in splits.T.tolist()]
    for k in range(3000):
        own = (*words[:, k].tolist(), int(tie[k]))
        assert at[k] == sum(s <= own for s in keys) and hot[k] == any(s[:3] == own[:3] for s in keys)


def test_edges(spark):
    docs = edge_docs(spark)
    out = found(docs, op.Rules())
    ids = {d for d, *_ in out}
    assert {7, 8, 10, 11} <= ids and ids <= {7, 8, 10, 11, 15}  # null ids repeat only themselves: one document
    assert {(d, o) for d, _, _, o in out if d in (7, 8)} == {(7, True), (8, False)}
    kept = op.deduplicated(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in edge_rows() if r[0] != 8)
    assert op.repeats(empty_docs(spark)).count() == 0 and op.deduplicated(empty_docs(spark)).count() == 0


def test_repeats_against_sql(spark):
    import duckdb

    docs = spark.createDataFrame(corpus(9) + [(300, None), (301, ""), (302, " \n ")], "doc_id long, text string")
    db = duckdb.connect()
    table = docs.toArrow()
    db.register("documents", table)
    rules = op.Rules(min_words=20)
    assert sorted(tuple(r) for r in op.repeats(docs, rules).collect()) == sorted(db.execute(op.sql(rules)).fetchall())


@pytest.mark.parametrize("rules", [op.Rules(min_words=2), op.Rules(min_words=3), op.Rules(min_words=7), op.Rules(min_words=255), op.Rules(min_words=256), op.Rules(min_words=300), op.Rules(min_words=20, every=True)], ids=str)
def test_lengths_of_passages_against_brute_force(spark, rules):
    long = prose("long", 900)
    docs = [(0, long), (1, long), (2, "x " + long[:3000]), (3, prose("other", 400)), (4, "a a a a b"), (5, "a b"), (6, "same " * 700)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, rules) == brute(docs, rules.min_words) and found(df, rules)


def test_ranges_are_bounded_and_cut_evenly(spark, tmp_path):
    docs = corpus(20)
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    df = spark.read.parquet(path)
    for ranges in (1, 3):
        rules = op.Rules(min_words=20, bucket_mb=0.0005, flush=1 << 12, ranges=ranges, sample=8)
        assert op.width(df, rules.bucket_mb) > 8 * ranges and found(df, rules) == brute(docs, 20)


def test_frequent_suffixes_of_a_range_are_spread_over_its_buckets(spark, tmp_path):
    passage = prose("everywhere", 40)
    docs = corpus(21) + [(1000 + k, prose(f"own{k}", 6) + " " + passage) for k in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    df = spark.read.parquet(path)
    rules = op.Rules(min_words=20, bucket_mb=0.0005, flush=1 << 12, ranges=2, sample=512)
    cuts, often = op.splitters(op.keyed(df), 2, op.size(df), rules)
    assert len(often) and found(df, rules) == brute(docs, 20)
    alike = np.repeat(np.array([[5], [6], [7]], np.uint64), 1000, axis=1)
    held = op.Suffixes(np.arange(1000), np.zeros(1000, np.int64), np.ones(1000, np.int64), alike, np.full(1000, 9, np.uint64))
    keys = np.arange(1000) * 7919
    for codes, parts in ((op._code(alike[:, :1]), 50), (np.zeros(0, np.uint64), 1)):
        (batch,) = op._pack([(keys, np.zeros(1000, np.uint8), keys, held)], cuts, codes, 50)
        assert len(set(batch.column(1).to_pylist())) == parts


def test_passages_have_words():
    with pytest.raises(ValueError):
        op.Rules(min_words=1)
