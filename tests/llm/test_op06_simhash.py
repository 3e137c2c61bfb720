import dataclasses
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose

from linkloom.llm import components as cc
from linkloom.llm import op06_simhash as op
from linkloom.llm import text as tx

_BITS = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def distances(hi, lo):
    raw = np.stack([hi, lo], axis=1).view(np.uint8)
    return _BITS[raw[:, None] ^ raw[None]].sum(axis=2)


def test_bit_sliced_comparison_against_brute_force():
    rng = np.random.default_rng(0)
    for n, radius in ((1, 5), (2, 128), (200, 60), (333, 55), (500, 0)):
        hi, lo = rng.integers(-(1 << 62), 1 << 62, (2, n))
        hi[n // 2 :], lo[n // 2 :] = hi[: n - n // 2] ^ 5, lo[: n - n // 2]
        cuts = np.sort(rng.integers(0, n, 3))
        ends = np.array([min([c for c in (*cuts, n) if c > k]) for k in range(n)])
        got = {(a, b) for i, j in op.close(hi, lo, ends, radius, block=64) for a, b in zip(i.tolist(), j.tolist())}
        far = distances(hi, lo)
        assert got == {(a, b) for a in range(n) for b in range(a + 1, ends[a]) if far[a, b] <= radius}


def test_components_against_brute_force(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in {y for e in edges for y in e} if find(x) != x}
    assert {tuple(r) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    a, b = cc.local(*np.array(edges).T)
    assert set(zip(a.tolist(), b.tolist())) == want


def edited(text, seed, share):
    pick = random.Random(seed)
    return " ".join(f"w{pick.random():.6f}" if pick.random() < share else w for w in text.split())


def test_recall_against_brute_force_and_clean_documents_stay(spark):
    docs = [(k, prose(k, 250)) for k in range(150)]
    docs += [(1000 + k, edited(docs[k][1], k, 0.05)) for k in range(60)] + [(2000 + k, docs[3][1]) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.duplicate_of for r in op.duplicates(df).collect()}
    prints = [op.fingerprint(p)[0] for p in tx.slices(pa.array([t for _, t in docs]))]
    far = distances(*np.concatenate(prints).T.copy().view(np.int64))
    ids = np.array([d for d, _ in docs])
    close = [(ids[a], ids[b]) for a, b in np.argwhere(np.triu((far <= op.Rules().radius) & (far > 0), 1)) if max(ids[a], ids[b]) < 2000]
    same = sum(got.get(a, a) == got.get(b, b) for a, b in close)
    assert same >= 0.98 * len(close) and len(close) >= 57
    assert set(got) <= {d for d in ids if d >= 1000} and sum(got.get(1000 + k) == k for k in range(60)) >= 57
    assert all(got[2000 + k] == 3 for k in range(300))
    kept = {r.doc_id for r in op.deduplicated(df).collect()}
    assert kept == set(ids) - set(got)


def test_edges(spark):
    docs = edge_docs(spark)
    got = {r.doc_id: (r.duplicate_of, r.links) for r in op.duplicates(docs).collect()}
    assert got == {8: (7, 0)}
    kept = op.deduplicated(docs)
    assert kept.dtypes == docs.dtypes
    ids = [r[0] for r in edge_rows()]
    left = [r.doc_id for r in kept.collect()]
    assert left.count(15) == 2  # other text, other document
    assert sorted({x for x in left if x is not None}) == sorted({x for x in ids if x is not None} - {8}) and left.count(7) == 1
    assert left.count(None) == 2  # the two rows of the same text are one document, the one without text another
    assert op.duplicates(empty_docs(spark)).count() == 0 and op.deduplicated(empty_docs(spark)).count() == 0


def test_documents_of_one_doc_id_are_judged_by_their_texts(spark):
    a, b = prose(1, 120), prose(2, 150)
    docs = [(1, a), (1, b), (2, a + " more"), (None, b), (None, a), (3, "..."), (3, "...")]
    left = op.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(1, a), (1, b), (3, "..."), (3, "...")])


def _pairs(n, radius, seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 2, (n, op.WIDTH), np.uint8)
    other = raw.copy()
    for row in other:
        row[rng.choice(op.WIDTH, radius, replace=False)] ^= 1
    return np.packbits(np.concatenate([raw, other]), axis=1).view(np.int64).T.copy()


def _found(spark, hi, lo, rules, parts=None):
    reps = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(hi, lo))], "rep long, hi long, lo long")
    rows = op.near(reps, len(hi), rules, parts).collect() if parts else op.near(reps, len(hi), rules).collect()
    links = np.zeros(len(hi), np.int64)
    for r in rows:
        if r.b is None:
            links[r.a] += r.links
    return {(r.a, r.b) for r in rows if r.b is not None}, links


def test_no_pair_at_the_radius_is_left_out(spark):
    hi, lo = _pairs(1500, op.Rules().radius, 5)
    far = distances(hi, lo)
    _, links = _found(spark, hi, lo, op.Rules())
    assert links.tolist() == ((far <= op.Rules().radius).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("n", [10**4, 10**7, 10**9])
def test_all_pairs_at_the_radius_with_the_parts_of_many_documents(spark, n):
    """Pairs at exactly the radius, none of them exact copies, with the parts that n fingerprints get; in three blocks at most."""
    rules = op.Rules()
    hi, lo = _pairs(400, rules.radius, n % 97)
    far = distances(hi, lo)
    want = {(int(b), int(a)) for a, b in np.argwhere(np.triu(far <= rules.radius, 1))}
    assert len(want) >= 400
    parts = op.Parts.sized(n, rules)
    got, links = _found(spark, hi, lo, rules, dataclasses.replace(parts, blocks=min(parts.blocks, 3), groups=min(len(parts.bits), 2)))
    assert got == want and links.sum() == 2 * len(got)


@pytest.mark.parametrize("n", [1500, 10**6])
def test_many_fingerprints_near_each_other_lose_no_link(spark, n):
    """A third of all fingerprints lie within a few bits of each other."""
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 2, (1500, op.WIDTH), np.uint8)
    raw[:500] = raw[0] ^ (rng.random((500, op.WIDTH)) < 0.05)
    hi, lo = np.packbits(np.unique(raw, axis=0), axis=1).view(np.int64).T.copy()
    rules = op.Rules(block=400)
    far = distances(hi, lo)
    parts = dataclasses.replace(op.Parts.sized(n, rules), blocks=op.Parts.sized(1500, rules).blocks)
    assert parts.blocks == 4
    _, links = _found(spark, hi, lo, rules, parts)
    want = (far <= rules.radius).sum(axis=1) - 1
    assert links.tolist() == want.tolist() and want.max() > 200


def test_parts_allow_every_pair_within_the_radius_whatever_the_number_of_documents():
    """Beyond what each part allows, a pair differs in more bits than the radius, since no bit is in two parts."""
    for rules in (op.Rules(), op.Rules(block=1 << 22), op.Rules(radius=3), op.Rules(radius=0), op.Rules(radius=120), op.Rules(radius=op.WIDTH)):
        for n in (0, 1, 10**6, 12 * 10**6, 10**9, 5 * 10**10):
            own = op.Parts.sized(n, rules)
            assert len(set(np.concatenate(own.bits).tolist())) == sum(len(b) for b in own.bits) <= op.WIDTH
            assert min(own.allowed) >= 0 and sum(k + 1 for k in own.allowed) > rules.radius
            assert own.blocks * rules.block >= n and 1 <= own.groups <= len(own.bits) == len(own.allowed)


def test_few_of_all_pairs_are_compared_at_6_gb():
    own = op.Parts.sized(2_830_123, op.Rules())
    share = sum(sum(math.comb(len(b), d) for d in range(k + 1)) / 2 ** len(b) for b, k in zip(own.bits, own.allowed))
    assert share < 0.02  # of random bits


def test_one_row_of_each_document_with_its_class_and_links(spark):
    a, b = prose(1, 120), prose(2, 150)
    docs = [(1, a), (1, b), (1, a), (2, a + " more"), (None, b), (None, a), (3, "..."), (4, None), (5, prose(3, 90))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = op.classes(df).collect()
    assert len(got) == 8  # of the two rows alike, one
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append((r.doc_id or 0, r.duplicate_of, r.links, r.keep))
    assert sorted(map(sorted, groups.values()), key=str) == sorted(
        [[(0, 1, 1, False), (1, None, 1, True), (2, 1, 1, False)], [(0, 1, 0, False), (1, None, 0, True)], [(3, None, 0, True)], [(4, None, 0, True)], [(5, None, 0, True)]], key=str
    )
