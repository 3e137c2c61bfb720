import os
import random

import corpus_pipeline
from tests.llm.helpers import WORDS, edge_rows, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    docs = []
    for lang in WORDS:
        docs += [(1000 * len(docs) + k, prose(f"{lang}{k}", 200, lang), lang, "s", 1) for k in range(40)]
    copies = [(5_000_000 + k, docs[0][1], "en", "s", 1) for k in range(20)]
    loud = [(6_000_000, " ".join(f"{w.upper()}!!" for w in docs[1][1].split()), "en", "s", 1)]
    alien = [(7_000_000, prose("alien", 300, "de"), "en", "s", 1)]
    passage = prose("passage", 60)
    shared = [(8_000_000 + k, prose(f"s{k}", 150) + "\n" + passage, "en", "s", 1) for k in range(3)]
    return docs + copies + loud + alien + shared, passage


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    docs, passage = corpus()
    now = spark.createDataFrame(docs, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        at = str(tmp_path / name)
        out.write.parquet(at)
        now = spark.read.parquet(at)
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {d for d, *_ in docs if d < 5_000_000 or d >= 8_000_000}
    assert set(seen["language"]) == {d for d, *_ in docs} - {7_000_000}
    assert set(seen["quality"]) == set(seen["language"]) - {6_000_000}
    assert set(seen["near_duplicates"]) == clean
    assert sum(passage.split()[5] in r.text and passage in r.text for r in seen["passages"].values()) == 1 and set(seen["passages"]) == clean
    assert set(seen["packing"]) == clean


def test_run_gives_the_last_stage(spark, tmp_path):
    docs, _ = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "begin", "length", "bin", "place"] and out.count() >= 120
    (left,) = {f.rpartition("/")[0] for f in out.inputFiles()}
    folder, _, last = left.removeprefix("file://").removeprefix("file:").rpartition("/")
    assert last.endswith("-packing") and last in os.listdir(folder) and not [x for x in os.listdir(folder) if x.endswith("-passages")]


def test_a_near_copy_among_many_documents_goes(spark, tmp_path):
    """Its fingerprint is 22 bits from its original's; random tables left the pair out."""
    pick = random.Random(1372)
    docs = [(k, prose(k, 60), "en", "s", 1) for k in range(2000)]
    docs.append((9000, " ".join(f"w{pick.random():.6f}" if pick.random() < 0.13 else w for w in docs[1372][1].split()), "en", "s", 1))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path)).collect()}
    assert 1372 in left and 9000 not in left


def test_edges(spark, tmp_path):
    for rows in (edge_rows(), []):
        at = tmp_path / str(len(rows))
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        # Of the copies of a text one stays at most, and what has no text has no piece.
        assert len({(r.doc_id, r.begin, r.length) for r in out}) == len(out) and not {1, 2, 8} & {r.doc_id for r in out} and bool(out) == bool(rows)
