"""Every registered query of the frontier against its SQL, and the entry point."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return own


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    out = queries.QUERIES[name](spark, SF)
    got = sorted(([plain(r[c]) for c in sorted(out.columns)] for r in out.collect()), key=str)
    rel = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(out.columns)
    assert got == sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark):
    plan = queries.QUERIES["dequeue_host_cap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "l_comment" not in plan and "Python" not in plan
    plan = queries.QUERIES["graph_reachability_depth"](spark, SF)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan


def made():
    """Paths under /fr that end in 9 or have 5 further down; no path, or an empty first name; names with LIKE's wildcards or escapes."""
    tails = ["", "7", "71", "5", "59", "589?page=2", "5#top", "59#top", "9", "x/5", "x/59", "x/5/9?q=1", "%35", "7%39", "100%/5", "a+b", "/", "/7", "?q=/fr/5", ";9"]
    heads = {"a.com": ["de", "en", "fr"], "b.com": ["fr", "it"], "c.com": ["a_b", "acb", "fr"], "d.com": ["c%C3%A9", "cxC3/zA9", "fr"], "e.com": ["en", "fr", "%66r"], "g.com": ["%", "fr", "[", "é"], "h.com": ["a\\b_", "a\\bc", "fr"]}
    found = [f"http://{h}/{x}/{t}" for h, own in heads.items() for x in own for t in tails] + [f"http://e.com{p}" for p in ("", "?q", "#f", "/", "//", "//9", "//7/9", "//[x", "///", "/fr", "/fr?/5", "/x#/fr/5")]
    return [*found, *found[:3], None, "", "mailto:x", "HTTPS://U@A.com:8/fr/59"]


@pytest.mark.parametrize("found", [["http://a.com/de/1", "http://a.com/fr/5", "http://a.com/fr/59", "http://a.com/fr/529?page=2", "http://a.com/fr/5469#top"], made()], ids=["nines", "odd"])
def test_robots_allow_where_a_line_cannot_say_what_the_sql_says(spark, tmp_path, found):
    rows = [*enumerate(found), (0, found[1])]
    spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("")).write.parquet(str(tmp_path / "pages.parquet"))
    own = duckdb.connect()
    own.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.QUERIES["robots_allow"](spark, str(tmp_path)).select("page_id", "allowed").collect()
    assert sorted((r.page_id, found[r.page_id], r.allowed) for r in got) == sorted((k, found[k], allowed) for k, allowed in own.execute(queries.ORACLE_SQL["robots_allow"]).fetchall())
