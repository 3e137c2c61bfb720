"""States, metadata, domains, statistics, graph, sources, strategies, sessions, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.operators import domains, enrich, graph, metadata, order, states, stats
from linkloom.plans import simulate, strategies
from linkloom.plans.session import FrontierSession
from linkloom.plans.settings import Settings
from linkloom.sources import events as log
from linkloom.sources import robots, seeds, sitemap
from linkloom.sources.store import FrontierStore
from linkloom.streaming import pipelines


def frame(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_states(spark):
    known = frame(spark, [("10", 2), ("11", 3), ("12", 1), ("13", 0)], "fingerprint string, state int")
    batch = frame(spark, [("10",), ("12",), ("13",), ("14",), (None,)], "fingerprint string")
    assert collected(states.with_state(batch, known), "fingerprint", "state") == [("10", 2), ("12", 1), ("13", 0), ("14", 0), (None, 0)]
    assert collected(states.not_crawled(batch, known), "fingerprint") == [("13",), ("14",), (None,)]
    assert collected(states.misses(batch.dropna(), known), "fingerprint") == [("14",)]


def test_first_and_last_wins_and_upsert(spark):
    rows = frame(spark, [("a", 1, "x"), ("a", 2, None), ("b", 5, "y"), ("b", 4, "z")], "fingerprint string, seq long, v string")
    assert collected(states.first_wins(rows), "fingerprint", "v") == [("a", "x"), ("b", "z")]
    assert collected(states.last_wins(rows), "fingerprint", "v") == [("a", None), ("b", "y")]
    table = frame(spark, [("a", "old", 7, 0), ("c", "keep", 8, 0)], "fingerprint string, v string, w int, seq long")
    out = states.upsert(table, rows)
    assert collected(out, "fingerprint", "v", "w", "seq") == [("a", "x", 7, 2), ("b", "y", None, 5), ("c", "keep", 8, 0)]
    assert collected(states.upsert(out, rows), *out.columns) == collected(out, *out.columns)  # replayed: no effect


def test_enrichment_and_redirects(spark):
    rows = frame(spark, [("http://first.com/", "f2", ["http://www.first.com/"], ["f1"]), ("http://a.com", "f3", [], []), ("http://b.com", "f4", None, None)], "url string, fingerprint string, redirect_urls array<string>, redirect_fingerprints array<string>")
    assert collected(enrich.basic_canonical(rows), "url", "fingerprint") == [("http://a.com", "f3"), ("http://b.com", "f4"), ("http://www.first.com/", "f1")]
    assert [r.redirect_urls for r in enrich.basic_canonical(rows).where("fingerprint = 'f1'").collect()] == [["http://www.first.com/", "http://first.com/"]]
    cases = [("http://www.first.org/company/", "http://second.com/404", 0), ("http://www.first.org", "http://second.com", 1), ("http://www.first.org/x", "http://www.first.org/search", 1)]
    moved = frame(spark, [(b, "t", [a], ["s"]) for a, b, _ in cases], rows.schema.simpleString()[7:-1].replace(":", " "))
    assert collected(enrich.corporate_canonical(moved), "url") == sorted((c[c[2]],) for c in cases)
    events = frame(spark, [(1, ["u1", "u2"], ["f1", "f2"])], "seq long, redirect_urls array<string>, redirect_fingerprints array<string>")
    assert collected(metadata.redirects(events), "fingerprint", "url", "dest_fingerprint") == [("f1", "u1", "f2"), ("f2", "u2", "f2")]
    made = enrich.requests(frame(spark, [("http://a.com", "post")], "url string, method string"), solver=enrich.only(F.col("method") == "POST"))
    assert collected(made, "method", "domain.name") == [("POST", "a.com")]
    assert collected(enrich.with_depth()(frame(spark, [(None,), (2,)], "parent_depth int")), "depth") == [(0,), (3,)]
    slots = enrich.slot_key(frame(spark, [("http://a.com",), ("http://b.com",)], "url string"), "ip", frame(spark, [("a.com", "1.2.3.4")], "host string, ip string"))
    assert collected(slots, "slot") == [("1.2.3.4",), ("b.com",)]


EVENTS = [
    ("page_crawled", 0, "http://a.com", "fa", None, [], 200, None, None, None, 0),
    ("links_extracted", 0, "http://a.com", "fa", 0, [("http://a.com/1", "f1", "a.com", None), ("http://b.com/", "fb", "b.com", None), ("http://a.com/1", "f1", "a.com", None), ("x", None, None, None)], None, None, None, None, 1),
    ("request_error", 0, "http://c.com", "fc", None, [], None, "Timeout", None, None, 2),
    ("update_score", 0, "http://d.com", "fd", 3, [], None, None, 0.6, True, 3),
    ("update_score", 0, "http://d.com", "fd", 3, [], None, None, 0.9, True, 4),
    ("update_score", 0, "http://e.com", "fe", 1, [], None, None, 0.9, False, 5),
    ("page_crawled", 1, "http://z.com", "fz", None, [], 200, None, None, None, 6),
]


def events(spark):
    rows = [dict(type=t, jid=j, url=u, fingerprint=f, depth=d, links=[dict(url=a, fingerprint=b, host=c, depth=e) for a, b, c, e in links], status_code=s, error=e, score=p, schedule=q, seq=n, ts=dt.datetime(2024, 1, 1, 0, n)) for t, j, u, f, d, links, s, e, p, q, n in EVENTS]
    return spark.createDataFrame([tuple(r.get(x.split()[0]) for x in FIELDS) for r in rows], schema.EVENT)


FIELDS = ["type", "jid", "partition_id", "offset", "url", "fingerprint", "depth", "links", "status_code", "headers", "body", "error", "score", "schedule", "stats", "ts", "seq", "meta", "redirect_urls", "producer_offset", "method", "cookies", "domain_fingerprint"]


def test_metadata_changes(spark):
    got = metadata.links_extracted(events(spark).where("type = 'links_extracted'"))
    assert collected(got, "fingerprint", "url", "depth") == [("f1", "http://a.com/1", 1), ("fb", "http://b.com/", 1)]
    assert collected(metadata.changed_states(events(spark)), "fingerprint", "state") == [("fa", 2), ("fc", 3), ("fd", 1), ("fd", 1), ("fz", 2)]


def test_codec_round_trip_and_broken_messages(spark):
    rows = events(spark)
    messages = log.encoded(rows)
    assert sorted(map(str, log.decoded(messages).collect())) == sorted(map(str, rows.collect()))
    bad = frame(spark, [("k", "{not json"), ("k", '{"type": "unknown"}'), ("k", None), ("k", '{"type": "stats", "stats": {"x": 1.5}}')], "key string, value string")
    assert log.decoded(bad).count() == 1 and log.broken(bad).count() == 3
    assert log.of_job(rows, 0).count() == 6


def test_logs_by_partition(spark, tmp_path):
    rows = log.partitioned(log.encoded(events(spark)).withColumn("fingerprint", F.col("key")), 4).drop("fingerprint")
    log.append(rows, str(tmp_path / "log"))
    log.append(rows, str(tmp_path / "log"))
    assert log.read(spark, str(tmp_path / "log")).count() == 14
    some = rows.where("partition_id = 1").count()
    assert log.read(spark, str(tmp_path / "log"), [1]).count() == 2 * some
    stream = log.stream(spark, str(tmp_path / "log"), [1])
    query = stream.writeStream.format("memory").queryName("read_log").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("read_log").count() == 2 * some


@pytest.mark.parametrize("streamed", [False, True])
def test_strategy_step_as_batch_and_as_stream(spark, tmp_path, streamed):
    store = FrontierStore(spark, str(tmp_path / "store"))
    if streamed:
        log.append(log.encoded(events(spark)).withColumn("partition_id", F.lit(0)), str(tmp_path / "log"))
        source = log.decoded(log.stream(spark, str(tmp_path / "log")))
        assert pipelines.run(source, store, strategies.BreadthFirst(), str(tmp_path / "ck"), 2, jid=0).awaitTermination(120)
    else:
        pipelines.step(events(spark), store, strategies.BreadthFirst(), 2, 0, jid=0)
    assert collected(store.read("states"), "fingerprint", "state") == [("f1", 1), ("fa", 2), ("fb", 1), ("fc", 3), ("fd", 1)]
    assert collected(store.read("queue"), "fingerprint", "score") == [("f1", 0.5), ("fb", 0.5), ("fd", 0.6)]
    got = {r.fingerprint: r for r in store.read("metadata").collect()}
    assert got["fa"].status_code == 200 and got["fc"].error == "Timeout" and got["f1"].depth == 1 and "fz" not in got and got["fe"].score == 0.9
    before = store.epoch
    assert pipelines.step(events(spark), store, strategies.BreadthFirst(), 2, before) == before  # a replayed epoch has no effect
    pipelines.step(events(spark), store, strategies.BreadthFirst(), 2, jid=0)  # the same events again: nothing new to schedule
    assert store.read("queue").count() == 3
    feed = pipelines.feed(store.read("queue"), 3, by_host=True)
    assert feed.count() == 3 and log.decoded(feed).count() == 3


def test_session(spark, tmp_path):
    with FrontierSession(spark, str(tmp_path / "s"), strategies.BreadthFirst(), Settings.of({"MAX_NEXT_REQUESTS": 10, "MAX_REQUESTS": 3, "other": 1, "OTHER": 2})) as s:
        s.add_seeds(frame(spark, [("http://a.com",), ("http://b.com/x?b=1&a=2",), ("http://b.com/x?a=2&b=1",)], "url string"))
        batch = s.get_next_requests()
        assert batch.count() == 2 and s.n_requests == 2 and s.iteration == 1 and not s.finished
        assert s.get_next_requests().count() == 0 and s.iteration == 1
        s.page_crawled(frame(spark, [("http://a.com", 200, dt.datetime(2024, 1, 1), 0)], "url string, status_code int, ts timestamp, seq int"))
        s.links_extracted(frame(spark, [("http://a.com", f"http://a.com/{k % 2}", k) for k in range(4)] + [("http://a.com", "http://b.com/x?a=2&b=1", 9)], "parent_url string, url string, seq int"))
        s.request_error(frame(spark, [("http://b.com/x?a=2&b=1", "Timeout", dt.datetime(2024, 1, 1), 0)], "url string, error string, ts timestamp, seq int"))
        assert collected(s.store.read("queue"), "url", "depth", "score") == [("http://a.com/0", 1, 0.5), ("http://a.com/1", 1, 0.5)]
        assert s.get_next_requests(overused=["a.com"]).count() == 0
        assert s.get_next_requests().count() == 1 and s.finished  # three requests at most
        assert s.get_next_requests().count() == 0
        assert collected(s.store.read("states"), "state") == [(1,), (1,), (2,), (3,)]
    with pytest.raises(RuntimeError):
        s.get_next_requests()
    s.store.clear()
    assert s.store.epoch == -1 and s.store.read("queue").count() == 0


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# list\nhttp://a.com/x\n b.com \n\nhttps://A.com:8080/y\nhttp://a.com/z\n")
    lines = seeds.read(spark, str(tmp_path / "seeds.txt"))
    assert lines.count() == 5
    assert collected(seeds.robots(seeds.completed(lines)), "url", "score") == [("http://a.com/robots.txt", 0.9), ("http://b.com/robots.txt", 0.9), ("https://a.com:8080/robots.txt", 0.9)]


ROBOTS = "# x\nUser-agent: *\nDisallow: /private\nSitemap: /map.xml\nSitemap: http://b.com/m.xml\nsitemap: /no.xml\n"
MAP = "<?xml version='1.0'?><urlset><url><loc> http://a.com/1?x=1&amp;y=2 </loc></url><url><lastmod>2020</lastmod><loc>/2</loc></url><sitemap><loc>http://a.com/sub.xml</loc></sitemap></urlset>"


def test_robots_and_sitemaps(spark):
    files = frame(spark, [("http://a.com/robots.txt", ROBOTS), ("http://b.com/robots.txt", "<html>"), ("http://c.com/robots.txt", None), ("http://d.com/robots.txt", "﻿\n#\nSITEMAP: /x")], "url string, body string")
    assert collected(files.select(robots.valid(F.col("body")).alias("v")), "v") == [(False,), (False,), (True,), (True,)]
    assert collected(robots.sitemaps(files), "url") == [("http://a.com/map.xml",), ("http://b.com/m.xml",)]
    rows = frame(spark, [("http://a.com/private/x", ROBOTS), ("http://a.com/y", ROBOTS), ("http://c.com/private", None)], "url string, rp_body string")
    assert collected(robots.with_allowed(rows, "bot"), "url", "allowed") == [("http://a.com/private/x", False), ("http://a.com/y", True), ("http://c.com/private", True)]
    got = sitemap.parsed(frame(spark, [("http://a.com/map.xml", MAP), ("http://a.com/none", None)], "url string, body string"))
    assert [(r.url, r.is_sitemap) for r in got.orderBy("place").collect()] == [("http://a.com/2", False), ("http://a.com/1?x=1&y=2", False), ("http://a.com/sub.xml", True)]
    html = "<a href='/x'>1</a><A class=\"c\" href=\"y?a&amp;b\">2</A><a href='mailto:x'>3</a><a href=''>4</a><p href='/no'>"
    assert collected(sitemap.page_links(frame(spark, [("http://a.com/d/", html), ("http://b.com", None)], "url string, html string")), "url") == [("http://a.com/d/y?a&b",), ("http://a.com/x",)]


def test_discovery(spark):
    strategy = strategies.Discovery(max_pages=5, interesting=F.col("url").contains("contact"))
    made = [(f"http://a.com/{k}", f"f{k}", "a.com", "a.com", 2, None, False) for k in range(9)] + [("http://a.com/", "fh", "a.com", "a.com", 2, None, False), ("http://a.com/contact", "fi", "a.com", "a.com", 2, None, False), ("http://b.com/", "fb", "b.com", "a.com", 0, None, False), ("http://c.com/", "fc", "c.com", "c.com", 0, "DNSLookupError", False), ("http://d.com/", "fd", "d.com", "d.com", 0, None, True)]
    links = frame(spark, made, "url string, fingerprint string, domain string, parent_domain string, queued_pages int, fatal_error string, banned boolean")
    kept = strategy.filter_links(links)
    assert {r.domain for r in kept.collect()} == {"a.com"}
    got = strategy.links(kept)
    assert got.count() == 3 and {"fh", "fi"} <= {r.fingerprint for r in got.collect()} and all(r.state == schema.QUEUED for r in got.collect())
    files = frame(spark, [("http://a.com/robots.txt", 200, ROBOTS), ("http://b.com/robots.txt", 404, None)], "url string, status_code int, body string")
    maps, homes = strategy.robots_files(files)
    assert {r.url for r in maps.collect()} == {"http://a.com/map.xml", "http://b.com/m.xml"} and [r.url for r in homes.collect()] == ["http://b.com/"]
    many = "".join(f"<url><loc>/p{k}</loc></url>" for k in range(20)) + "".join(f"<sitemap><loc>/s{k}</loc></sitemap>" for k in range(130))
    maps, pages = strategy.sitemap_files(frame(spark, [("http://a.com/map.xml", many, "a.com", 1)], "url string, body string, domain string, queued_pages int"))
    assert maps.count() == 100 and pages.count() == 4
    fatal, homes = strategy.failed(frame(spark, [("http://x.com/robots.txt", "x.com", "DNSLookupError", "robots"), ("http://y.com/map.xml", "y.com", "Timeout", "sitemap"), ("http://y.com/p", "y.com", "Timeout", "other")], "url string, domain string, error string, kind string"))
    assert [r.domain for r in fatal.collect()] == ["x.com"] and [r.url for r in homes.collect()] == ["http://y.com/"]
    to, back = strategy.redirected(frame(spark, [("a.com", "b.com"), ("a.com", "a.com"), ("c.com", "b.com")], "domain string, target string"))
    assert collected(to, "domain") == [("a.com",), ("c.com",)] and collected(back, "domain", "redirect_from") == [("b.com", ["a.com", "c.com"])]


def test_domains(spark):
    table = frame(spark, [("a.com", 3)], "domain string, queued_pages int")
    rows = frame(spark, [("a.com",), ("b.com",), (None,)], "domain string")
    assert collected(domains.with_domain_state(rows, table, {"queued_pages": 0}), "domain", "queued_pages") == [("a.com", 3), ("b.com", 0), (None, 0)]
    assert collected(domains.new_domains(rows, table), "domain") == [("b.com",)]
    odd = frame(spark, [("", "x", 1), ("a" * 256, "x", 1), ("ok", "y" * 20, 1), ("fine", "z", 1)], "domain string, v string, _hidden int")
    assert collected(domains.storable(odd, field_limit=10), "*") == [("fine", "z"), ("ok", None)]
    assert domains.sampled(frame(spark, [(k % 2, k) for k in range(20)], "g int, k int"), 3, "g", "k").count() == 6
    assert collected(domains.collected(frame(spark, [("a", "y"), ("a", "x"), ("a", "x"), ("a", "z")], "domain string, v string"), "v", 2), "v") == [(["x", "y"],)]


def test_statistics(spark):
    offsets = frame(spark, [(2, 50, 100, 1), (2, 20, 100, 2), (3, 0, 100, 3), (4, 120, 100, 4), (4, 90, 100, 2)], "partition_id int, offset long, producer_offset long, seq long")
    assert collected(stats.readiness(offsets, 64), "partition_id", "ready") == [(2, False), (3, True), (4, True)]
    assert collected(stats.lag(frame(spark, [(0, 10), (1, 100)], "partition_id int, offset long"), frame(spark, [(0, 4)], "partition_id int, offset long"), 64), "partition_id", "lag", "ready") == [(0, 6, True), (1, 100, False)]
    assert collected(stats.gaps(frame(spark, [(0, 1), (0, 2), (0, 5), (1, 7)], "partition_id int, seq long")), "partition_id", "seq", "missing") == [(0, 5, 2)]
    assert collected(stats.by_status(frame(spark, [("200",), ("200",), (None,)], "status string"), "status"), "status", "n", "total") == [("200", 2, 0), (None, 1, 0), (None, 3, 1)]
    assert collected(stats.cache(frame(spark, [(True,), (False,), (False,)], "hit boolean"), 2), "*") == [(1, 2, 1 / 3, 1)]
    ticks = frame(spark, [(dt.datetime(2024, 1, 1), 0, "consumed_x", 1.0), (dt.datetime(2024, 1, 1), 0, "other", 2.0)], "ts timestamp, partition_id int, key string, value double")
    assert stats.keyed(ticks).count() == 1
    assert collected(stats.exported(ticks, "sw"), "id", "stats") == [("sw-0-1704067200", {"consumed_x": 1.0, "other": 2.0})]
    messages = frame(spark, [("a", "long message"), ("b", "short"), (None, "x")], "system string, message string")
    assert collected(stats.logged(messages, {"system": ["a"]}, width=8), "message") == [("long ...",), ("x",)]
    assert collected(stats.logged(messages, exclude={"system": ["a"]}), "message") == [("short",), ("x",)]


def test_graph(spark):
    links = graph.site(spark, "http://aaa.com/", 4, 2)
    assert graph.nodes(links).count() == 15 and graph.nodes(graph.site(spark, "c", 5, 2, True)).count() == 31
    assert {r.depth: r.n for r in graph.depths(links, frame(spark, [("http://aaa.com/1",)], "url string")).groupBy("depth").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 2, 2: 4, 3: 8}
    rows = frame(spark, [("a", "200", 0, True, 0), ("b", "Timeout", 0, False, 1), ("a", "500", 1, False, 2), ("c", "301", 0, False, 3), ("d", None, 0, False, 4)], "url string, status string, n_redirects int, is_seed boolean, seq long")
    nodes = graph.pages(rows)
    assert collected(nodes, "id", "url", "status", "is_seed") == [(1, "a", "200", True), (2, "b", "Timeout", False), (3, "c", "301", False), (4, "d", None, False)]
    arcs = graph.edges(frame(spark, [("a", "b"), ("a", "c"), ("a", "b"), ("a", "zz")], "parent string, child string"), nodes)
    assert collected(arcs, "parent_id", "child_id") == [(1, 2), (1, 3)] and collected(graph.links_of(nodes, arcs), "url", "links") == [("a", ["b", "c"])]
    assert collected(graph.kinds(nodes), "url", "is_error", "is_redirect") == [("a", False, False), ("b", True, False), ("c", False, True), ("d", False, False)] and graph.seeds(nodes).count() == 1
    seen, into = graph.recorded(frame(spark, [("a", "200", None, 0), ("b", None, "a", 1), ("c", None, "a", 2), ("c", "404", None, 3)], "url string, status string, parent string, seq long"))
    assert collected(seen, "url", "status") == [("a", "200"), ("c", "404")] and collected(into, "parent", "child") == [("a", "c")]
    assert [r.line for r in graph.dot(frame(spark, [("a", 'b"')], "parent string, child string")).collect()] == ["digraph {", '  "a" -> "b\\"";', "}"]
    assert collected(graph.degrees(frame(spark, [("a", "b"), ("a", "b"), ("c", "b")], "parent string, child string")), "*") == [("a", 1, 0), ("b", 0, 2), ("c", 1, 0)]


def test_row_numbers(spark):
    rows = frame(spark, [((k * 7919) % 1000, str(k)) for k in range(1000)], "a int, b string").repartition(7)
    assert [r.n for r in order.numbered(rows, "a", name="n").orderBy("a").collect()] == list(range(1, 1001))
    assert order.numbered(rows.limit(0), "a").count() == 0


def tree(depth, own=False):
    out, level = [], ["1"]
    for _ in range(depth - 1):
        for p in level:
            out.append((p, ([p] if own else []) + [p + "1", p + "2"]))
        level = [c for p in level for c in (p + "1", p + "2")]
    return out


ORDER = "1 11 12 111 112 121 122 1111 1112 1121 1122 1211 1212 1221 1222"
LATE_FIRST = {1: "1 12 122 1222 1221 121 1212 1211 11 112 1122 1121 111 1112 1111", 2: "1 12 11 112 111 1112 1111 1122 1121 122 121 1212 1211 1222 1221"}
DEEP_FIRST = {1: "1 11 111 1111 1112 112 1121 1122 12 121 1211 1212 122 1221 1222"}


@pytest.mark.parametrize("strategy,by,n,want", [("basic", "fifo", 10, ORDER), ("breadth_first", "score_desc", 5, ORDER), ("basic", "lifo", 2, LATE_FIRST[2]), ("basic", "lifo", 1, LATE_FIRST[1]), ("depth_first", "score_desc", 1, DEEP_FIRST[1])])
def test_crawl_orders(spark, strategy, by, n, want):
    assert simulate.run(spark, tree(4), ["1"], strategy=strategy, order=by, max_next=n) == want.split()


def test_crawl_with_a_rate_and_loops(spark):
    got = simulate.run(spark, [("a/1", ["a/2", "a/1", "b/1"]), ("a/2", ["a/1"]), ("b/1", ["a/2"])], ["a/1"], max_next=5, rate=1)
    assert sorted(got) == ["a/1", "a/2", "b/1"]
    assert simulate.run(spark, [], ["x"]) == ["x"]


def test_events_counted_in_a_stream_as_in_a_table(spark, tmp_path):
    rows = events(spark).select("type", "ts")
    rows.write.parquet(str(tmp_path / "e"))
    stream = pipelines.counted(spark.readStream.schema("type string, ts timestamp").parquet(str(tmp_path / "e")), 120)
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert collected(spark.table("counted"), "*") == collected(pipelines.counted(rows, 120), "*")
