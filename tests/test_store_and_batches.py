"""The store under crashes, what a commit costs, many links on a page, discovery end to end, the batch generator, fetchers."""

import datetime as dt
import random
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from linkloom import add_seeds, schema
from linkloom.functions import urls
from linkloom.operators import graph, queue
from linkloom.plans import simulate, strategies
from linkloom.plans.session import FrontierSession
from linkloom.plans.settings import Settings
from linkloom.sources import convert, robots
from linkloom.sources import events as log
from linkloom.sources.store import FrontierStore
from linkloom.streaming import batches, fetchers, pipelines


def frame(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def event_rows(spark, rows):
    fields = [f.name for f in spark.createDataFrame([], schema.EVENT).schema]
    return spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], schema.EVENT)


def states(spark, *rows):
    return frame(spark, rows, "fingerprint string, state int, seq long")


def test_a_crash_at_any_file_operation_leaves_an_epoch_whole(spark, tmp_path):
    class Crash(Exception):
        pass

    class Crashing(FrontierStore):
        left = 10**9

        def _tick(self):
            self.left -= 1
            if self.left < 0:
                raise Crash

        def _file(self, name):
            self._tick()
            return super()._file(name)

        def _write(self, *a):
            self._tick()
            out = super()._write(*a)
            self._tick()
            return out

        def _delete(self, name):
            self._tick()
            super()._delete(name)

    path = str(tmp_path / "store")
    FrontierStore(spark, path, compact_after=2, keep=1).commit({"states": [("put", states(spark, ("a", 1, 0)))]})
    done = 0
    for budget in range(60):
        store = Crashing(spark, path, compact_after=2, keep=1)
        store.left = budget
        seq = 10 + budget
        try:
            store.commit({"states": [("put", states(spark, ("a", seq % 4, seq), (f"b{budget}", 1, seq)))], "offsets": [("put", frame(spark, [(0, seq, seq, seq)], schema.OFFSETS))]})
            done += 1
        except Crash:
            pass
        seen = FrontierStore(spark, path)
        rows = {r.fingerprint: r for r in seen.read("states").collect()}
        a = rows["a"].seq
        assert rows["a"].state == (a % 4 if a else 1)
        assert not a or (f"b{a - 10}" in rows and seen.read("offsets").first().offset == a)  # both tables of one epoch, or neither
        if done == 4:
            break
    assert done == 4


def test_a_commit_writes_what_changes(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "store"))
    many = spark.range(5000).select(F.col("id").cast("string").alias("fingerprint"), F.lit(1).alias("state"), F.lit(0).cast("long").alias("seq"))
    store.commit({"states": [("put", many)]})
    before = set((tmp_path / "store" / "states").iterdir())
    store.commit({"states": [("put", states(spark, *((str(k), 2, 1) for k in range(64))))]})
    fresh = set((tmp_path / "store" / "states").iterdir()) - before
    assert sum(spark.read.parquet(str(x)).count() for x in fresh) == 64
    assert store.read("states").count() == 5000 and store.read("states").where("state = 2").count() == 64
    assert collected(store.lookup("states", frame(spark, [("3",), ("4999",), ("x",)], "fingerprint string")), "fingerprint", "state") == [("3", 2), ("4999", 1)]
    for k in range(20):  # beyond compact_after
        store.commit({"states": [("put", states(spark, ("n" + str(k), 1, k)))]})
    assert len(store.manifest()["tables"]["states"]["put"]) <= 17 and store.read("states").count() == 5020
    store.clear()
    assert store.epoch == -1


def test_links_of_one_place_in_the_order_are_all_handed_out(spark, tmp_path):
    with FrontierSession(spark, str(tmp_path / "s"), strategies.BreadthFirst()) as s:
        s.add_seeds(frame(spark, [("http://a.com/",)], "url string"))
        assert s.get_next_requests(5).count() == 1
        s.links_extracted(frame(spark, [("http://a.com/", f"http://h{k}.com/", 0) for k in range(5)], "parent_url string, url string, seq int"))
        got = [s.get_next_requests(1).collect() for _ in range(5)]
        assert sorted(b[0].url for b in got) == [f"http://h{k}.com/" for k in range(5)] and all(len(b) == 1 for b in got)
        assert s.store.read("queue").count() == 0
    rows = frame(spark, [(1, "f1", 0), (1, "f2", 0), (2, "f3", 0)], "id long, fingerprint string, partition_id int")
    assert collected(queue.remaining(rows, rows.where("fingerprint = 'f1'")), "fingerprint") == [("f2",), ("f3",)]


def test_a_page_of_many_links(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "store"))
    links = [dict(url=f"http://a.com/{k}", fingerprint=f"f{k}", host="a.com", depth=None) for k in range(70_000)]
    two = [dict(url=f"http://b.com/{k}", fingerprint=f"g{k}", host="b.com", depth=None) for k in range(3)]
    pipelines.step(event_rows(spark, [dict(type="links_extracted", url="http://a.com/", fingerprint="fa", depth=0, seq=0, links=links), dict(type="links_extracted", url="http://b.com/", fingerprint="fb", depth=0, seq=1, links=two)]), store, strategies.Basic(), 2)
    rows = store.read("queue")
    assert rows.count() == 70_003 == rows.select("id").distinct().count()
    assert rows.where("host = 'a.com'").agg(F.max("created_at")).first()[0] < rows.where("host = 'b.com'").agg(F.min("created_at")).first()[0]


def test_jobs_offsets_and_statistics(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "store"))
    score = lambda k, jid, seq: dict(type="update_score", url=f"http://{k}.com", fingerprint=k, score=0.5, schedule=True, jid=jid, seq=seq)
    pipelines.step(event_rows(spark, [score("a", 1, 0), score("b", 2, 1), dict(type="new_job_id", jid=2, seq=2), score("c", 2, 3), score("d", 1, 4), dict(type="offset", jid=2, partition_id=3, offset=5, producer_offset=90, seq=5), dict(type="stats", jid=2, partition_id=3, stats={"x": 2.0}, ts=dt.datetime(2024, 1, 1), seq=6)]), store, strategies.Basic(), 1, jid=1)
    assert collected(store.read("queue"), "fingerprint") == [("a",), ("c",)] and store.jid == 2
    assert collected(store.read("offsets"), "*") == [(3, 5, 90, 5)] and collected(store.read("stats"), "partition_id", "key", "value") == [(3, "x", 2.0)]
    pipelines.step(event_rows(spark, [score("e", 1, 7), score("f", 2, 8)]), store, strategies.Basic(), 1, jid=1)
    assert collected(store.read("queue"), "fingerprint") == [("a",), ("c",), ("f",)]


ROBOTS = "User-agent: *\nDisallow: /private\nSitemap: /map.xml\n"
MAP = "<urlset>" + "".join(f"<url><loc>http://a.com/p{k}</loc></url>" for k in range(4)) + "<url><loc>http://a.com/private/x</loc></url><sitemap><loc>/sub.xml</loc></sitemap></urlset>"


def test_discovery_through_a_session(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    with FrontierSession(spark, str(tmp_path / "s"), strategies.Discovery(max_pages=6)) as s:
        s.add_seeds(frame(spark, [("a.com",), ("http://www.a.com/x",), ("http://gone.com/",), ("http://old.com/",)], "url string"))
        batch = s.get_next_requests(20)
        assert {r.url for r in batch.collect()} == {"http://a.com/robots.txt", "http://www.a.com/robots.txt", "http://gone.com/robots.txt", "http://old.com/robots.txt"}
        assert {r.meta["kind"] for r in batch.collect()} == {"robots"}
        s.page_crawled(frame(spark, [("http://a.com/robots.txt", 200, bytearray(ROBOTS.encode()), ts, 0)], "url string, status_code int, body binary, ts timestamp, seq int"))
        s.request_error(frame(spark, [("http://gone.com/robots.txt", "DNSLookupError", ts, 0), ("http://www.a.com/robots.txt", "Timeout", ts, 1)], "url string, error string, ts timestamp, seq int"))
        # A home page of old.com that leads to new.com: its domain is the one it led to.
        s.page_crawled(frame(spark, [("http://new.com/robots.txt", 404, ["http://old.com/robots.txt", "http://new.com/robots.txt"], ts, 0)], "url string, status_code int, redirect_urls array<string>, ts timestamp, seq int"))
        got = {r.url: r for r in s.get_next_requests(20).collect()}
        assert set(got) == {"http://a.com/map.xml", "http://a.com/", "http://www.a.com/", "http://new.com/"}
        assert got["http://a.com/map.xml"].meta == {"kind": "sitemap"} and got["http://a.com/map.xml"].score > got["http://a.com/"].score
        table = {r.domain: r for r in s.store.read("domains").collect()}
        assert table["gone.com"].fatal_error == "DNSLookupError" and table["a.com"].queued_pages == 3 and not table["a.com"].rp_rules  # the later file failed
        assert table["old.com"].redirect_to == ["new.com"] and table["new.com"].redirect_from == ["old.com"]
        s.page_crawled(frame(spark, [("http://a.com/map.xml", 200, bytearray(MAP.encode()), ts, 0)], "url string, status_code int, body binary, ts timestamp, seq int"))
        found = {r.url for r in s.get_next_requests(20).collect()}
        assert "http://a.com/sub.xml" in found and len(found) == 4  # the sitemap, and three pages: a budget of six
        s.links_extracted(frame(spark, [("http://new.com/", "http://b.new.com/q", 0), ("http://new.com/", "http://other.com/", 1), ("http://gone.com/", "http://gone.com/y", 2), ("http://a.com/", "http://a.com/more", 3)], "parent_url string, url string, seq int"))
        assert [r.url for r in s.get_next_requests(20).collect()] == ["http://b.new.com/q"]
        table = {r.domain: r for r in s.store.read("domains").collect()}
        assert table["new.com"].subdomains == ["b.new.com"] and table["new.com"].queued_pages == 2 and table["gone.com"].fatal_error == "DNSLookupError"


def test_discovery_keeps_to_robots_files(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "store"))
    strategy = strategies.Discovery(max_pages=9)
    pipelines.step(event_rows(spark, [dict(type="page_crawled", url="http://a.com/robots.txt", fingerprint="r", status_code=200, body=bytearray(ROBOTS.encode()), seq=0, meta={"kind": "robots", "seed": "a.com"})]), store, strategy, 1)
    links = [dict(url=u, fingerprint=None, host=None, depth=None) for u in ("http://a.com/private/1", "http://a.com/open", "http://x.a.com/%70rivate")]
    pipelines.step(event_rows(spark, [dict(type="links_extracted", url="http://a.com/", fingerprint="h", depth=0, links=links, seq=1)]), store, strategy, 1)
    assert {r.url for r in store.read("queue").collect()} == {"http://a.com/map.xml", "http://a.com/", "http://a.com/open"}
    row = store.read("domains").first()
    assert row.seed == "a.com" and row.rp_body == ROBOTS and row.queued_pages == 3


def test_robots_rules_against_the_standard_library(spark):
    body = "User-agent: linkloom\nAllow: /a/b\nDisallow: /a\nDisallow: /q?x=1\nDisallow: /%C3%A9\n\nUser-agent: *\nDisallow: /\n"
    pick = random.Random(3)
    paths = ["", "/", "/a", "/a/b/c", "/ab", "/q?x=1&y", "/q?x=2", "/é", "/%c3%a9/x", "/%61", "/b#f"] + ["/" + "".join(pick.choice("ab/?=%x1") for _ in range(6)).replace("%", "%41") for _ in range(200)]
    for agent in ("linkloom", "other"):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        parser.modified()
        rows = [(f"http://h.com{p}", body) for p in paths] + [("http://h.com/a", None)]
        for r in robots.with_allowed(frame(spark, rows, "url string, rp_body string"), agent).collect():
            assert r.allowed == (True if r.rp_body is None else parser.can_fetch(agent, r.url)), (agent, r.url)


def test_joined_links_against_the_standard_library(spark):
    pick = random.Random(1)
    bases = ["http://a.com", "http://a.com/", "http://a.com/b/c/d", "http://a.com/b/c/", "http://a.com/b/c/d?q=1", "https://u@a.com:8/x/y.html?z#f"]
    links = ["", "#f", "?q", "//h/p", "http://o.com/../x", "..", ".", "../../x", "e/../x", "/e/../x", "./", "x/..", "/", "x?y=../z", "../../../../x"]
    links += ["/".join(pick.choice(["..", ".", "x", "y.z", "", "..."]) for _ in range(pick.randint(2, 6))) + pick.choice(["", "?a=1", "#z", "?a#b"]) for _ in range(300)]
    rows = [(b, u) for b in bases for u in links if u.split("?")[0].split("#")[0] != "//"]
    for r in frame(spark, rows, "base string, link string").withColumn("got", urls.join(F.col("base"), F.col("link"))).collect():
        assert r.got == urljoin(r.base, r.link), r
    same = [("http://A.com/%7euser/%2fx?b=2&a=1&a-b=0", "http://a.com/~user/%2Fx?a=1&a-b=0&b=2"), ("http://a.com/a b/é?q=x y&p=%c3%a9", "http://a.com/a%20b/%C3%A9?p=%C3%A9&q=x+y"), ("http://a.com/100%#f", "http://a.com/100%25")]
    assert all(r.a == r.b for r in frame(spark, same, "u string, b string").select(urls.canonical(F.col("u")).alias("a"), "b").collect())
    own = urls.suffix_list(["// comment", "com", "a.b.test", "*.ck", "!www.ck", ""])
    assert own == ("a.b.test",) and frame(spark, [("x.y.a.b.test",)], "n string").select(urls.registered_domain(F.col("n"), own)).first()[0] == "y.a.b.test"


def test_busy_hosts_wait_and_are_purged(spark, tmp_path):
    settings = Settings(overused_max_per_key=3, overused_keep_per_key=2)
    with FrontierSession(spark, str(tmp_path / "s"), strategies.Basic(), settings) as s:
        s.add_seeds(frame(spark, [(f"http://a.com/{k}",) for k in range(3)] + [("http://b.com/",)], "url string"))
        assert [r.url for r in s.get_next_requests(10, overused=["A.com"]).collect()] == ["http://b.com/"]
        assert s.store.read("queue").count() == 0 and s.store.read("pending").count() == 3
        assert s.get_next_requests(10, overused=["a.com"]).count() == 0
        assert s.get_next_requests(1).count() == 1 and s.store.read("pending").count() == 2
        s.add_seeds(frame(spark, [(f"http://a.com/{k}",) for k in range(10, 14)], "url string"))
        s.get_next_requests(10, overused=["a.com"])
        assert s.store.read("pending").count() == 2  # purged
        assert s.get_next_requests(10).count() == 2 and s.store.read("pending").count() == 0


def test_limits_blacklist_and_revisits(spark, tmp_path):
    settings = Settings(max_requests=3, spider_feed_partitions=4, domains_blacklist=("Bad.com",), revisit_interval=dt.timedelta(days=1), store_content=True)
    with FrontierSession(spark, str(tmp_path / "s"), strategies.Basic(), settings) as s:
        s.add_seeds(frame(spark, [(f"http://h{k}.com/",) for k in range(8)] + [("http://bad.com/",)], "url string"))
        assert s.get_next_requests(2).count() <= 3 and s.get_next_requests(9).count() + 0 <= 3 and s.n_requests == 3 and s.finished
        assert s.store.read("queue").where("host = 'bad.com'").count() == 1
        s.page_crawled(frame(spark, [("http://h1.com/", 200, bytearray(b"x"), dt.datetime(2024, 1, 1), 0), ("http://h2.com/", 200, None, dt.datetime(2024, 1, 3), 1)], "url string, status_code int, body binary, ts timestamp, seq int"))
        assert {bytes(r.content) for r in s.store.read("metadata").where("content is not null").collect()} == {b"x"}
        assert s.store.read("metadata").where("url = 'http://h1.com/'").first().domain_fingerprint is not None
        n = s.store.read("queue").count()
        assert s.revisit(F.lit("2024-01-02 12:00:00").cast("timestamp")) == 1 and s.store.read("queue").count() == n + 1
        assert s.revisit(F.lit("2024-01-02 12:00:00").cast("timestamp")) == 0


def test_batch_generator_and_fetcher(spark, tmp_path):
    store, feed, logs = FrontierStore(spark, str(tmp_path / "store")), str(tmp_path / "feed"), str(tmp_path / "log")
    settings = Settings(max_next_requests=2, spider_feed_partitions=2, queue_hostname_partitioning=True, domains_blacklist=("bad.com",), new_batch_delay=1.0, delay_on_empty=2.0)
    rows = [dict(type="update_score", url=f"http://{h}/{k}", fingerprint=f"{h}{k}", score=0.9 if h == "bad.com" else 0.5, schedule=True, seq=k) for h in ("www.example.com", "www.scrapy.test", "bad.com") for k in range(3)]
    pipelines.step(event_rows(spark, rows + [dict(type="new_job_id", jid=5, seq=9)]), store, strategies.Basic(), 2, jid=0)
    assert store.read("queue").count() == 0  # all of them are of no job
    pipelines.step(event_rows(spark, [r | {"jid": 5} for r in rows]), store, strategies.Basic(), 2, jid=0)
    parts = {r.partition_id for r in store.read("queue").collect()}
    first = batches.tick(store, feed, settings)
    assert sum(first.values()) <= 4 and store.read("queue").count() == 9 - 2 * len(parts)
    fetcher = fetchers.Fetcher(spark, feed, logs, partition=sorted(first)[0], jid=5) if first else None
    if fetcher:
        got = fetcher.get_next_requests().collect()
        assert got and all(r.jid == 5 and r.type == "request" for r in got) and fetcher.get_next_requests().count() == 0
        fetcher.offset(0, 100, 50)
        fetcher.stats({"fetched": 3}, "2024-01-01 00:00:00", 51)
        fetcher.page_crawled(frame(spark, [(got[0].url, got[0].fingerprint, 200, 52)], "url string, fingerprint string, status_code int, seq long"))
        pipelines.step(log.decoded(log.read(spark, logs)), store, strategies.Basic(), 2, jid=0)
        assert store.read("states").where("state = 2").count() == 1 and store.read("stats").count() == 1
    waits = []

    class Clock:
        time = staticmethod(lambda: 10**9)
        sleep = staticmethod(waits.append)

    batches.run(store, feed, settings, ticks=6, clock=Clock)
    assert store.read("queue").count() == 0 and waits[-1] == 2.0
    busy = frame(spark, [(0, 1, 100, 1), (1, 90, 100, 1)], schema.OFFSETS)
    some = frame(spark, [(0,), (1,), (2,), (3,)], "partition_id int")
    assert collected(batches.ready(some, busy, 64, [0, 1, 2]), "partition_id") == [(1,), (2,)]
    assert batches.sent(spark, feed).agg(F.sum("n")).first()[0] == 6


def test_seeds_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "seeds.txt").write_text("http://a.com/\nhttp://b.com/\nhttp://a.com/\n")
    add_seeds.add(spark, str(tmp_path / "store"), str(tmp_path / "seeds.txt"), "breadth_first")
    assert collected(FrontierStore(spark, str(tmp_path / "store")).read("queue"), "url", "depth") == [("http://a.com/", 0), ("http://b.com/", 0)]
    assert add_seeds.main(["x"]) == 2 and "STORE" in capsys.readouterr().err


@pytest.mark.parametrize("tool", ["plain", "http", "scraper"])
def test_converters_round_trip(spark, tool):
    ours = frame(spark, [("http://a.com", "POST", {"h": ["1", "2"]}, {"k": "v"}, 200, "more")], "url string, method string, headers map<string,array<string>>, meta map<string,string>, status_code int, other string")
    theirs = convert.from_frontier(ours, tool)
    assert theirs.first().headers == {"h": "1, 2"} and "other" in theirs.columns
    back = convert.to_frontier(theirs.withColumn("method", F.lower("method")), tool).first()
    assert back.method == "POST" and back.headers == {"h": ["1, 2"]} and back.meta == {"k": "v"} and back.status_code == 200
    assert convert.to_frontier(frame(spark, [("u",)], "url string")).first().method == "GET"


def test_sample_sites_are_crawled_whole(spark):
    sites = graph.samples(spark)
    assert len(sites) == 9
    for name in ("pair", "shared", "loop", "hosts"):
        links = sites[name].withColumn("place", F.substring("child", -1, 1).try_cast("int"))
        pages = {r.url for r in graph.nodes(links).collect()}
        got = simulate.crawl(links, frame(spark, [], "url string, place int"), add_all=True, max_next=50).collect()
        assert {r.url for r in got} == pages and len(got) == len(pages)
    taken, busy = simulate.fetched(frame(spark, [(k, "a" if k < 4 else "b", k) for k in range(5)], "id long, host string, created_at long"), 2)
    assert collected(taken, "id") == [(0,), (1,), (4,)] and collected(busy, "host", "waiting") == [("a", 2)]


@pytest.mark.parametrize("by", ["score_desc", "score_asc", "fifo", "lifo", "bucket_desc", "random"])
def test_batches_of_many_hosts_against_a_sort(spark, by):
    pick = random.Random(5)
    rows = frame(spark, [(k, pick.randrange(2), f"h{pick.randrange(12)}", pick.choice([None, 0.1, 0.15, 0.9, pick.random()]), pick.choice([None, pick.randrange(5)])) for k in range(300)], "id long, partition_id int, host string, score double, created_at long")
    for n, hosts in ((3, 5), (20, 2), (1, 50)):
        fast = queue.next_batch(rows, n, by=by, min_hosts=hosts)
        slow = queue.next_batch(rows, n, by=queue.order(by), min_hosts=hosts)
        assert collected(fast, "id", "place") == collected(slow, "id", "place")
