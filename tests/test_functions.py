"""Fingerprints, URLs, scores: published values."""

import zlib
from hashlib import md5, sha1
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from linkloom.functions import hashing, scoring, urls
from linkloom.operators import enrich

NEWS = "https://News.example.org/find?url=top.example.net/2015/1&lang=ru#part"


def values(spark, inputs, *columns):
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, x string")
    return [tuple(r) for r in df.orderBy("n").select(*columns).collect()]


def test_fingerprints(spark):
    x, inputs = F.col("x"), [NEWS, "TestString", "http://www.example.com/some/page倀/", "http://a.com/x;p?q#f"]
    for url, got in zip(inputs, values(spark, inputs, hashing.sha1(x), hashing.md5(x), hashing.host_local(x))):
        u = urlparse(url)
        whole = f"{u.hostname or '-'}{u.path};{u.params}{u.query}{u.fragment}".encode()
        assert got == (sha1(url.encode()).hexdigest(), md5(url.encode()).hexdigest(), f"{zlib.crc32((u.hostname or '-').encode()):08x}{md5(whole).hexdigest()}")
    assert values(spark, ["TestString"], hashing.host_local(x)) == [("97ddb3f898d2460d60d3f4d6cb7dbc5d0b8025f8",)]
    got = values(spark, ["http://test.com/someurl", "http://a.com"], hashing.sha1(urls.canonical(x)))
    assert got == [("955ac04f1b1a96de60a5139ad90c80be87822159",), (sha1(b"http://a.com/").hexdigest(),)]


def test_crc_is_signed_and_partitions_are_not(spark):
    names = ["example", "example倀", "1", *[f"host{k}.com" for k in range(200)]]
    got = values(spark, names, hashing.signed_crc32(F.col("x")), *[hashing.crc_partition(F.col("x"), n) for n in (2, 3, 5)])
    assert [r[0] for r in got[:3]] == [1861000095, 1259721235, -2082672713]
    for name, (crc, *parts) in zip(names, got):
        want = zlib.crc32(name.encode())
        want -= (want >= 1 << 31) << 32
        assert crc == want and parts == [want % n for n in (2, 3, 5)]
    assert values(spark, [None], hashing.crc_partition(F.col("x"), 7), hashing.fingerprint_partition(F.col("x"), 7)) == [(0, 0)]
    assert values(spark, ["www.example.com", "example.com", "knuthellan.com", "hellan.me"], hashing.crc_partition(F.col("x"), 2)) == [(1,), (1,), (0,), (1,)]
    assert values(spark, ["1be68ff556fd0bbe5802d1a100850da29f7f15b11"], hashing.crc_partition(F.col("x"), 5)) == [(3,)]


ODD = ["http://me:secret@www.example.com:8080/do/it?b=2&a=1#part", "http://www.example.com", "HTTP://A_b.Example.com/x y|z", "http://bücher.de/ä?q", "mailto:x@y", "//h/p", "/p;x=1?y", "", "a/b;c/d;e", "http://h?q#f"]


def test_url_parts_are_those_of_the_standard_library(spark):
    got = values(spark, ODD, urls.parts(F.col("x")), urls.host(F.col("x")))
    for url, (parts, host) in zip(ODD, got):
        want = urlparse(url)
        assert (parts.scheme, parts.netloc, parts.query, parts.fragment) == (want.scheme, want.netloc, want.query, want.fragment)
        if want.scheme in ("http", ""):
            assert (parts.path, parts.params) == (want.path, want.params)
        if want.scheme == "http":
            assert host == want.hostname


@pytest.mark.parametrize("base", ["http://a.com/b/c?d=1#e", "http://a.com", "https://a.com/b/"])
def test_join_is_that_of_the_standard_library(spark, base):
    links = ["http://x.org/y", "//x.org/y", "/y/z", "y/z", "./y", "../y", "?q=1", "#f", "", "y.html?x#z"]
    got = values(spark, links, urls.join(F.lit(base), F.col("x")))
    assert [r[0] for r in got] == [urljoin(base, link) for link in links]


def test_canonical(spark):
    got = values(spark, ["HTTP://Example.COM?b=2&a=1#x", "http://a.com/B/?", "http://a.com/x;p?z&y"], urls.canonical(F.col("x")))
    assert got == [("http://example.com/?a=1&b=2",), ("http://a.com/B/",), ("http://a.com/x;p?y&z",)]


def test_domains(spark):
    full = lambda *inputs: [tuple(r[0]) for r in values(spark, inputs, enrich.domain(F.col("x"), full=True))]
    assert full(ODD[0], "http://www.example", "www.example.com") == [("www.example.com", "example.com", "http", "example", "com", "www"), ("www.example", "example", "http", "example", "", "www"), ("www.example.com", "example.com", "", "example", "com", "www")]
    assert [d[1] for d in full("http://www.london.co.uk/", "http://images.site.ru", "http://t.co", "http://co.uk/")] == ["london.co.uk", "site.ru", "t.co", "co.uk"]
    fast = values(spark, [ODD[0]], enrich.domain(F.col("x")))
    assert tuple(fast[0][0]) == ("me:secret@www.example.com:8080", "www.example.com", "http", "", "", "")


def test_home_pages(spark):
    got = values(spark, ["http://a.com", "http://a.com/", "http://a.com/index.html", "http://a.com/?q", "http://a.com/x"], urls.is_home(F.col("x")))
    assert [r[0] for r in got] == [True, True, True, False, False]


def test_scores(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "d int").orderBy("d")
    assert [tuple(r) for r in df.select(scoring.breadth_first(F.col("d")), scoring.depth_first(F.col("d"))).collect()] == [(1.0, 0.0), (1 - 1 / 2, 1 / 2), (1 - 2 / 3, 2 / 3), (1 - 3 / 4, 3 / 4)]
    marks = [0.0, 0.005, 0.1, 0.11, 0.29, 0.57, 0.9, 1.0, -0.1, 1.1, None]
    got = spark.createDataFrame(list(enumerate(marks)), "n int, s double").orderBy("n").select(scoring.bucket(F.col("s"))).collect()

    def want(s):
        if s is None or not 0 <= s <= 1:
            return None
        i = int(s / 0.01)
        return i - 1 if i % 10 == 0 and i > 0 else i

    assert [r[0] for r in got] == [want(s) for s in marks]
    rows = spark.createDataFrame([(f"h{k}.com",) for k in range(300)], "h string").select("h", scoring.host_jitter(F.lit(0.9), F.col("h")).alias("s"), scoring.host_jitter(F.lit(0.9), F.col("h"), signed=False).alias("u")).collect()
    for r in rows:
        crc = zlib.crc32(r.h.encode())
        signed = abs(crc - ((crc >= 1 << 31) << 32))
        assert r.s == pytest.approx(int(signed / 2147483647 * 10) / 10 + 0.089) and r.u == pytest.approx(int(crc / 2147483647 * 10) / 10 + 0.089)
    assert max(r.s for r in rows) < 1.1 < max(r.u for r in rows)
