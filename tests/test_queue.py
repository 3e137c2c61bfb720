"""Scheduling, batches and what remains."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import hashing
from linkloom.operators import overused, queue

NOW = 1_700_000_000
A, B, C = (1.0, "knuthellan.com"), (0.1, "khellan.com"), (0.5, "hellan.me")


def rows(spark, items, partitions=1, at=NOW - 10):
    """(score, host[, crawl_at]) as a queue."""
    made = [(k, float(s), h, rest[0] if rest else at, k) for k, (s, h, *rest) in enumerate(items)]
    df = spark.createDataFrame(made, "id long, score double, host string, crawl_at long, created_at long")
    return df.withColumn("partition_id", hashing.crc_partition(F.col("host"), partitions))


def batch(df, n, **options):
    got = queue.next_batch(df, n, now=NOW, **options)
    return [r.host for r in got.orderBy("partition_id", "place").collect()], queue.remaining(df, got)


FUTURE = NOW + 86_400
CASES = {
    "all": ([A, B, C], 1, dict(n=5, max_per_host=5), ["knuthellan.com", "hellan.me", "khellan.com"], 0),
    "top1": ([A, B, C], 1, dict(n=1, max_per_host=5), ["knuthellan.com"], 2),
    "top2": ([A, B, C], 1, dict(n=2, max_per_host=5), ["knuthellan.com", "hellan.me"], 1),
    "split": ([A, B, C], 2, dict(n=5, max_per_host=5), ["knuthellan.com", "khellan.com", "hellan.me"], 0),
    "future": ([(*A, FUTURE), (*B, FUTURE), (*C, FUTURE)], 1, dict(n=5), [], 3),
    "mix": ([(*A, FUTURE), B, (*C, FUTURE)], 1, dict(n=5), ["khellan.com"], 2),
    "conflict": ([(0.9, f"h{k}.com", FUTURE) for k in range(5)] + [B], 1, dict(n=2), ["khellan.com"], 5),
    "min_hosts": ([A, B, C], 2, dict(n=1, min_hosts=2, partitions=[0]), ["knuthellan.com", "khellan.com"], 1),
    "min_hosts too high": ([A, B, C], 2, dict(n=1, min_hosts=5, partitions=[0]), ["knuthellan.com", "khellan.com"], 1),
    "few": ([A], 2, dict(n=1, min_hosts=2, partitions=[0]), ["knuthellan.com"], 0),
    "host cap": ([A, (0.99, A[1]), (0.98, A[1]), B], 1, dict(n=5, max_per_host=2), ["knuthellan.com"] * 2 + ["khellan.com"], 1),
    "host cap, inclusive": ([A, (0.99, A[1]), (0.98, A[1]), B], 1, dict(n=5, max_per_host=2, inclusive_cap=True), ["knuthellan.com"] * 3 + ["khellan.com"], 0),
    "no host": ([(0.3, None), (0.2, None)], 1, dict(n=5, max_per_host=1), [None], 1),
    "empty": ([], 1, dict(n=5), [], 0),
}


@pytest.mark.parametrize("name", CASES)
def test_batches(spark, name):
    items, partitions, options, want, left = CASES[name]
    options = dict(options)
    got, rest = batch(rows(spark, items, partitions), options.pop("n"), **options)
    assert got == want and rest.count() == left


def test_repeated_batches_drain_each_partition(spark):
    df, seen = rows(spark, [A, B, C], 2), []
    for p in (0, 1, 0, 1, 0):
        got, df = batch(df, 1, partitions=[p])
        seen.append(got)
    assert seen == [["knuthellan.com"], ["hellan.me"], ["khellan.com"], [], []] and df.count() == 0


@pytest.mark.parametrize("order,want", [("score_desc", [0, 2, 3, 1]), ("score_asc", [1, 2, 3, 0]), ("fifo", [0, 1, 2, 3]), ("lifo", [3, 2, 1, 0])])
def test_orders(spark, order, want):
    df = rows(spark, [(0.9, "a"), (0.1, "b"), (0.5, "c"), (0.5, "d")])
    assert [r.id for r in queue.next_batch(df, 9, by=order).orderBy("place").collect()] == want
    assert {r.id for r in queue.next_batch(df, 9, by="random").collect()} == {0, 1, 2, 3}


def test_scheduling(spark):
    made = [("http://a.com/x", 0.5, True, None), ("http://a.com/y", 1.5, True, None), ("http://b.com/", 0.7, False, None), ("no host", 0.2, True, 77), ("http://c.com", None, True, None)]
    df = spark.createDataFrame(made, "url string, score double, schedule boolean, crawl_at long")
    got = {r.url: r for r in queue.scheduled(df, 4, NOW).collect()}
    assert set(got) == {"http://a.com/x", "no host"} and (got["no host"].partition_id, got["no host"].host_crc32, got["no host"].crawl_at) == (0, 0, 77) and got["http://a.com/x"].crawl_at == NOW
    assert {r.url for r in queue.quarantined(df).collect()} == {"http://a.com/y", "http://c.com"}
    slots = queue.scheduled(df.withColumn("slot", F.lit("s.org")), 4).select("partition_id").distinct().collect()
    assert [r[0] for r in slots] == [r[0] for r in spark.range(1).select(hashing.crc_partition(F.lit("s.org"), 4)).collect()]


def test_nothing_is_lost_or_doubled(spark):
    df = rows(spark, [((k * 37 % 100) / 100, f"h{k % 17}.com") for k in range(500)], 3)
    got = queue.next_batch(df, 60, max_per_host=4)
    ids = [r.id for r in got.collect()]
    left = [r.id for r in queue.remaining(df, got).collect()]
    assert sorted(ids + left) == list(range(500))
    per_host = got.groupBy("partition_id", "host").count().agg(F.max("count")).first()[0]
    assert per_host <= 4 and max(r.n for r in queue.counts(got).collect()) <= 60


def test_wider_scans_until_there_is_enough(spark):
    df = rows(spark, [(0.9 - k / 1000, "big.com") for k in range(30)] + [(0.5 - k / 1000, f"h{k}.com") for k in range(30)])
    got = [r.host for r in queue.tiered_batch(df, 10, 10, 5, 3).orderBy("place").collect()]
    assert got[:3] == ["big.com"] * 3 and len(got) == 10 and got[3:] == [f"h{k}.com" for k in range(7)]
    assert [r.host for r in queue.tiered_batch(df, 10, 1, 1, 3).collect()] == ["big.com"] * 3  # the first scan is enough


def test_limits_and_blacklist(spark):
    assert [queue.clamp(64, 0, 10), queue.clamp(64, 100, 60), queue.clamp(64, 100, 100)] == [64, 40, 0]
    df = rows(spark, [A, B])
    assert [r.host for r in queue.without_blacklisted(df, spark.createDataFrame([("KHELLAN.com",)], "host string")).collect()] == ["knuthellan.com"]
    assert queue.stamped(df, 7).select("jid").distinct().collect()[0][0] == 7
    assert [(r.n, r.hosts, r.enough) for r in queue.enough(df, 2, 3).collect()] == [(2, 2, False)]


HOSTS = ["www.example.com"] * 3 + ["example.com"] * 2 + ["example1.com"]


def pending(spark, hosts=HOSTS):
    return spark.createDataFrame([(h, k) for k, h in enumerate(hosts)], "host string, seq long")


def busy(spark, *hosts):
    return spark.createDataFrame([(h,) for h in hosts], "host string")


def test_overused_buffer(spark):
    fresh, none = pending(spark), pending(spark).limit(0)
    served, left = overused.serve(none, fresh, busy(spark, "www.example.com", "example1.com"), 10)
    assert {r.seq for r in served.collect()} == {3, 4} and left.count() == 4
    served, left = overused.serve(left, none, busy(spark, "www.example.com"), 10)
    assert [r.seq for r in served.collect()] == [5] and left.count() == 3
    served, left = overused.serve(left, none, busy(spark, "www.example.com"), 10)
    assert served.count() == 0 and left.count() == 3
    served, left = overused.serve(left, none, busy(spark, "example.com"), 3)
    assert {r.seq for r in served.collect()} == {0, 1, 2} and left.count() == 0


def test_hosts_take_turns(spark):
    got = overused.round_robin(pending(spark), limit=4)
    assert sorted((r.turn, r.host) for r in got.collect()) == [(1, "example.com"), (1, "example1.com"), (1, "www.example.com"), (2, "example.com")]


def test_purging(spark):
    many = pending(spark, ["a"] * 12 + ["b"] * 3)
    got = overused.purged(many, max_per_key=10, keep_per_key=2)
    assert sorted(r.seq for r in got.collect()) == [10, 11, 12, 13, 14]
    hosts = pending(spark, [f"h{k}" for k in range(20)])
    assert overused.sizes(overused.purged(hosts, max_keys=10, keep_keys=4)).first()["hosts"] == 4
    assert overused.purged(hosts, max_keys=20, keep_keys=4).count() == 20
    slots = spark.createDataFrame([("a", 11, 2), ("b", 10, 2)], "host string, active int, concurrency int")
    assert [r.host for r in overused.overused(slots).collect()] == ["a"]
