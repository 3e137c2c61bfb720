"""Typed messages of existing fetchers, and states in the state store."""

import pytest

from linkloom.sources import wire
from linkloom.streaming import stateful

EVENTS = [
    dict(type="page_crawled", url="http://a.com", method="GET", meta='{"k": ["x", 1]}', status_code=200, body="ü"),
    dict(type="links_extracted", url="http://a.com", method="GET", meta="{}", links=[dict(url="http://b.com", method="POST", meta="{}")]),
    dict(type="request_error", url="http://a.com", method="GET", meta="{}", error="Timeout"),
    dict(type="update_score", url="http://a.com", method="GET", meta="{}", score=0.5, schedule=True),
    dict(type="new_job_id", jid=7), dict(type="offset", partition_id=3, offset=50), dict(type="stats", stats='{"crawled": 3}'), dict(type="request", url="http://a.com", method="GET", meta="{}"),
]


@pytest.mark.parametrize("event", EVENTS, ids=lambda e: e["type"])
def test_messages_round_trip(event):
    assert wire.read(wire.write(event)) == event


def test_values_keep_their_types():
    value = {b"k": [1, 2.5, None, True, "s", b"\xff", (1, (2,)), {"a": {}}], 5: "x"}
    assert wire.unpack(wire.pack(value)) == value
    assert wire.unpack(wire.pack({"s": {2, 1}})) == {"s": [1, 2]} and wire.unpack(wire.pack(object())) is None
    with pytest.raises(TypeError):
        wire.unpack(["what", 1])


def test_messages_as_columns(spark):
    messages = spark.createDataFrame([(wire.write(e),) for e in EVENTS] + [("{broken",), ('["dict", [["type", "odd"]]]',)], "value string")
    rows = wire.decoded(messages)
    got = rows.collect()
    assert [r.type for r in got] == [e["type"] for e in EVENTS] + [None, None] and got[3].score == 0.5 and got[1].links[0].url == "http://b.com" and "odd" in got[-1].error
    again = wire.decoded(wire.encoded(rows.where("type is not null"))).collect()
    assert [str(r) for r in again] == [str(r) for r in got[:-2]]


def test_links_are_scheduled_once_over_many_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "type string, fingerprint string, url string, score double, seq bigint"
        batches = [[("update_score", "a", "u", 0.5, 0), ("update_score", "a", "u", 0.9, 1), ("page_crawled", "b", "v", None, 2)], [("update_score", "a", "u", 0.1, 3), ("update_score", "b", "v", 0.2, 4), ("update_score", "c", "w", 0.3, 5)]]
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = stateful.scheduled_once(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [("a", "u", 0.5, 0), ("c", "w", 0.3, 5)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
