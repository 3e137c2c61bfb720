"""States in the stream's own state store instead of a table: links scheduled once, however often they are found.

One key per fingerprint, so the state is spread over all partitions. Needs the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from linkloom.schema import CRAWLED, ERROR, NOT_CRAWLED, QUEUED

_OUT = "fingerprint string, url string, score double, seq bigint"


class _States(StatefulProcessor):
    """Of one link: its state. Emits the link when it is scheduled first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        now = NOT_CRAWLED if found is None else int(found[0])
        frame = pd.concat(list(rows)).sort_values("seq")
        out = []
        for kind, url, score, seq in zip(frame["type"], frame["url"], frame["score"], frame["seq"]):
            if kind == "page_crawled":
                now = CRAWLED
            elif kind == "request_error":
                now = ERROR
            elif now == NOT_CRAWLED:
                now = QUEUED
                out.append((key[0], url, score, seq))
        self.state.update((now,))
        yield pd.DataFrame(out, columns=["fingerprint", "url", "score", "seq"])

    def close(self) -> None:
        pass


def scheduled_once(events: DataFrame) -> DataFrame:
    """Of a stream of (type, fingerprint, url, score, seq), the links (type update_score) that weren't scheduled, crawled or
    failed before, at their first event."""
    return events.groupBy("fingerprint").transformWithStateInPandas(_States(), _OUT, "Append", "None")
