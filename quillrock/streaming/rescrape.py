"""Re-scrapes as a stream: each page's latest facts are state, and changed facts come out as they are seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FACTS = "updated date, amounts array<long>, text_sha1 string, visited timestamp"
OUTPUT = "url string, visited timestamp, status string, kind string, was date, now date, removed array<long>, added array<long>"


class LatestFacts(StatefulProcessor):
    """Compares each visit of a page with the one before it, in the order of their times.

    A visit that is not later than the page's latest one is a replay, or late: it gives nothing and changes nothing. A page's
    state ends when it has not been visited for `keep_ms`; its next visit is then that of a new page.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", FACTS, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was, out, seen = (self.state.get() if self.state.exists() else None), [], False
        visits = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.visited, r.text_sha1 or ""))
        for r in visits:
            visited = pd.Timestamp(r.visited).tz_localize(None)
            now = (None if pd.isna(r.updated) else r.updated, sorted({int(x) for x in r.amounts}) if r.amounts is not None else [], r.text_sha1, visited)
            if was is not None and visited <= pd.Timestamp(was[3]).tz_localize(None):
                continue
            if was is None:
                out.append((key[0], visited, "new", None, None, None, [], []))
            else:
                before, after = set(was[1] or []), set(now[1])
                if was[0] != now[0]:
                    out.append((key[0], visited, "changed", "source_date", was[0], now[0], [], []))
                if before != after:
                    out.append((key[0], visited, "changed", "amounts", None, None, sorted(before - after), sorted(after - before)))
                if was[0] == now[0] and before == after:
                    out.append((key[0], visited, "text" if was[2] != now[2] else "identical", None, None, None, [], []))
            was, seen = now, True
        if seen:
            self.state.update(was)
        if out:
            yield pd.DataFrame(out, columns=["url", "visited", "status", "kind", "was", "now", "removed", "added"])

    def close(self) -> None:
        pass


def changes(visits: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """One row for each changed fact, and one for each other visit, of a stream of page facts (url, updated, amounts, text_sha1, visited).

    keep_ms: how long a page's facts are kept after its last visit; None for ever.
    """
    mode = "processingTime" if keep_ms else "none"
    # two visits of a page at one time are told apart by their text; null addresses are no pages
    given = visits.where("url is not null and visited is not null").select("url", "updated", "amounts", "text_sha1", "visited")
    return given.groupBy("url").transformWithStateInPandas(LatestFacts(keep_ms), OUTPUT, "append", mode)


def findings(changed: DataFrame) -> DataFrame:
    """The rows that drift.findings gives, with the time of the visit."""
    return changed.where(F.col("status") == "changed").select("url", "kind", "was", "now", "removed", "added", "visited")


#: Keyed state of this kind needs this store (fixed name).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark: SparkSession, visits: str, out: str, checkpoint: str, keep_ms: int | None = None) -> DataFrame:
    """Process what is new in the folder `visits` (Parquet), append to `out`, and give all of `out`."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(f"url string, {FACTS}").parquet(visits)
        changes(stream, keep_ms).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(OUTPUT).parquet(out)
