"""Per-host rate limiter as keyed state over a request stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MIN_DELAY, BUDGET, BACKOFF, MAX_BACKOFF, BLOCK_LIMIT = 6.0, 25, 20.0, 180.0, 2
OUTPUT = "host string, seq long, verdict string, wait double"


class Limiter(StatefulProcessor):
    """ALLOW, WAIT (with seconds) or PARKED for each request; refusals back off and, repeated, park the host."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("host", "last double, n long, blocks long, parked boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n, blocks, parked = self.state.get() if self.state.exists() else (-1e18, 0, 0, False)
        out = []
        for r in sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.ts, r.seq)):
            if parked or n >= BUDGET:
                parked = True
                out.append((key[0], int(r.seq), "PARKED", 0.0))
                continue
            wait = max(0.0, MIN_DELAY + r.jitter - (r.ts - last))
            last, n = max(r.ts, last) if wait == 0 else last + MIN_DELAY + r.jitter, n + 1
            if r.status in (403, 429, 503):
                blocks += 1
                parked = blocks >= BLOCK_LIMIT
                if r.status != 403 and not parked:
                    wait += r.retry_after if r.retry_after == r.retry_after and r.retry_after is not None else min(BACKOFF * 2 ** (blocks - 1), MAX_BACKOFF)
            elif 200 <= r.status < 400:
                blocks = 0
            out.append((key[0], int(r.seq), "PARKED" if parked else "WAIT" if wait > 0 else "ALLOW", round(wait, 3)))
        self.state.update((float(last), int(n), int(blocks), bool(parked)))
        yield pd.DataFrame(out, columns=["host", "seq", "verdict", "wait"])

    def close(self) -> None:
        pass


def limit(requests: DataFrame) -> DataFrame:
    """requests (host, seq, ts double, status, retry_after double, jitter double), streaming."""
    return requests.groupBy("host").transformWithStateInPandas(Limiter(), OUTPUT, "append", "none")
