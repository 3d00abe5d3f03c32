"""Attempts of endpoints as a stream with state: the first attempt of a run wins and stays the winner over restarts.

Each endpoint holds the runs that it has seen, the latest finish, and whether it is failing and its last attempt was
suspicious; a timer forgets runs whose attempts can't come any more. The batch operators (history.first_attempts, stale
and endpoint_health over the winners) give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers and maps need the state store that keeps them.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "id long, endpoint_id long, run_id string, owner boolean, stale boolean, endpoint_status string"


class Winners(StatefulProcessor):
    """For each attempt: whether it is its run's winner, whether it began before an earlier winner had finished, and the endpoint's state after it."""

    def __init__(self, retention_ms: int | None) -> None:
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", "finished_us long")
        self.endpoint = handle.getValueState("endpoint", "finished_us long, failing boolean, suspicious boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # the rows of one endpoint in one micro-batch, in order of their ids
        batch = pd.concat(list(rows)).sort_values("id")
        latest, failing, suspicious = self.endpoint.get() or (None, False, False)
        out = []
        for r in batch.itertuples():
            owner = not self.runs.containsKey((r.run_id,))
            stale = None
            if owner:
                self.runs.updateValue((r.run_id,), (int(r.finished_us),))
                stale = latest is not None and latest > r.started_us
                latest = max(latest or r.finished_us, r.finished_us)
                if r.suspicious_zero and suspicious:
                    failing = True
                elif r.complete and r.http_status == 200 and r.seen > 0 and not r.suspicious_zero:
                    failing = False
                suspicious = bool(r.suspicious_zero)
            out.append((r.id, key[0], r.run_id, owner, stale, "failing" if failing else "active"))
        self.endpoint.update((int(latest), failing, suspicious))
        if self.retention_ms is not None:
            self.handle.registerTimer(int(latest) // 1000 + self.retention_ms)
        frame = pd.DataFrame(out, columns=["id", "endpoint_id", "run_id", "owner", "stale", "endpoint_status"])
        yield frame.astype({"stale": "object"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() - (self.retention_ms or 0)
        for run_id, (finished_us,) in [(k, v) for k, v in self.runs.iterator()]:
            if finished_us // 1000 <= until:
                self.runs.removeKey(run_id)
        yield pd.DataFrame(columns=["id", "endpoint_id", "run_id", "owner", "stale", "endpoint_status"])

    def close(self) -> None:
        pass


def durable_winners(attempts: DataFrame, retention: str | None = None) -> DataFrame:
    """attempts: a stream of id, endpoint_id, run_id, started_at, finished_at, complete, http_status, seen, suspicious_zero.

    Ids grow with arrival. A run's first attempt is its winner; an attempt of a run that has one is a replay: it changes
    nothing and has no `stale`. With a retention (an interval of event time) runs are forgotten that long after they
    finished, and the state stays bounded; without one a replay is known for ever. Set PROVIDER on the session.
    """
    columns = ["id", "endpoint_id", "run_id", "complete", "http_status", "seen", "suspicious_zero", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us")]
    if retention is None:
        return attempts.select(*columns).groupBy("endpoint_id").transformWithStateInPandas(Winners(None), OUTPUT, "Append", "None")
    spark = attempts.sparkSession
    ms = spark.sql(f"select unix_millis(timestamp '2000-01-01' + interval {retention}) - unix_millis(timestamp '2000-01-01') as ms").first()["ms"]
    watched = attempts.withWatermark("finished_at", retention).select(*columns, "finished_at")
    return watched.groupBy("endpoint_id").transformWithStateInPandas(Winners(ms), OUTPUT, "Append", "EventTime")
