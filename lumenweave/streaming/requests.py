"""A log of requests as it grows: what was asked for, what has been answered, what never came.

The same log has a batch form and a streaming one.  Rows asked for and rows
acknowledged are sets, so order does not matter: an acknowledgement supersedes
a failure before or after it.  In the stream each request has a little state of
its own and a timer, which tells of requests that nothing answered in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of entries; any other is noted and does no harm.
REQUESTED, FAILED, ACKNOWLEDGED = "requested", "failed", "acknowledged"
STATE = "requested array<string>, covered array<string>, failed int, odd int, version int, due long"
TOLD = "request string, version int, status string, missing array<string>, n_failed int, n_odd int"


def _status(missing: int, covered: int, failed: int, expired: bool = False) -> str:
    if not missing and covered:
        return "COMPLETE"
    return "EXPIRED" if expired else "INCOMPLETE" if failed or covered else "OPEN"


def coverage(log: DataFrame) -> DataFrame:
    """(request, status, missing, n_failed, n_odd) of a log (request, ts, kind, rows).

    missing: rows asked for and never acknowledged.  COMPLETE without any, once something was acknowledged; INCOMPLETE if
    something failed or came in part; else OPEN.  Entries of another kind, or whose rows are null where rows are due, are
    counted as odd.  Entries of a null request are left out.  Sets are put together task by task; a request's rows are
    the rows of one table.
    """
    of = lambda kind: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind") == kind, F.col("rows")))))
    odd = ~F.coalesce(F.col("kind").isin(REQUESTED, FAILED, ACKNOWLEDGED), F.lit(False)) | ((F.col("kind") != FAILED) & F.col("rows").isNull())
    found = log.filter("request IS NOT NULL").groupBy("request").agg(
        of(REQUESTED).alias("requested"), of(ACKNOWLEDGED).alias("covered"), F.count_if(F.col("kind") == FAILED).cast("int").alias("n_failed"), F.count_if(odd).cast("int").alias("n_odd")
    )
    found = found.withColumn("missing", F.array_sort(F.array_except("requested", "covered")))
    some = F.size("covered") > 0
    status = F.when((F.size("missing") == 0) & some, "COMPLETE").when((F.col("n_failed") > 0) | some, "INCOMPLETE").otherwise("OPEN")
    return found.select("request", status.alias("status"), "missing", "n_failed", "n_odd")


class RequestLog(StatefulProcessor):
    """One request's state: rows asked for and acknowledged, failures, how often it has been told of, when it is due."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("log", STATE)

    def _told(self, key, held, expired: bool = False) -> pd.DataFrame:
        requested, covered, failed, odd, version, _ = held
        missing = sorted(set(requested) - set(covered))
        return pd.DataFrame({"request": [key[0]], "version": [version], "status": [_status(len(missing), len(covered), failed, expired)], "missing": [missing], "n_failed": [failed], "n_odd": [odd]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requested, covered, failed, odd, version, due = self.state.get() if self.state.exists() else ([], [], 0, 0, 0, 0)
        sets = {REQUESTED: set(requested), ACKNOWLEDGED: set(covered)}
        latest = 0
        for some in rows:
            for ts, kind, named in zip(some["ts"], some["kind"], some["rows"], strict=True):
                if kind == FAILED:
                    failed += 1
                elif kind in sets and named is not None:
                    sets[kind].update(named)
                else:
                    odd += 1
                latest = max(latest, int(ts.timestamp() * 1000))
        if due:
            self.handle.deleteTimer(due)
        due = max(latest, timerValues.getCurrentWatermarkInMs()) + self.patience
        held = (sorted(sets[REQUESTED]), sorted(sets[ACKNOWLEDGED]), failed, odd, version + 1, due)
        told = self._told(key, held)
        if told["status"][0] == "COMPLETE":
            held = (*held[:5], 0)
        else:
            self.handle.registerTimer(due)
        self.state.update(held)
        yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        held = (*held[:4], held[4] + 1, 0)
        self.state.update(held)
        yield self._told(key, held, expired=True)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, late: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """``TOLD`` for each request that a batch has news of, and EXPIRED when ``patience_ms`` of event time have passed without any.

    ``stream`` as ``coverage`` takes it, with ts a timestamp.  The latest version of a request says what ``coverage``
    says of all that has arrived, but for EXPIRED; a later acknowledgement supersedes that too.  Needs the RocksDB state
    store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    timed = stream.filter("request IS NOT NULL").select("request", "ts", "kind", "rows").withWatermark("ts", late)
    return timed.groupBy("request").transformWithStateInPandas(statefulProcessor=RequestLog(patience_ms), outputStructType=TOLD, outputMode="Update", timeMode="EventTime")


def latest(told: DataFrame) -> DataFrame:
    """Of what was told, the latest of each request; a batch that was told twice after a restart counts once."""
    rest = [c for c in told.columns if c != "request"]
    return told.groupBy("request").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("request", "x.*")
