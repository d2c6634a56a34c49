"""The log of requests as a stream: equal to its batch form, restarts, late acknowledgements, timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenweave.plans.requests import request_log
from lumenweave.streaming import requests

SCHEMA = "request string, ts timestamp, kind string, rows array<string>"
AT = dt.datetime(2024, 1, 1)


def entry(request, minute, kind, *rows):
    return request, AT + dt.timedelta(minutes=minute), kind, list(rows) if rows else None


@pytest.fixture
def stream(spark, tmp_path):
    """Parts arrive one after the other; each run of the query starts anew from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(*parts):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            told = requests.follow(source, "1 minute", 30 * 60_000)

            def keep(df, n, i=i):
                df.write.mode("overwrite").parquet(f"{tmp_path}/out/run={i}/batch={n}")

            told.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(300)
        told = spark.read.schema(f"{requests.TOLD}, run int, batch int").parquet(f"{tmp_path}/out")
        return told.drop("run", "batch"), spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def by_request(df):
    return {r.request: (r.status, r.missing, r.n_failed, r.n_odd) for r in df.collect()}


def test_restarts_and_late_acknowledgements(stream):
    told, log = stream(
        [entry("a", 0, "requested", "1", "2"), entry("b", 1, "requested", "3"), entry("a", 2, "failed"), entry("d", 2, "odd", "9"), entry(None, 2, "requested", "7")],
        [entry("a", 3, "acknowledged", "1"), entry("b", 3, "acknowledged", "3"), entry("c", 4, "acknowledged", "8")],
        [entry("c", 5, "requested", "8", "9"), entry("a", 6, "acknowledged", "2"), entry("b", 6, "failed"), entry("d", 6, "requested")],
    )
    got = by_request(requests.latest(told))
    assert got == by_request(requests.coverage(log))
    assert got == {"a": ("COMPLETE", [], 1, 0), "b": ("COMPLETE", [], 1, 0), "c": ("INCOMPLETE", ["9"], 0, 0), "d": ("OPEN", [], 0, 2)}
    statuses = {(r.request, r.version): r.status for r in told.collect()}
    assert statuses["a", 1] == "INCOMPLETE" and statuses["b", 1] == "OPEN" and statuses["c", 1] == "COMPLETE"


def test_timers(stream):
    """What nothing answers in time is told of once; an acknowledgement after that still counts."""
    told, _ = stream(
        [entry("slow", 0, "requested", "1"), entry("done", 0, "requested", "2"), entry("done", 1, "acknowledged", "2")],
        [entry("tick", 90, "requested", "9")],
        [entry("tick", 91, "acknowledged", "9")],
        [entry("slow", 95, "acknowledged", "1")],
    )
    history = {}
    for r in told.orderBy("version").collect():
        history.setdefault(r.request, []).append(r.status)
    assert history["slow"] == ["OPEN", "EXPIRED", "COMPLETE"] and history["done"] == ["COMPLETE"] and history["tick"] == ["OPEN", "COMPLETE"]


def test_events_as_a_log(spark, stream):
    """The driver's events in four parts: the stream's last word is the batch answer."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = [tuple(r) for r in request_log(events).orderBy("ts").collect()]
    told, arrived = stream(*[rows[k : k + 250] for k in range(0, len(rows), 250)])
    got, want = by_request(requests.latest(told)), by_request(requests.coverage(arrived))
    assert got.keys() == want.keys() and len(want) >= 15 and arrived.count() == 1000
    # A request that nothing came for within the patience is told of as expired, whatever it was before.
    assert all(g[1:] == want[k][1:] and (g[0] == want[k][0] or g[0] == "EXPIRED" and want[k][0] != "COMPLETE") for k, g in got.items())
    assert any(g[0] == "COMPLETE" for g in got.values())
