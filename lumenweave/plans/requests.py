"""Queries over a log of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.streaming import requests

from .registry import query


def request_log(events):
    """Users' events as a log: views and clicks ask for a row, purchases acknowledge the row of that name and those below, errors are failures."""
    k = F.from_json("props", "k int")["k"]
    kind = F.when(F.col("event_type").isin("view", "click"), requests.REQUESTED).when(F.col("event_type") == "purchase", requests.ACKNOWLEDGED).when(F.col("event_type") == "error", requests.FAILED).otherwise(F.col("event_type"))
    row = lambda n: F.concat(F.lit("r"), n.cast("string"))
    rows = F.when(kind == requests.REQUESTED, F.array(row(k % 9))).when(kind == requests.ACKNOWLEDGED, F.transform(F.sequence(F.lit(0), k % 9), row))
    return events.select(F.col("user_id").cast("string").alias("request"), "ts", kind.alias("kind"), rows.alias("rows"))


@query("pl18_request_coverage", """WITH e AS (SELECT user_id::VARCHAR AS request, event_type, (props ->> '$.k')::INT % 9 AS k FROM events),
u AS (SELECT DISTINCT request FROM e), q AS (SELECT DISTINCT request, 'r' || k AS r FROM e WHERE event_type IN ('view', 'click')), c AS (SELECT DISTINCT request, 'r' || unnest(range(0, k + 1)) AS r FROM e WHERE event_type = 'purchase'),
m AS (SELECT request, list(r ORDER BY r) AS missing FROM q ANTI JOIN c USING (request, r) GROUP BY request), s AS (SELECT DISTINCT request FROM c),
n AS (SELECT request, count(*) FILTER (event_type = 'error')::INT AS n_failed, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'error'))::INT AS n_odd FROM e GROUP BY request)
SELECT request, CASE WHEN missing IS NULL AND s.request IS NOT NULL THEN 'COMPLETE' WHEN n_failed > 0 OR s.request IS NOT NULL THEN 'INCOMPLETE' ELSE 'OPEN' END AS status, array_to_string(coalesce(missing, []), ',') AS missing, n_failed, n_odd
FROM n LEFT JOIN m USING (request) LEFT JOIN s USING (request)""")
def request_coverage(t):
    """What each user's requests still lack, and how often they failed; the streaming form's last word says the same."""
    return requests.coverage(request_log(t.events)).withColumn("missing", F.array_join("missing", ","))
