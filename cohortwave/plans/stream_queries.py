"""Queries of the streaming operators: the events as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..sources import views as V
from ..streaming import epochs as W

WIDTH, STEP, LATE = "2 days", "1 day", "3 hours"


def feed(events):
    return events.select(
        (F.col("user_id") % 8).alias("subject"), F.when(F.dayofmonth("ts") <= 15, "open").otherwise("closed").alias("state"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("x")
    )


def _streamed(s, d):
    events = W.files(s, f"{d}/events.parquet*", V.table(s, d, "events").schema)
    out = W.drained(W.windows(feed(events), WIDTH, STEP, LATE))
    micros = lambda c: F.unix_micros(c).alias(c)
    return out.select("subject", "state", "channel", micros("start"), micros("end"), "n", r6("mean", "mean"), r6(F.element_at("xs", 1), "first"), r6(F.element_at("xs", -1), "last"))


DAY = 86_400_000_000
SQL = f"""WITH e AS (SELECT user_id % 8 AS subject, CASE WHEN day(ts) <= 15 THEN 'open' ELSE 'closed' END AS state, event_type AS channel, epoch_us(ts) AS t, event_id, value AS x FROM events),
 w AS (SELECT *, unnest([t // {DAY} * {DAY} - {DAY}, t // {DAY} * {DAY}]) AS start FROM e)
SELECT subject, state, channel, start, start + 2 * {DAY} AS "end", count(x) AS n, round(avg(x), 6) AS mean, round(arg_min(x, (t, event_id)), 6) AS first, round(arg_max(x, (t, event_id)), 6) AS last
FROM w WHERE start + 2 * {DAY} <= (SELECT max(t) FROM e) - 3 * 3600000000 GROUP BY subject, state, channel, start"""

QUERIES = {"ts07_epochs_stream": (_streamed, SQL)}
