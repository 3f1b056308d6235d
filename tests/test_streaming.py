"""A stream of files against the same rows as a table."""

import datetime

import numpy as np
import pytest

from cohortwave.streaming import epochs as W

SCHEMA = "subject long, state string, channel string, ts timestamp, seq long, x double"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def rows(n, seed=1):
    r = np.random.default_rng(seed)
    return [(int(r.integers(3)), "open", f"c{r.integers(2)}", START + datetime.timedelta(minutes=int(m)), i, float(r.normal())) for i, m in enumerate(np.sort(r.integers(0, 3000, n)))]


def written(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def key(df):
    return sorted((r.subject, r.state, r.channel, r.start, r.end, r.n, round(r.mean, 9), tuple(r.xs)) for r in df.collect())


@pytest.mark.parametrize("width,step", [("60 minutes", "60 minutes"), ("2 hours", "30 minutes")])
def test_stream_returns_the_rows_of_the_table(spark, tmp_path, width, step):
    data = rows(400)
    folder = str(tmp_path / "feed")
    written(spark, folder, [data[:150], data[150:300], data[300:]])
    feed = spark.createDataFrame(data, SCHEMA)
    want = W.closed(W.windows(feed, width, step, "10 minutes"), feed, "10 minutes")
    got = W.drained(W.windows(W.files(spark, folder, SCHEMA, 1), width, step, "10 minutes"))
    assert key(got) == key(want) and len(key(want)) > 100


def test_stream_goes_on_where_it_stopped_and_drops_what_is_late(spark, tmp_path):
    folder, out, at = (str(tmp_path / n) for n in ("feed", "out", "at"))
    data = rows(300, 2)
    late = (0, "open", "c0", START, 9_999, 100.0)
    windows = lambda: W.windows(W.files(spark, folder, SCHEMA, 1), "1 hour", "1 hour", "10 minutes")
    written(spark, folder, [data[:200]])
    first = key(W.drained(windows(), out, at))
    written(spark, folder, [[late, *data[200:]]])
    second = key(W.drained(windows(), out, at))
    feed = spark.createDataFrame(data, SCHEMA)
    assert set(first) < set(second)
    assert second == key(W.closed(W.windows(feed, "1 hour", "1 hour", "10 minutes"), feed, "10 minutes"))


def test_rows_without_time_or_value(spark):
    feed = spark.createDataFrame([(1, "o", "c", None, 0, 1.0), (1, "o", "c", START, 1, None), (1, "o", "c", START, 2, 4.0)], SCHEMA)
    (got,) = W.windows(feed, "1 hour", "1 hour", "1 minute").collect()
    assert (got.n, got.mean, got.xs) == (1, 4.0, [None, 4.0])
