"""Looks worked day by day from stored borders equal the looks over all rows, also when a day comes late or is replaced."""

import random
from datetime import timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import at
from thermofleet.operators import grid as g
from thermofleet.operators import spans as sp
from thermofleet.operators.daily import DailySeries
from thermofleet.operators.track import Track

SCHEMA = "k string, ts timestamp, n bigint, value double"
TRACK = Track(("k",), "ts", ("n",))


def readings(seed, days=4):
    rnd, out = random.Random(seed), []
    for n in range(160):
        key = rnd.choice("aab")
        if key == "b" and 1 <= n * days // 160 < 2:
            continue  # a day without rows
        ts = at(n * days * 1440 / 160) + timedelta(minutes=rnd.choice([0, 0, 5, 30]))
        out.append((key, ts, n, rnd.choice([None, 1.0, 1.0, 2.0])))
    return out + [("c", at(2 * 1440 + 5), 500, None), ("c", at(3 * 1440), 501, 7.0)]


def key(r):
    return tuple(map(str, r))


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Four days, the second last and the first one put again with other rows."""
    old, new = readings(1), readings(2)
    first = lambda rows: [r for r in rows if r[1] < at(1440)]
    rest = [r for r in old if r[1] >= at(1440)]
    before, after = (spark.createDataFrame(x, SCHEMA).cache() for x in (old, first(new) + rest))
    series = DailySeries(str(tmp_path_factory.mktemp("daily")), ("k",), tie=("n",), gap_seconds=3_600)
    days = sorted({str(r[1].date()) for r in old})
    touched = [series.put(before, d) for d in (days[0], days[2], days[3], days[1])]
    assert touched == [[days[0]], [days[2]], [days[3]], days[1:]]
    assert series.put(before, days[3]) == [days[3]]  # nothing new
    assert series.put(after, days[0])[0] == days[0]
    return series, after, days


def whole(stored, look):
    series, rows, days = stored
    return reduce(DataFrame.unionByName, [look(series, rows, d) for d in days])


def test_fill_and_changes(stored):
    _, rows, _ = stored
    assert told(whole(stored, lambda s, r, d: s.filled(r, d)), "k", "n", "value") == told(g.forward_fill(rows, TRACK, ["value"]), "k", "n", "value")
    assert told(whole(stored, lambda s, r, d: s.compacted(r, d)), "k", "n", "value") == told(sp.change_only(rows, TRACK), "k", "n", "value")


def test_segments_and_spans(stored):
    _, rows, _ = stored
    assert told(whole(stored, lambda s, r, d: s.segmented(r, d)), "k", "n", "segment_id") == told(sp.gap_segments(rows, TRACK, 3_600), "k", "n", "segment_id")
    spans = whole(stored, lambda s, r, d: s.spans(r, d))
    last = spans.groupBy("k", "run_no").agg(F.max_by(F.struct("value", "start_ts", "end_ts", "n_rows"), "n_rows").alias("r")).select("k", "run_no", "r.*")
    columns = ["k", "run_no", "value", "start_ts", "end_ts", "n_rows"]
    assert told(last, *columns) == told(sp.state_spans(rows, TRACK, "value"), *columns)
    assert spans.filter("not open").groupBy("k", "run_no").count().filter("count > 1").isEmpty()


def test_grid(stored):
    _, rows, _ = stored
    full = g.resample_ffill(rows, ["k"], step_seconds=1_800, tie=["n"])
    assert told(whole(stored, lambda s, r, d: s.gridded(r, d, 1_800)), "k", "ts", "value") == told(full, "k", "ts", "value")


def test_a_day_reads_its_own_rows_and_one_border_row_per_key(spark, stored, tmp_path):
    """Rows of earlier days can be gone: only their edges and states are read."""
    series, rows, days = stored
    only = rows.filter(F.col("ts") >= F.lit(days[3]).cast("timestamp"))
    assert told(series.filled(only, days[3]), "k", "n", "value") == told(series.filled(rows, days[3]), "k", "n", "value")
    assert series.state_before(spark, days[3]).count() == 3 and series.state_before(spark, days[0]) is None
