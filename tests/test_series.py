"""Chunked operators against brute force on random rows."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from thermofleet.operators import aggregates as agg
from thermofleet.operators import asof as a
from thermofleet.operators import grid as g
from thermofleet.operators import smoothing as sm
from thermofleet.operators import spans as sp
from thermofleet.operators.track import Track, carry, numbered, over_rows


def series(spark, seed, n=300, keys=2, span=4000, nulls=0.3):
    rnd = random.Random(seed)
    data = [(rnd.randrange(keys), at(rnd.randrange(span)), i, None if rnd.random() < nulls else float(rnd.randrange(100))) for i in range(n)]
    return data, spark.createDataFrame(data, "k bigint, ts timestamp, id bigint, v double")


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred rows, so that small data is cut many times."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("cut", [True, False])
def test_carry_equals_plain_scan(spark, request, cut):
    if cut:
        request.getfixturevalue("small_ranges")
    data, df = series(spark, 1)
    track = Track(("k",), "ts", ("id",))
    got = {r.id: tuple(r)[4:] for r in carry(df, track, last={"l": F.col("v")}, before={"b": F.col("v")}, following={"f": F.col("v")}, after={"a": F.col("v")}, total={"t": F.coalesce("v", F.lit(0.0))}).collect()}
    for k in (0, 1):
        ordered = sorted([d for d in data if d[0] == k], key=lambda d: (d[1], d[2]))
        for i, d in enumerate(ordered):
            back = [x[3] for x in ordered[: i + 1] if x[3] is not None]
            ahead = [x[3] for x in ordered[i:] if x[3] is not None]
            strict_back = [x[3] for x in ordered[:i] if x[3] is not None]
            strict_ahead = [x[3] for x in ordered[i + 1 :] if x[3] is not None]
            want = (back[-1] if back else None, strict_back[-1] if strict_back else None, ahead[0] if ahead else None, strict_ahead[0] if strict_ahead else None, sum(x[3] or 0 for x in ordered[: i + 1]))
            assert got[d[2]] == want


def test_over_rows_crosses_blocks(spark):
    data, df = series(spark, 2, nulls=0)
    track = Track(("k",), "ts", ("id",), block_rows=7)
    out = over_rows(df, track, 5, 4, [lambda w: {"p": F.lag("v", 5).over(w), "n": F.lead("v", 4).over(w)}])
    got = {r.id: (r.p, r.n) for r in out.collect()}
    assert len(got) == len(data)
    for k in (0, 1):
        o = sorted([d for d in data if d[0] == k], key=lambda d: (d[1], d[2]))
        for i, d in enumerate(o):
            assert got[d[2]] == (o[i - 5][3] if i >= 5 else None, o[i + 4][3] if i + 4 < len(o) else None)


def test_over_rows_reaches_beyond_the_block(spark):
    df = spark.createDataFrame([(1, at(i), i) for i in range(40)], "k bigint, ts timestamp, v bigint")
    out = over_rows(df, Track(("k",), block_rows=4), 9, 0, [lambda w: {"p": F.lag("v", 9).over(w)}])
    assert {r.v: r.p for r in out.collect()} == {i: i - 9 if i >= 9 else None for i in range(40)}


def test_numbered(spark):
    data, df = series(spark, 3)
    got = {r.id: r.n for r in numbered(df, Track(("k",), "ts", ("id",)), "n").collect()}
    for k in (0, 1):
        for i, d in enumerate(sorted([d for d in data if d[0] == k], key=lambda d: (d[1], d[2]))):
            assert got[d[2]] == i + 1


@pytest.mark.parametrize("seed", [4, 5])
def test_asof_and_nearest_equal_brute_force(spark, seed):
    left, ldf = series(spark, seed, 150)
    right, _ = series(spark, seed + 50, 200)
    unique = {(r[0], r[1]): r for r in right}
    right = list(unique.values())
    rdf = spark.createDataFrame(right, "k bigint, ts timestamp, rid bigint, rv double")
    back = {r.id: r.right_rid for r in a.asof(ldf, rdf, ["k"], ["rid"]).collect()}
    strict = {r.id: r.right_rid for r in a.asof(ldf, rdf, ["k"], ["rid"], allow_exact=False).collect()}
    ahead = {r.id: r.right_rid for r in a.asof(ldf, rdf, ["k"], ["rid"], direction="forward").collect()}
    near = {r.id: r.right_rid for r in a.nearest(ldf, rdf, ["k"], ["rid"], tolerance_seconds=600).collect()}
    for k, ts, i, _ in left:
        mine = sorted([r for r in right if r[0] == k], key=lambda r: r[1])
        b = [r for r in mine if r[1] <= ts]
        s = [r for r in mine if r[1] < ts]
        f = [r for r in mine if r[1] >= ts]
        n = min(mine, key=lambda r: (abs(r[1] - ts), r[1]))
        assert back[i] == (b[-1][2] if b else None)
        assert strict[i] == (s[-1][2] if s else None)
        assert ahead[i] == (f[0][2] if f else None)
        assert near[i] == (n[2] if abs((n[1] - ts).total_seconds()) <= 600 else None)


def test_nearest_tie_takes_the_earlier_row(spark):
    left = spark.createDataFrame([(1, at(10))], "k bigint, ts timestamp")
    right = spark.createDataFrame([(1, at(5), "early"), (1, at(15), "late")], "k bigint, ts timestamp, w string")
    assert a.nearest(left, right, ["k"], ["w"]).first().right_w == "early"


def test_forecast_horizons_beyond_the_data_are_null(spark):
    refs = spark.createDataFrame([(1, at(0))], "site_id bigint, ts timestamp")
    fc = spark.createDataFrame([(1, at(60), 50.0), (1, at(120), 48.0)], "site_id bigint, target_ts timestamp, temperature double")
    out = a.forecast_at_horizons(refs, fc, [1, 2, 12], values=["temperature"])
    assert rows(out.filter("horizon != '12h'"), "horizon", "forecast_temperature") == [("1h", 50.0), ("2h", 48.0)]
    assert out.filter("horizon = '12h'").first().forecast_temperature is None


def test_lookup_actual_prefers_exact_then_first_within_three_minutes(spark):
    asked = spark.createDataFrame([(1, 1, at(60)), (2, 1, at(100)), (3, 1, at(200))], "id bigint, k bigint, target_ts timestamp")
    seen = spark.createDataFrame([(1, at(58), 1.0), (1, at(60), 2.0), (1, at(98), 3.0), (1, at(101), 4.0), (1, at(197), 5.0)], "k bigint, ts timestamp, v double")
    assert {r.id: r.actual for r in a.lookup_actual(asked, seen, ["k"], "v").collect()} == {1: 2.0, 2: 3.0, 3: None}


@pytest.mark.parametrize("seed", [6, 7])
def test_interpolation_equals_pandas(spark, seed):
    rnd = random.Random(seed)
    values = [None if rnd.random() < 0.8 else float(rnd.randrange(50)) for _ in range(200)]
    data = [(1, at(5 * i), values[i]) for i in range(200)]
    df = spark.createDataFrame(data, "k bigint, ts timestamp, v double")
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit=3)
    for position in (None, g.tick("ts")):
        out = g.interpolate(df, Track(("k",)), "v", 3, position)
        got = [r.v for r in out.orderBy("ts").collect()]
        assert [x if x is not None else np.nan for x in got] == pytest.approx(want.tolist(), nan_ok=True)


def test_resample_holds_values_and_fills_missing_flags(spark):
    s = spark.createDataFrame([(1, at(7), 1, True), (1, at(7), 2, False), (1, at(21), 3, True)], "k bigint, ts timestamp, n bigint, value boolean")
    out = g.resample_ffill(s, ["k"], start=F.lit(at(0)).cast("timestamp"), end=F.lit(at(25)).cast("timestamp"), tie=["n"], missing=F.lit(False))
    assert [r.value for r in out.orderBy("ts").collect()] == [False, False, False, False, False, True]


def test_smoothed_rate_is_null_at_both_ends(spark):
    df = spark.createDataFrame([(1, at(5 * i), float(i)) for i in range(20)], "k bigint, ts timestamp, v double")
    got = [r.rate for r in sm.smoothed_rate(df, Track(("k",)), "v", "rate", position=g.tick("ts")).orderBy("ts").collect()]
    assert got[:3] == [None] * 3 and got[-3:] == [None] * 3
    assert got[8] == pytest.approx(12.0)


@pytest.mark.parametrize(("lag", "bins"), [(5, [(0, 1)]), (15, [(0, 1), (1, 3)]), (30, [(0, 3), (3, 6)]), (90, [(0, 3), (3, 6), (6, 12), (12, 18)])])
def test_lag_bins(lag, bins):
    assert sm.lag_bins(lag) == bins


def test_gap_of_exactly_ten_minutes_does_not_break(spark):
    df = spark.createDataFrame([(1, at(m)) for m in (0, 10, 20.1, 25)], "k bigint, ts timestamp")
    out = sp.segment_summary(sp.gap_segments(df, Track(("k",)), 600), ["k"])
    assert rows(out, "segment_id", "n_rows") == [(0, 2), (1, 2)]


def test_change_only_keeps_nulls_as_values(spark):
    df = spark.createDataFrame([(1, at(i), v) for i, v in enumerate(["a", "a", None, None, "a", "b"])], "k bigint, ts timestamp, value string")
    assert [r.value for r in sp.change_only(df, Track(("k",))).orderBy("ts").collect()] == ["a", None, "a", "b"]


def test_weighted_median_and_median(spark):
    df = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 1), (1, 30.0, 2), (2, 7.04, 3)], "k bigint, v double, w bigint")
    assert rows(agg.weighted_median(df, ["k"], "v", "w")) == [(1, 20.0), (2, 7.0)]
    rnd = random.Random(9)
    data = [(rnd.randrange(3), rnd.choice([rnd.random(), 0.5])) for _ in range(2_001)]
    got = dict(rows(agg.median(spark.createDataFrame(data, "k bigint, v double"), ["k"], "v")))
    for k in range(3):
        assert got[k] == pytest.approx(float(np.median([v for x, v in data if x == k])))


@pytest.mark.parametrize("spread", [3_600, 0])
def test_dense_stretches_are_cut_by_rows(spark, small_ranges, spread):
    """90 % of the rows lie in one hour, or at one instant, of one key; no range holds much more than its share."""
    rnd = random.Random(11)
    data = [(1, at(600) + timedelta(seconds=rnd.uniform(0, spread)), i, rnd.choice([None, float(i)])) for i in range(3_600)]
    data += [(k, at(rnd.uniform(0, 20_000)), 10_000 + i, float(i)) for i, k in enumerate([1, 2] * 200)]
    df = spark.createDataFrame(data, "k bigint, ts timestamp, id bigint, v double")
    track = Track(("k",), "ts", ("id",))
    fullest = track.chunked(df).groupBy("k", "__chunk").count().agg(F.max("count")).first()[0]
    assert fullest <= len(data) / 6
    got = {r.id: (r.seen, r.n, r.ahead) for r in carry(df, track, last={"seen": F.col("v")}, total={"n": F.lit(1)}, after={"ahead": F.col("v")}).collect()}
    for k in (1, 2):
        seen, mine = None, sorted([d for d in data if d[0] == k], key=lambda d: (d[1], d[2]))
        ahead = [None] * len(mine)
        for i in range(len(mine) - 2, -1, -1):
            ahead[i] = mine[i + 1][3] if mine[i + 1][3] is not None else ahead[i + 1]
        for i, d in enumerate(mine):
            seen = d[3] if d[3] is not None else seen
            assert got[d[2]] == (seen, i + 1, ahead[i])


@pytest.mark.parametrize("copies", [False, True])
def test_left_rows_of_one_instant_are_cut(spark, small_ranges, copies):
    """Most left rows lie at one instant, or are copies of one row: no range holds much more than its share, the match is right."""
    left = [(1, at(600), 0 if copies else i) for i in range(4_000)] + [(k, at(i), 5_000 + i) for i, k in enumerate([1, 2] * 200)]
    right = [(1, at(599), "x"), (1, at(600), "y"), (1, at(601), "z"), (2, at(3), "w")]
    lefts = spark.createDataFrame(left, "k bigint, ts timestamp, id bigint")
    rights = spark.createDataFrame(right, "k bigint, ts timestamp, v string")
    merged = a._merge(lefts, rights, ["k"], "ts", "ts", ["v"], (), True)
    fullest = a._track(["k"], ()).chunked(merged).groupBy("k", "__chunk").count().agg(F.max("count")).first()[0]
    assert fullest <= len(left) / 6
    found = a.asof(lefts, rights, ["k"], ["v"]).filter("ts = timestamp'" + str(at(600)) + "'").groupBy("k", "right_v").count()
    assert rows(found) == [(1, "y", 4_000)]
    near = a.nearest(lefts, rights, ["k"], ["v"]).filter("ts = timestamp'" + str(at(600)) + "'").groupBy("k", "right_v").count()
    assert rows(near) == [(1, "y", 4_000)]


def test_ticks_of_one_key_lie_in_many_partitions(spark):
    s = spark.createDataFrame([(1, at(0)), (1, at(2_000))], "k bigint, ts timestamp")
    ticks = g.grid(s, ["k"], 1)
    parts = [r.n for r in ticks.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(parts) == 120_001 and len(parts) >= 5


def test_durbin_watson_white_and_correlated(spark):
    rnd = np.random.RandomState(0)
    white = rnd.normal(size=2_000)
    ar = np.zeros(2_000)
    for i in range(1, 2_000):
        ar[i] = 0.9 * ar[i - 1] + white[i]
    data = [("white", at(i), float(white[i])) for i in range(2_000)] + [("ar", at(i), float(ar[i])) for i in range(2_000)]
    got = dict(rows(sp.durbin_watson(spark.createDataFrame(data, "k string, ts timestamp, e double"), Track(("k",)), "e")))
    assert got["white"] == pytest.approx(2.0, abs=0.15)
    assert got["ar"] < 1


def test_ranges_of_a_large_table_hold_a_fixed_number_of_rows(spark, monkeypatch):
    """Twice the rows are twice the ranges, not ranges of twice the size, and looks across their borders stay exact."""
    from thermofleet.operators import track as tr
    from thermofleet.operators.asof import nearest

    monkeypatch.setattr(tr, "LARGE", 500, raising=False)
    monkeypatch.setattr(tr, "RANGE_ROWS", 100, raising=False)
    for n in (1_000, 2_000):
        df = spark.range(n).selectExpr("id % 2 AS k", "timestamp_seconds((id * 7919) % 5000) AS ts", "id")
        cut = tr.Track(("k",), "ts", ("id",)).chunked(df)
        sizes = [c for c in cut.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if c]
        assert sum(sizes) == n and len(sizes) >= n // 200 and max(sizes) < 400
        got = {r.id: r.p for r in tr.numbered(df, tr.Track(("k",), "ts", ("id",)), "p").collect()}
        for k in (0, 1):
            mine = sorted((i * 7919 % 5000, i) for i in range(n) if i % 2 == k)
            assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    left = df.selectExpr("k", "timestamp_seconds(unix_seconds(ts) + 30) AS ts", "id")
    right = df.filter("id % 5 = 0").dropDuplicates(["k", "ts"]).selectExpr("k", "ts", "id AS other")
    found = {r.id: r.right_ts for r in nearest(left, right, ["k"], ["other"], tolerance_seconds=60).collect()}
    times = {k: sorted({i * 7919 % 5000 for i in range(0, n, 5) if i % 2 == k}) for k in (0, 1)}
    for i in range(n):
        at = i * 7919 % 5000 + 30
        best = min(times[i % 2], key=lambda t: (abs(t - at), t))
        assert (None if found[i] is None else int(found[i].timestamp())) == (best if abs(best - at) <= 60 else None)
