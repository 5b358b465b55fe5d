"""Streams fed in several files give what the batch operators give on all of them."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from thermofleet import schemas
from thermofleet.operators import spans as sp
from thermofleet.operators.track import Track
from thermofleet.rules.cooldown import cooldown_scan
from thermofleet.sources.states import states_to_readings
from thermofleet.streaming import jobs as j
from thermofleet.streaming import ordered as o


@pytest.fixture(autouse=True)
def state_store(spark):
    o.use_rocksdb(spark)


def landed(spark, tmp_path, data, schema, parts=3):
    """Files in time order, one per micro-batch."""
    folder = str(tmp_path / "in")
    size = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, stream, tmp_path, name="out"):
    j.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def values(seed, n=90):
    rnd = random.Random(seed)
    return [(rnd.randrange(2), at(i * 3 + rnd.random()), rnd.choice("ab"), str(rnd.randrange(2))) for i in range(n)]


def test_first_write_wins_across_batches(spark, tmp_path):
    data = [(1, at(0), "a", "1"), (1, at(0), "a", "2"), (1, at(5), "a", "3"), (1, at(0), "a", "4"), (1, at(10), "a", "5"), (1, at(5), "a", "6")]
    folder = landed(spark, tmp_path, data, schemas.READINGS)
    got = run(spark, j.first_write_wins(j.read_readings(spark, folder, max_files=1)), tmp_path)
    assert rows(got, "ts") == [(at(0),), (at(5),), (at(10),)]


def test_ingest_equals_batch_keys(spark, tmp_path):
    folder = str(tmp_path / "json")
    for i in range(3):
        part = [(1, "sensor.t", str(60 + k), {}, at(i * 10 + k), at(i * 10 + k)) for k in range(10)]
        spark.createDataFrame(part, schemas.ENTITY_STATES).coalesce(1).write.mode("append").json(folder)
    dims = spark.createDataFrame([(1, "sensor.t", "numeric", "t", None, None, False)], "site_id bigint, entity_id string, kind string, name string, active_state string, mode_control string, has_command boolean")
    got = run(spark, j.ingest(j.read_states(spark, folder, 1), dims), tmp_path)
    from thermofleet.functions.timekeys import round5

    batch = states_to_readings(spark.read.schema(schemas.ENTITY_STATES).json(folder), dims).withColumn("ts", round5(F.col("ts")))
    assert rows(got, "site_id", "ts", "name") == rows(batch.select("site_id", "ts", "name").distinct())


def test_insert_or_ignore_sink(spark, tmp_path):
    data = [(1, at(0), "a", "1"), (1, at(0), "a", "2"), (1, at(5), "a", "3"), (1, at(0), "a", "4"), (1, at(5), "a", "6"), (1, at(10), "a", "5")]
    folder = landed(spark, tmp_path, data, schemas.READINGS)
    out = str(tmp_path / "table")
    stream = j.read_readings(spark, folder, max_files=1)
    j.append_new_batches(stream, out, str(tmp_path / "state"), arrival=F.col("value").cast("int")).awaitTermination()
    assert rows(spark.read.parquet(out), "ts", "value") == [(at(0), "1"), (at(5), "3"), (at(10), "5")]


def test_rollup_rounds_to_the_nearest_mark(spark, tmp_path):
    data = [(1, at(m), "a", str(v)) for m, v in ((0, 1), (2.9, 3), (3, 10), (7, 20), (8, 100), (60, 1), (61, 2))]
    folder = landed(spark, tmp_path, data, schemas.READINGS)
    got = run(spark, j.rollup(j.read_readings(spark, folder, max_files=1)), tmp_path)
    assert rows(got, "ts", "n_rows", "mean_value") == [(at(0), 2, 2.0), (at(5), 2, 15.0), (at(10), 1, 100.0)]


def test_sessions_close_after_the_watermark(spark, tmp_path):
    data = [(1, at(m), "a", "1") for m in (0, 5, 14, 40, 45, 200)]
    folder = landed(spark, tmp_path, data, schemas.READINGS)
    got = run(spark, j.gap_sessions(j.read_readings(spark, folder, max_files=1)), tmp_path)
    assert rows(got, "start_ts", "end_ts", "n_rows") == [(at(0), at(14), 3), (at(40), at(45), 2)]


def shuffled(tmp_path, n=40, per_file=1):
    """Rows in an order far from that of time, `per_file` moments a file; with nulls and ties, and a tick that lands last."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    minutes = [(k * 17 % n) * 9.0 for k in range(n)]
    folder = tmp_path / "in"
    folder.mkdir()
    every = []
    for k in range(0, n, per_file):
        rows = [r for i, m in enumerate(minutes[k:k + per_file], k) for r in ((i % 2, at(m), "a", str(i % 3)), (i % 2, at(m + 1), None, None), (1, at(m), "b", "1"))]
        rows += [(-1, at(n * 9 + 10_000), "tick", None)] * (k + per_file >= n)
        every += rows
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()), strict=True)]
        pq.write_table(pa.table(columns, ["site_id", "ts", "name", "value"]), str(folder / f"p{k:03d}.parquet"))
        os.utime(folder / f"p{k:03d}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return str(folder), [r for r in every if r[0] >= 0]


def judged(data, slot_minutes, per_batch, late_minutes=15):
    """`data` in order of landing, in micro-batches of so many rows: (row, late)."""
    out, newest = [], None
    for k in range(0, len(data), per_batch):
        part = data[k:k + per_batch]
        mark = None if newest is None else newest - pd.Timedelta(minutes=late_minutes)
        out += [(r, mark is not None and pd.Timestamp(r[1]).floor(f"{slot_minutes}min") + pd.Timedelta(minutes=slot_minutes) <= mark) for r in part]
        newest = max([pd.Timestamp(r[1]) for r in part] + [newest] * (newest is not None))
    return out


def series_of(rows):
    out = {}
    for (site, ts, name, value), _ in sorted(rows, key=lambda x: (str(x[0][0]), str(x[0][2]), x[0][1], x[0][3] is not None, x[0][3] or "")):
        out.setdefault((site, name), []).append((ts, value))
    return out


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def test_rows_leave_in_order_and_late_ones_apart(spark, tmp_path):
    """Micro-batches of five files in shuffled order: what is on time equals the plain rule in order of time, the rest is late."""
    folder, data = shuffled(tmp_path)
    stream = lambda: j.read_readings(spark, folder, max_files=5)
    rows = judged(data, 5, 15)
    ontime, late = [x for x in rows if not x[1]], [x[0] for x in rows if x[1]]
    assert len(late) > 20 and len(ontime) > 20

    changes = run(spark, o.change_only(stream()), tmp_path, "changes").filter("site_id >= 0")
    want = []
    for (site, name), own in series_of(ontime).items():
        want += [(site, name, ts, value, False) for k, (ts, value) in enumerate(own) if not k or own[k - 1][1] != value]
    want += [(r[0], r[2], r[1], r[3], True) for r in late]
    assert told(changes) == sorted(want, key=lambda r: tuple(map(str, r)))

    sent = run(spark, o.cooldown(stream().withColumnRenamed("ts", "raised_at"), ["site_id", "name"], 1_800), tmp_path, "sent").filter("site_id >= 0")
    want = [(r[0], r[2], r[1], True) for r in late]
    for (site, name), own in series_of(ontime).items():
        last = None
        for ts, _ in own:
            if last is None or (ts - last).total_seconds() >= 1_800:
                want.append((site, name, ts, False))
                last = ts
    assert told(sent) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_frames_are_bounded_for_a_hot_key(monkeypatch):
    """One key with nearly all rows: blocks and frames stay small, and rows of several blocks leave merged in order."""
    monkeypatch.setattr(o, "FRAME_ROWS", 10)

    class State:
        def __init__(self):
            self.value, self.timers = [], []

        def __getattr__(self, name):
            return {"appendValue": self.value.append, "get": lambda: list(self.value), "exists": lambda: False, "clear": self.value.clear,
                    "put": lambda v: self.value.__setitem__(slice(None), v), "update": lambda v: None, "registerTimer": self.timers.append}[name]

    class Time:
        def __init__(self, minutes):
            self.ms = minutes * 60_000

        def getCurrentWatermarkInMs(self):
            return self.ms

    job = o._Changes(["k", "at", "value", "late"], 5 * o.MINUTE)
    job.handle = job.blocks = State()
    job.carried = State()
    stamps = [(i * 37 % 500) * o.MINUTE // 10 for i in range(500)]
    for k in range(0, 500, 100):
        list(job.handleInputRows(("a",), iter([pd.DataFrame({"at": stamps[k:k + 100], "value": [str(s) for s in stamps[k:k + 100]], "more": None})]), Time(0)))
    assert max(len(block[0]) for block in job.blocks.value) <= 10
    frames = [f for f in job.handleExpiredTimer(("a",), Time(33), None) if len(f)]
    assert max(map(len, frames)) <= 10
    out = pd.concat(frames)["at"].tolist()
    assert out == sorted(s for s in stamps if s < 30 * o.MINUTE) and sum(len(b[0]) for b in job.blocks.value) == 500 - len(out)


def test_late_rows_are_merged_and_the_stream_decides(spark, tmp_path):
    """Merged, the streams equal the batch result; an emptied or changed output of the stream shows."""
    folder, data = shuffled(tmp_path)
    stream = lambda: j.read_readings(spark, folder, max_files=8)
    every = spark.read.schema(schemas.READINGS).parquet(folder).filter("site_id >= 0")

    shifted = stream().withColumn("ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 300) * 300))
    out = run(spark, o.rollup(shifted), tmp_path, "rollup").filter("site_id >= 0").cache()
    window = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 300) * 300)
    number = F.col("value").try_cast("double")
    want = told(every.groupBy("site_id", "name", window.alias("ts")).agg(F.count(F.lit(1)), F.avg(number), F.min(number), F.max(number)))
    assert told(o.merged_rollup(out)) == want
    assert out.filter("late").count() > 0 and out.filter("not late").count() > 0
    assert told(o.merged_rollup(out.filter("late"))) != want
    assert told(o.merged_rollup(out.withColumn("n_rows", F.col("n_rows") + 1))) != want

    by = ["site_id", "name"]
    sessions = run(spark, o.sessions(stream(), by, 600), tmp_path, "sessions").filter("site_id >= 0").cache()
    whole = told(j.gap_sessions(every).select(*by, "start_ts", "end_ts", "n_rows"))
    assert told(o.merged_sessions(sessions, by, 600).select(*by, "start_ts", "end_ts", "n_rows")) == whole
    assert sessions.filter("late").count() > 0 and told(o.merged_sessions(sessions.filter("late"), by, 600)) != whole

    keyed = stream().withColumn("arrival", F.unix_seconds("ts"))
    written = run(spark, o.first_writes(keyed, F.col("arrival")), tmp_path, "first").filter("site_id >= 0").cache()
    keys = told(every.select("site_id", "name", "ts").distinct())
    assert told(o.merged_first_writes(written).select("site_id", "name", "ts")) == keys
    assert told(o.merged_first_writes(written.filter("late")).select("site_id", "name", "ts")) != keys


def test_outcomes_take_the_nearest_reading(spark, tmp_path):
    schema = "site_id bigint, decision_ts timestamp, sensor string, horizon string, wanted_ts timestamp, predicted double"
    readings = [(1, at(m), "a", str(v)) for m, v in ((52, 60), (58, 61), (62, 62), (75, 63), (90, 64), (400, 1), (61, 70), (500, 1), (210, 5))]
    predictions = [(1, at(0), "a", "1h", at(60), 65.0), (1, at(25), "a", "1h", at(85), 65.0), (1, at(140), "a", "1h", at(200), 6.0), (1, at(30), "a", "1h", at(90), 66.0)]
    folder, asked = landed(spark, tmp_path, readings, schemas.READINGS, 9), str(tmp_path / "p")
    for p in predictions:
        spark.createDataFrame([p], schema).coalesce(1).write.mode("append").parquet(asked)
    stream = o.outcomes(j.read_readings(spark, asked, schema, 1), j.read_readings(spark, folder, max_files=1))
    got = run(spark, stream, tmp_path).cache()
    assert set(r["state"] for r in got.collect()) >= {"matched", "late reading"}
    merged = o.merged_outcomes(got, spark.createDataFrame(predictions, schema), spark.createDataFrame(readings, schemas.READINGS))
    assert rows(merged, "decision_ts", "actual", "error") == [(at(0), 70.0, -5.0), (at(25), 64.0, 1.0), (at(30), 64.0, 2.0), (at(140), 5.0, 1.0)]


class Held:
    """State kept in memory, reads of lists and values counted."""

    def __init__(self):
        self.rows, self.reads, self.timers = [], 0, set()
        self.appendValue, self.clear = self.rows.append, self.rows.clear

    getListState = getValueState = lambda self, *_: Held()

    def registerTimer(self, at):
        self.timers.add(at)

    def get(self):
        self.reads += 1
        return iter(self.rows[:])

    def put(self, rows):
        self.rows[:] = rows


class One(Held):
    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0]

    def update(self, row):
        self.rows[:] = [row]


class Handle(Held):
    def getListState(self, *_):
        self.blocks = Held()
        return self.blocks

    def getValueState(self, *_):
        return One()


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at // 1_000


def test_timers_of_one_watermark_read_the_waiting_rows_once():
    waits, handle = o._Outcomes(["site_id", "sensor", "decision", "horizon", "predicted", "actual", "state", "at"], o.MINUTE, 600 * o.MINUTE), Handle()
    waits.init(handle)
    hour, times = 60 * o.MINUTE, [k * o.MINUTE for k in range(40)]
    for t in times:
        asked = {"at": [[t]], "value": [[None]], "more": [[f"{t}|1h|2.0"]], "decision": [[t]], "horizon": [["1h"]], "predicted": [[2.0]]}
        list(waits.handleInputRows((1, "a"), iter([pd.DataFrame(asked)]), Clock(0)))
    seen = {"at": [[20 * o.MINUTE, hour]], "value": [["5.0", "6.0"]], "more": [[None, None]], "decision": [[0, 0]], "horizon": [[None, None]], "predicted": [[None, None]]}
    list(waits.handleInputRows((1, "a"), iter([pd.DataFrame(seen)]), Clock(0)))
    assert len(handle.timers) > 1
    out = [f for _ in handle.timers for f in waits.handleExpiredTimer((1, "a"), Clock(2 * hour), None)]
    told = pd.concat(out).sort_values("decision")
    assert handle.blocks.reads == 1
    assert told["decision"].tolist() == times and told["actual"].tolist() == [5.0] * 40
    assert list(handle.blocks.get()) == []


def test_rows_reach_the_state_in_lists(spark, tmp_path):
    """One row of the state's input holds many readings of a key; none is lost, also without a key or a value."""
    data = [(k % 3 if k % 3 else None, at(k / 60), "a" if k % 2 else None, str(k) if k % 5 else None) for k in range(3_000)]
    r = spark.createDataFrame(data, schemas.READINGS).coalesce(1)
    lists = o._listed(o._keyed(r, ["site_id", "name"], "ts", o.LATE, F.col("value")), ["site_id", "name"])
    assert lists.count() == 12 and lists.agg(F.max(F.size("at"))).first()[0] <= o.LIST_ROWS
    back = lists.select("site_id", "name", F.explode(F.arrays_zip("at", "value")).alias("x")).select("site_id", "name", F.timestamp_micros("x.at").alias("ts"), "x.value")
    assert back.count() == 3_000 and back.exceptAll(r.select("site_id", "name", "ts", "value")).count() == 0


def test_copies_of_a_prediction_meet_an_offer_once(spark):
    asked = spark.createDataFrame([(1, at(0), "a", "1h", at(60), 65.0)] * 300, "site_id bigint, decision_ts timestamp, sensor string, horizon string, wanted_ts timestamp, predicted double")
    seen = spark.createDataFrame([(1, at(61), "a", "60")] * 300, schemas.READINGS)
    told = asked.drop("wanted_ts").withColumns({"actual": F.lit(60.0), "state": F.lit("matched"), "at_ts": F.lit(at(61))})
    merged = o.merged_outcomes(told, asked, seen)
    plan = merged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[next(k for k, line in enumerate(plan) if "Join Inner" in line) + 1]
    assert "Aggregate" in below
    assert rows(merged, "actual", "error") == [(60.0, 5.0)]


def test_heartbeat_follows_the_data(spark, tmp_path):
    data = [(1, at(m), "a", "1") for m in (0, 5, 9)] + [(2, at(m), "a", "1") for m in (1, 8, 30)] + [(1, at(60), "a", "1"), (2, at(61), "a", "1"), (-1, at(900), "t", None)]
    folder = landed(spark, tmp_path, data, schemas.READINGS, 9)
    got = run(spark, o.heartbeat(j.read_readings(spark, folder, max_files=1)), tmp_path).filter("site_id > 0")
    assert rows(got.filter("not late"), "site_id", "status", "last_ts", "n_rows") == sorted([
        (1, "alive", at(0), 1), (1, "stale", at(9), 3), (1, "alive", at(60), 4), (1, "stale", at(60), 4),
        (2, "alive", at(1), 1), (2, "stale", at(8), 2), (2, "alive", at(30), 3), (2, "stale", at(30), 3), (2, "alive", at(61), 4), (2, "stale", at(61), 4),
    ])
