"""Keyed streaming in order of event time, with nothing dropped.

Rows wait in their key's state until the watermark has passed the slot of time they lie in; a timer then releases all rows that
are due, merged in order, and they leave in frames of bounded size. A row whose slot the watermark had already passed when it
came is late: it does not enter the state and leaves the stream at once, marked `late`, so a sink can keep it in a table of its
own and a tail job can merge it. What a key holds is the rows of the slots that are still open, in sorted blocks that are
appended without reading the others, and a few numbers that a job carries from row to row. Files per trigger bound what one
micro-batch adds to a key.

The watermark follows a copy of the time column that does not reach the stateful step, so Spark filters no row before it.
State is kept in RocksDB; `use_rocksdb` sets it for the queries a session starts afterwards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from heapq import merge

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from thermofleet.functions.timekeys import add_seconds, seconds_between
from thermofleet.operators.asof import nearest
from thermofleet.operators.track import Track, carry

LATE = "15 minutes"
FRAME_ROWS = 4_096
LIST_ROWS = 256
MINUTE = 60_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _blocks(*columns: list) -> Iterator[tuple]:
    for k in range(0, len(columns[0]), FRAME_ROWS):
        yield tuple(c[k:k + FRAME_ROWS] for c in columns)


def _packed(rows: pd.DataFrame, types: dict[str, str]) -> bytes:
    """Rows as one compressed Arrow batch."""
    batch = pa.record_batch([pa.array(rows[c], type=pa.type_for_alias(t), from_pandas=True) for c, t in types.items()], names=list(types))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_pandas()


class _Framed(StatefulProcessor):
    """Output in frames of bounded size; input in lists (`_listed`) of `COLUMNS`, or rows."""

    COLUMNS: tuple[str, ...] = ()

    def __init__(self, columns: Sequence[str], slot: int):
        self.columns, self.slot = list(columns), slot

    def close(self) -> None:
        pass

    def frames(self, key: tuple, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for row in rows:
            held.append((*key, *row))
            if len(held) == FRAME_ROWS:
                yield pd.DataFrame(held, columns=self.columns)
                held = []
        yield pd.DataFrame(held, columns=self.columns)

    def flat(self, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(part[c].tolist()) for c in self.COLUMNS}) if part["at"].dtype == object else part

    def wake(self, at: int) -> None:
        """Set a timer for the end of the slot that holds `at`."""
        self.handle.registerTimer((at // self.slot + 1) * self.slot // 1_000)

    def due(self, timer_values) -> int:
        """All slots up to here are over."""
        return timer_values.getCurrentWatermarkInMs() * 1_000 // self.slot * self.slot


def _order(row: tuple) -> tuple:
    at, value, more = row
    return at, more or "", value is not None, value or ""


class InOrder(_Framed):
    """Takes the rows (at, value, more) of a key one by one in order of time.

    `take` gets a row and what is carried and returns output rows (the columns after the key) and what to carry on. `passed`
    is told how far all rows are taken; `wake_at` says when it should hear of that next. A late row leaves as `late_row`.
    """

    CARRY = "at bigint"
    COLUMNS = ("at", "value", "more")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "at array<bigint>, value array<string>, more array<string>")
        self.carried = handle.getValueState("carried", self.CARRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due(timerValues)
        for part in map(self.flat, rows):
            value, more = (part[c].astype(object).where(part[c].notna(), None) for c in ("value", "more"))
            every = sorted(zip(part["at"].tolist(), value, more, strict=True), key=_order)
            kept = bisect_left(every, due, key=lambda r: r[0])
            yield from self.frames(key, (self.late_row(*r) for r in every[:kept]))
            if every := every[kept:]:
                for block in _blocks(*map(list, zip(*every, strict=True))):
                    self.blocks.appendValue(block)
                self.wake(every[0][0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, ready, rest = self.due(timerValues), [], []
        for block in self.blocks.get():
            cut = bisect_left(block[0], due)
            ready.append([list(c[:cut]) for c in block])
            if cut < len(block[0]):
                rest.append(tuple(list(c[cut:]) for c in block))
        if any(block[0] for block in ready):
            if rest:
                self.blocks.put(rest)
                self.wake(min(block[0][0] for block in rest))
            else:
                self.blocks.clear()
        yield from self.frames(key, self.taken(ready, due))

    def taken(self, blocks: list, due: int) -> Iterator[tuple]:
        carried = self.carried.get() if self.carried.exists() else None
        for row in merge(*(zip(*block, strict=True) for block in blocks), key=_order):
            out, carried = self.take(row, carried)
            yield from out
        out, carried = self.passed(due, carried)
        yield from out
        if carried is None:
            self.carried.clear()
        else:
            self.carried.update(carried)
            if (at := self.wake_at(carried)) is not None:
                self.wake(at)

    def take(self, row: tuple, carried: tuple | None) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def passed(self, due: int, carried: tuple | None) -> tuple[list[tuple], tuple | None]:
        return [], carried

    def wake_at(self, carried: tuple) -> int | None:
        return None

    def late_row(self, at: int, value, more) -> tuple:
        return at, value, True


class _Changes(InOrder):
    CARRY = "value string"

    def take(self, row, carried):
        at, value, _ = row
        return [(at, value, False)] if carried is None or carried[0] != value else [], (value,)


class _Cooldown(InOrder):
    def __init__(self, columns, slot, wait: int):
        super().__init__(columns, slot)
        self.wait = wait

    def take(self, row, carried):
        at = row[0]
        return ([(at, False)], (at,)) if carried is None or at - carried[0] >= self.wait else ([], carried)

    def passed(self, due, carried):
        return [], None if carried is not None and carried[0] + self.wait <= due else carried

    def wake_at(self, carried):
        return carried[0] + self.wait

    def late_row(self, at, value, more):
        return at, True


class _Sessions(InOrder):
    CARRY = "start bigint, stop bigint, n bigint"

    def __init__(self, columns, slot, gap: int):
        super().__init__(columns, slot)
        self.gap = gap

    def take(self, row, carried):
        out, carried = self.passed(row[0], carried)
        return out, (row[0], row[0], 1) if carried is None else (carried[0], row[0], carried[2] + 1)

    def passed(self, due, carried):
        return ([(*carried, False)], None) if carried is not None and carried[1] + self.gap <= due else ([], carried)

    def wake_at(self, carried):
        return carried[1] + self.gap

    def late_row(self, at, value, more):
        return at, at, 1, True


class _Beats(InOrder):
    CARRY = "last bigint, n bigint, stale boolean"

    def __init__(self, columns, slot, silent: int):
        super().__init__(columns, slot)
        self.silent = silent

    def take(self, row, carried):
        out, (_, n, stale) = self.passed(row[0], carried or (row[0], 0, True))
        return [*out, *([("alive", row[0], n + 1, False)] if stale else [])], (row[0], n + 1, False)

    def passed(self, due, carried):
        if carried is not None and not carried[2] and carried[0] + self.silent < due:
            return [("stale", carried[0], carried[1], False)], (carried[0], carried[1], True)
        return [], carried

    def wake_at(self, carried):
        return None if carried[2] else carried[0] + self.silent

    def late_row(self, at, value, more):
        return "late", at, 1, True


class _Outcomes(_Framed):
    """Readings have a value, predictions (at: the time they want) have none. Only the reading before a wanted time and the one
    after it can be the nearest, so a key carries its last reading and the predictions that wait. Rows wait as Arrow blocks, each
    in order of time; of the timers that run out under one watermark the first takes all rows that are due and looks them up at
    once in the ordered readings."""

    CARRY = "last bigint, actual double, waiting binary"
    BLOCK = {"at": "int64", "value": "string", "decision": "int64", "horizon": "string", "predicted": "float64"}
    COLUMNS = tuple(BLOCK)

    def __init__(self, columns, slot, tolerance: int):
        super().__init__(columns, slot)
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "block binary")
        self.carried = handle.getValueState("carried", self.CARRY)
        self.over = handle.getValueState("over", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due(timerValues)
        for part in map(self.flat, rows):
            every = self.sorted(part[list(self.BLOCK)])
            kept = int(every["at"].searchsorted(due))
            yield from self.late(key, every.iloc[:kept])
            if kept < len(every):
                self.hold(every.iloc[kept:])
                self.wake(int(every["at"].iloc[kept]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due(timerValues)
        if self.over.exists() and self.over.get()[0] >= due:
            return
        self.over.update((due,))
        ready, rest = [], []
        for (block,) in self.blocks.get():
            held = _unpacked(block)
            cut = int(held["at"].searchsorted(due))
            ready.append(held.iloc[:cut])
            if cut < len(held):
                rest.append((int(held["at"].iloc[cut]), held.iloc[cut:] if cut else block))
        if any(len(part) for part in ready):
            self.blocks.clear()
            for _, block in rest:
                if isinstance(block, bytes):
                    self.blocks.appendValue((block,))
                else:
                    self.hold(block)
            if rest:
                self.wake(min(at for at, _ in rest))
        yield from self.taken(key, ready, due)

    def hold(self, rows: pd.DataFrame) -> None:
        for k in range(0, len(rows), FRAME_ROWS):
            self.blocks.appendValue((_packed(rows.iloc[k:k + FRAME_ROWS], self.BLOCK),))

    def sorted(self, rows):
        every = rows.iloc[rows["at"].to_numpy().argsort(kind="stable")]
        at, value = every["at"].to_numpy(), every["value"].fillna("").to_numpy()
        if ((at[1:] == at[:-1]) & (value[1:] != value[:-1])).any():  # readings of one instant go by value
            every = every.assign(__text=value).sort_values(["at", "__text"], kind="stable").drop(columns="__text")
        return every

    def late(self, key, rows):
        seen = rows["value"].notna()
        readings, asked = rows[seen], rows[~seen]
        yield from self.told(key, readings.assign(decision=None, horizon=None, predicted=None), readings["value"].astype(float), "late reading", readings["at"])
        yield from self.told(key, asked, None, "late prediction", asked["at"])

    def taken(self, key, blocks, due):
        last, actual, waiting = self.carried.get() if self.carried.exists() else (None, None, None)
        if last is None and waiting is None and not any(len(b) for b in blocks):
            return
        rows = self.sorted(pd.concat(blocks)) if blocks else pd.DataFrame(columns=list(self.BLOCK))
        seen = rows["value"].notna()
        at, value = rows.loc[seen, "at"].to_numpy("int64"), rows.loc[seen, "value"].to_numpy().astype(float)
        if last is not None:
            at, value = np.append(last, at), np.append(np.nan if actual is None else actual, value)
        asked = rows[~seen]
        if waiting is not None:
            asked = pd.concat([_unpacked(waiting), asked]) if len(asked) else _unpacked(waiting)
        wanted, far = asked["at"].to_numpy("int64"), self.tolerance + 1
        after = at.searchsorted(wanted, side="right")
        back, ahead = np.full(len(wanted), far), np.full(len(wanted), far)
        has_back, has_ahead = after > 0, after < len(at)
        back[has_back] = np.minimum(wanted[has_back] - at[after[has_back] - 1], far)
        ahead[has_ahead] = np.minimum(at[after[has_ahead]] - wanted[has_ahead], far)
        settled = has_ahead | (back == 0) | (wanted + self.tolerance < due)
        found = settled & (np.minimum(back, ahead) < far)
        pick = np.where(ahead < back, after, after - 1)[found]
        yield from self.told(key, asked[found], value[pick], "matched", at[pick])
        left = asked[~settled]
        if len(at):
            last, actual = int(at[-1]), None if np.isnan(value[-1]) else float(value[-1])
        self.carried.update((last, actual, _packed(left, self.BLOCK) if len(left) else None))
        if len(left):
            self.wake(int(left["at"].min()) + self.tolerance)

    def told(self, key: tuple, rows: pd.DataFrame, actual, state: str, at) -> Iterator[pd.DataFrame]:
        out = rows[["decision", "horizon", "predicted"]].assign(actual=actual, state=state, at=at)
        for k, (name, of) in enumerate(zip(self.columns, key, strict=False)):
            out.insert(k, name, of)
        for k in range(0, len(out), FRAME_ROWS):
            yield out.iloc[k:k + FRAME_ROWS].reset_index(drop=True)


class _Rollup(_Framed):
    """Partial sums per window (a slot) instead of rows; those of late rows leave at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "at array<bigint>, n array<bigint>, known array<bigint>, total array<double>, low array<double>, high array<double>")

    def handleInputRows(self, key, rows, timerValues):
        due = self.due(timerValues)
        for part in rows:
            number = pd.to_numeric(part["value"], errors="coerce")
            sums = number.groupby(part["at"] // self.slot * self.slot).agg(["size", "count", "sum", "min", "max"])
            late = sums.index < due
            yield from self.frames(key, ((*r, True) for r in self.rows(sums[late])))
            if not late.all():
                for block in _blocks(*map(list, zip(*self.rows(sums[~late]), strict=True))):
                    self.blocks.appendValue(block)
                self.wake(int(sums.index[~late].min()))

    def rows(self, sums: pd.DataFrame) -> Iterator[tuple]:
        for at, n, known, total, low, high in sums.itertuples():
            yield (int(at), int(n), int(known), float(total), *((float(low), float(high)) if known else (None, None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.due(timerValues)
        held = [pd.DataFrame(dict(zip(("at", "size", "count", "sum", "min", "max"), map(list, block), strict=True)), dtype=None) for block in self.blocks.get()]
        if not held:
            return
        every = pd.concat(held).astype({"min": float, "max": float}).groupby("at").agg({"size": "sum", "count": "sum", "sum": "sum", "min": "min", "max": "max"})
        over = every.index < due
        if over.any():
            rest = list(_blocks(*map(list, zip(*self.rows(every[~over]), strict=True)))) if not over.all() else []
            if rest:
                self.blocks.put(rest)
                self.wake(int(every.index[~over].min()))
            else:
                self.blocks.clear()
        yield from self.frames(key, ((*r, False) for r in self.rows(every[over])))


class _FirstWrites(_Framed):
    """The first row of a key and mark goes out at once; marks are remembered until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", "at array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        due, first = self.due(timerValues), {}  # one entry per mark of this micro-batch
        for part in rows:
            value = part["value"].astype(object).where(part["value"].notna(), None)
            for at, arrival, text in zip(part["at"].tolist(), part["arrival"].tolist(), value, strict=True):
                if at not in first or arrival < first[at][0]:
                    first[at] = arrival, text
        written = {at for at in self.marks.get()[0] if at >= due} if self.marks.exists() else set()
        out = [(at, text, arrival, at < due) for at, (arrival, text) in first.items() if at not in written]
        if written := written | {at for at in first if at >= due}:
            self.marks.update((sorted(written),))
            self.wake(max(written))
        yield from self.frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.due(timerValues)
        if self.marks.exists() and max(self.marks.get()[0]) < due:
            self.marks.clear()
        yield pd.DataFrame([], columns=self.columns)


def _keyed(rows: DataFrame, by: Sequence[str], ts: str, late: str, value: Column | None = None, more: Column | None = None, **extra: Column) -> DataFrame:
    """Key, at (microseconds), value, more; the watermark's column stays behind."""
    marked = rows.filter(F.col(ts).isNotNull()).withColumn("__mark", F.col(ts)).withWatermark("__mark", late)
    empty = F.lit(None).cast("string")
    return marked.select(*by, F.unix_micros(F.col(ts)).alias("at"), (empty if value is None else value.cast("string")).alias("value"), (empty if more is None else more).alias("more"), *[c.alias(k) for k, c in extra.items()])


def _listed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of a key that lie in one Arrow batch as lists of at most `LIST_ROWS`, column by column: Spark hands rows to the
    state's worker one by one, lists cross as they are."""
    by = list(by)
    schema = ", ".join(f"`{c}` {t}" if c in by else f"`{c}` array<{t}>" for c, t in rows.dtypes)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for c in by:
                each = batch.column(c).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(each.dictionary) + each.indices.to_numpy(), return_inverse=True)[1]
            order = code.argsort(kind="stable")
            first = np.searchsorted(code[order], np.arange(code.max() + 1))
            inside = np.arange(len(order)) - first[code[order]]
            cuts = np.flatnonzero(inside % LIST_ROWS == 0)
            dealt, offsets = batch.take(pa.array(order)), pa.array(np.append(cuts, len(order)), type=pa.int32())
            columns = [dealt.column(c).take(pa.array(cuts)) if c in by else pa.ListArray.from_arrays(offsets, dealt.column(c)) for c in batch.schema.names]
            yield pa.record_batch(columns, names=batch.schema.names)

    return rows.mapInArrow(lists, schema)


def _run(rows: DataFrame, by: Sequence[str], processor: type, out: str, *args) -> DataFrame:
    types = dict(rows.dtypes)
    if processor.COLUMNS:
        rows = _listed(rows, by)
    schema = f"{', '.join(f'{k} {types[k]}' for k in by)}, {out}"
    columns = [c.strip().split()[0] for c in schema.split(",")]
    return rows.groupBy(*by).transformWithStateInPandas(processor(columns, *args), schema, "Append", "EventTime")


def change_only(readings: DataFrame, by: Sequence[str] = ("site_id", "name"), ts: str = "ts", late: str = LATE, slot: int = 5 * MINUTE,
                tie: Column | None = None) -> DataFrame:
    """(by, ts, value, late): rows that differ from the one before them in time, and the late rows. `tie` (a string) orders
    rows of one instant; without it they go by value."""
    out = _run(_keyed(readings, by, ts, late, F.col("value"), tie), by, _Changes, "at bigint, value string, late boolean", slot)
    return out.select(*by, F.timestamp_micros("at").alias(ts), "value", "late")


def cooldown(alerts: DataFrame, by: Sequence[str], cooldown_seconds: int, at: str = "raised_at", late: str = LATE, slot: int = 5 * MINUTE) -> DataFrame:
    """(by, at, late): the alerts to send, each at least a cooldown after the one sent before, and the late ones."""
    out = _run(_keyed(alerts, by, at, late), by, _Cooldown, "at bigint, late boolean", slot, cooldown_seconds * 1_000_000)
    return out.select(*by, F.timestamp_micros("at").alias(at), "late")


def sessions(readings: DataFrame, by: Sequence[str], gap_seconds: int, ts: str = "ts", late: str = LATE, slot: int = 5 * MINUTE) -> DataFrame:
    """(by, start_ts, end_ts, n_rows, late): sessions that are over, and each late row as a session of its own."""
    out = _run(_keyed(readings, by, ts, late), by, _Sessions, "start bigint, stop bigint, n_rows bigint, late boolean", slot, gap_seconds * 1_000_000)
    return out.select(*by, F.timestamp_micros("start").alias("start_ts"), F.timestamp_micros("stop").alias("end_ts"), "n_rows", "late")


def heartbeat(readings: DataFrame, by: Sequence[str] = ("site_id",), silent_seconds: int = 600, ts: str = "ts", late: str = LATE, slot: int = 5 * MINUTE) -> DataFrame:
    """(by, status, last_ts, n_rows, late): `alive` when a key reports after silence, `stale` once it has been silent for longer.

    Time is that of the data: any row moves the watermark, also one of a key that only ticks.
    """
    out = _run(_keyed(readings, by, ts, late), by, _Beats, "status string, at bigint, n_rows bigint, late boolean", slot, silent_seconds * 1_000_000)
    return out.select(*by, "status", F.timestamp_micros("at").alias("last_ts"), "n_rows", "late")


def rollup(readings: DataFrame, by: Sequence[str] = ("site_id", "name"), width_seconds: int = 300, ts: str = "ts", late: str = LATE) -> DataFrame:
    """(by, ts, n_rows, n_known, total, min_value, max_value, late): closed windows from `ts` on, and what late rows add to theirs."""
    out = _run(_keyed(readings, by, ts, late, F.col("value").try_cast("double")), by, _Rollup, "at bigint, n_rows bigint, n_known bigint, total double, min_value double, max_value double, late boolean", width_seconds * 1_000_000)
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", ts)


def first_writes(readings: DataFrame, arrival: Column, by: Sequence[str] = ("site_id", "name"), width_seconds: int = 300, ts: str = "ts", late: str = LATE) -> DataFrame:
    """(by, ts, value, arrival, late): the first row of each key and time mark, and of late rows the first in their micro-batch."""
    out = _run(_keyed(readings, by, ts, late, F.col("value"), arrival=arrival.cast("bigint")), by, _FirstWrites, "at bigint, value string, arrival bigint, late boolean", width_seconds * 1_000_000)
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", ts)


def outcomes(predictions: DataFrame, readings: DataFrame, tolerance_seconds: int = 600, late: str = LATE, slot: int = 5 * MINUTE) -> DataFrame:
    """Predictions `(site_id, decision_ts, sensor, horizon, wanted_ts, predicted)` with the nearest reading of their site and
    sensor within the tolerance, the earlier of two equally near: state `matched` with the reading's time, actual and error, or
    `late prediction` and `late reading` with its own time (`at_ts`) for rows that came too late to take part."""
    number = F.col("value").try_cast("double")
    wanted = predictions.select("site_id", "sensor", F.col("wanted_ts").alias("__ts"), F.lit(None).cast("double").alias("__value"), F.unix_micros("decision_ts").alias("decision"), "horizon", F.col("predicted").cast("double").alias("predicted"))
    seen = readings.filter(number.isNotNull()).select("site_id", F.col("name").alias("sensor"), F.col("ts").alias("__ts"), number.alias("__value"), F.lit(0).cast("bigint").alias("decision"), F.lit(None).cast("string").alias("horizon"), F.lit(None).cast("double").alias("predicted"))
    by = ["site_id", "sensor"]
    rows = _keyed(wanted.unionByName(seen), by, "__ts", late, F.col("__value"), **{c: F.col(c) for c in ("decision", "horizon", "predicted")})
    rows = rows.filter(F.col("site_id").isNotNull())  # what has no site has no partner
    out = _run(rows, by, _Outcomes, "decision bigint, horizon string, predicted double, actual double, state string, at bigint", slot, tolerance_seconds * 1_000_000)
    return out.select(
        "site_id", F.timestamp_micros("decision").alias("decision_ts"), "sensor", "horizon", "predicted", "actual",
        F.round(F.col("predicted") - F.col("actual"), 3).alias("error"), "state", F.timestamp_micros("at").alias("at_ts"),
    )


def merged_rollup(rows: DataFrame, by: Sequence[str] = ("site_id", "name"), ts: str = "ts") -> DataFrame:
    """Closed windows with what late rows add to them; no reading is read again."""
    return rows.groupBy(*by, ts).agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("total") / F.nullif(F.sum("n_known"), F.lit(0))).alias("mean_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
    )


def merged_sessions(rows: DataFrame, by: Sequence[str], gap_seconds: int) -> DataFrame:
    """Sessions that late rows lengthen, join or begin: spans that lie closer than the gap become one.

    Every span opens at its start and closes a gap after its end; a session lasts while anything is open.
    """
    spans = rows.select(*by, "start_ts", "end_ts", "n_rows")
    opens = spans.select(*by, F.col("start_ts").alias("__at"), F.lit(1).alias("__step"), "start_ts", "end_ts", "n_rows")
    closes = spans.select(*by, add_seconds(F.col("end_ts"), gap_seconds).alias("__at"), F.lit(-1).alias("__step"), "start_ts", "end_ts", "n_rows")
    track = Track(tuple(by), "__at", ("__step", "start_ts", "end_ts", "n_rows"))
    lying = carry(opens.unionByName(closes), track, total={"__open": F.col("__step").cast("bigint")}, keep_chunk=True)
    begins = (F.col("__step") == 1) & (F.col("__open") == 1)
    tagged = carry(lying, track, total={"__run": begins.cast("bigint")}).filter("__step = 1")
    return tagged.groupBy(*by, "__run").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_rows").alias("n_rows")
    ).drop("__run")


def merged_first_writes(rows: DataFrame, by: Sequence[str] = ("site_id", "name"), ts: str = "ts") -> DataFrame:
    """What the stream wrote first, and of keys it never wrote the late row that arrived first."""
    return rows.groupBy(*by, ts).agg(F.min_by("value", F.struct("late", "arrival")).alias("value"))


def merged_outcomes(rows: DataFrame, predictions: DataFrame, readings: DataFrame, tolerance_seconds: int = 600) -> DataFrame:
    """Outcomes of all predictions: the stream's, or a late reading where that is nearer; late predictions meet all readings.

    Only late rows are matched again: late readings with the predictions, late predictions with the readings.
    """
    key = ["site_id", "sensor", "decision_ts", "horizon"]
    by, number = ["site_id", "sensor"], F.col("value").try_cast("double")
    matched = rows.filter("state = 'matched'").select(*key, F.col("at_ts").alias("r_ts"), "actual")
    behind = rows.filter("state = 'late reading'").select(*by, F.col("at_ts").alias("ts"), "actual").groupBy(*by, "ts").agg(F.min("actual").alias("actual"))
    late = rows.filter("state = 'late prediction'").select(*key, F.col("at_ts").alias("wanted_ts"), "predicted").distinct()
    every = readings.filter(number.isNotNull()).select("site_id", F.col("name").alias("sensor"), "ts", number.alias("actual")).groupBy(*by, "ts").agg(F.min("actual").alias("actual"))
    look = {"by": by, "values": ["actual"], "left_ts": "wanted_ts", "tolerance_seconds": tolerance_seconds, "prefix": "r_"}
    found = [nearest(predictions, behind, **look), nearest(late, every, **look)]
    again = [f.filter(F.col("r_ts").isNotNull()).select(*key, "r_ts", F.col("r_actual").alias("actual")) for f in found]
    offers = matched.unionByName(again[0]).unionByName(again[1])
    # copies of a prediction meet copies of an offer once; both sides lie by key from here on
    offers = offers.repartition(*key).dropDuplicates()
    wanted = predictions.select(*key, "wanted_ts", "predicted").repartition(*key).dropDuplicates()
    gap = F.abs(seconds_between(F.col("r_ts"), F.col("wanted_ts")))
    out = offers.join(wanted, key).groupBy(*key, "predicted").agg(F.min_by("actual", F.struct(gap, F.col("r_ts"))).alias("actual"))
    return out.withColumn("error", F.round(F.col("predicted") - F.col("actual"), 3))
