"""Ordered looks day by day: a day is worked from its own rows and one border row per key.

For every key and day a stored edge says how the day looks from outside: its first and last row, the last known value, how
often the value changed and how often a gap was too long inside the day, and the run that is still open at its end. Edges of
consecutive days combine like the rows they stand for, so the state before a day, one row per key, is the state before the
previous day combined with that day's edge, and no earlier reading is read again. A late or corrected day is put anew: its
edge is replaced and the states after it are combined again from edges alone, until one of them comes out as it was.

The looks themselves are the plain ones of `spans` and `grid`, run over the day's rows with the border row before them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import seconds_between
from thermofleet.operators import grid as g
from thermofleet.operators import spans as sp
from thermofleet.operators.asof import asof
from thermofleet.operators.track import Track, carry, previous
from thermofleet.sources.readings import partition_values

PLAIN = ("first_ts", "last_ts", "known", "n_rows", "changes", "breaks", "run_start", "run_rows")


@dataclass(frozen=True)
class DailySeries:
    """Series of rows `by`, ordered by `(ts, *tie)`, with one `value`; edges and states lie under `path`.

    `day` says which part of time a row belongs to (a date, unless the caller says otherwise) and must not decrease with time.
    """

    path: str
    by: tuple[str, ...]
    value: str = "value"
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    gap_seconds: int = 600
    day: Callable[[Column], Column] = F.to_date

    def days(self, spark: SparkSession) -> list[str]:
        return partition_values(spark, f"{self.path}/edges", "day")

    def _track(self, *more: str) -> Track:
        return Track((*self.by, *more), self.ts, self.tie)

    def rows_of(self, rows: DataFrame, day: str) -> DataFrame:
        return rows.filter(self.day(F.col(self.ts)) == F.lit(day).cast("date"))

    def edges(self, rows: DataFrame) -> DataFrame:
        """One row per key and day of `rows`: what the day looks like from outside."""
        dated = rows.withColumn("day", self.day(F.col(self.ts)))
        track, value = self._track("day"), F.col(self.value)
        linked = previous(dated, track, {"__ts": F.col(self.ts), "__v": value, "__any": F.lit(1)}, keep_chunk=True)
        changed = F.col("__any").isNotNull() & ~value.eqNullSafe(F.col("__v"))
        broke = F.coalesce(seconds_between(F.col(self.ts), F.col("__ts")) > self.gap_seconds, F.lit(False))
        run = carry(linked, track, total={"__run": changed.cast("bigint"), "__break": broke.cast("bigint")})
        key = track.order_key()
        # the open run is the one of the last run number; its rows are the rows of that number
        runs = run.groupBy(*self.by, "day", "__run").agg(
            F.min(self.ts).alias("__lo"), F.max(self.ts).alias("__hi"), F.count(F.lit(1)).alias("__n"), F.max("__break").alias("__breaks"),
            F.min_by(F.struct(value.alias("v")), key).alias("__first"), F.max_by(F.struct(value.alias("v")), key).alias("__last"),
            F.max_by(value, F.when(value.isNotNull(), key)).alias("__known"),
        )
        last = lambda c: F.max_by(c, "__run")
        return runs.groupBy(*self.by, "day").agg(
            F.min("__lo").alias("first_ts"), F.max("__hi").alias("last_ts"), F.min_by("__first", "__run").alias("first"), last("__last").alias("last"),
            F.max_by("__known", F.when(F.col("__known").isNotNull(), F.col("__run"))).alias("known"), F.sum("__n").alias("n_rows"),
            F.max("__run").alias("changes"), F.max("__breaks").alias("breaks"), last("__lo").alias("run_start"), last("__n").alias("run_rows"),
        )

    def _combined(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """States and edges of the same keys, one after the other, as states. Null keys are keys."""
        fields = ("first", "last", *PLAIN)
        sides = [d.select(*self.by, F.lit(k).alias("__side"), F.struct(*fields).alias("__x")) for k, d in enumerate((before, after))]
        one = lambda k: F.first(F.when(F.col("__side") == k, F.col("__x")), ignorenulls=True)
        met = sides[0].unionByName(sides[1]).groupBy(*self.by).agg(one(0).alias("a"), one(1).alias("b"))
        a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
        turned = (~F.col("a.last.v").eqNullSafe(F.col("b.first.v"))).cast("bigint")
        broke = (seconds_between(b("first_ts"), a("last_ts")) > self.gap_seconds).cast("bigint")
        same = (turned == 0) & (b("changes") == 0)
        both = {
            "first": a("first"), "last": b("last"), "first_ts": a("first_ts"), "last_ts": b("last_ts"), "known": F.coalesce(b("known"), a("known")),
            "n_rows": a("n_rows") + b("n_rows"), "changes": a("changes") + turned + b("changes"), "breaks": a("breaks") + broke + b("breaks"),
            "run_start": F.when(same, a("run_start")).otherwise(b("run_start")), "run_rows": b("run_rows") + F.when(same, a("run_rows")).otherwise(0),
        }
        pick = lambda c: F.when(F.col("a").isNull(), b(c)).when(F.col("b").isNull(), a(c)).otherwise(both[c])
        return met.select(*self.by, *[pick(c).alias(c) for c in fields])

    def state_before(self, spark: SparkSession, day: str) -> DataFrame | None:
        """One row per key that has rows before the day; None if no day is stored before it."""
        earlier = [d for d in partition_values(spark, f"{self.path}/states", "day") if d < day]
        return spark.read.parquet(f"{self.path}/states/day={earlier[-1]}") if earlier else None

    def put(self, rows: DataFrame, day: str) -> list[str]:
        """Store or replace a day. Returns the stored days, this one first, whose results change by it."""
        spark = rows.sparkSession
        own = self.edges(self.rows_of(rows, day))
        own.drop("day").write.mode("overwrite").parquet(f"{self.path}/edges/day={day}")
        changed, states = [], set(partition_values(spark, f"{self.path}/states", "day"))
        for d in (x for x in self.days(spark) if x >= day):
            changed.append(d)
            edge, before = spark.read.parquet(f"{self.path}/edges/day={d}"), self.state_before(spark, d)
            state = edge if before is None else self._combined(before, edge)
            new = state.select(*self.by, "first", "last", *PLAIN)
            where = f"{self.path}/states/day={d}"
            if d in states:
                old = spark.read.parquet(where).select(new.columns)
                fresh = new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()
                if fresh:
                    break  # what follows starts from the same state as before
            new.write.mode("overwrite").parquet(where)
        return changed

    def _bordered(self, rows: DataFrame, day: str, value: Column) -> tuple[DataFrame, DataFrame | None]:
        """The day's rows with `__border` false, and before them a border row per key with the state's `value`."""
        own = self.rows_of(rows, day).withColumn("__border", F.lit(False))
        state = self.state_before(rows.sparkSession, day)
        if state is None:
            return own, None
        border = state.select(*self.by, F.col("last_ts").alias(self.ts), value.alias(self.value), F.lit(True).alias("__border"))
        return own.unionByName(border, allowMissingColumns=True), state

    def _with_state(self, rows: DataFrame, state: DataFrame | None, *fields: str) -> DataFrame:
        """Rows with state columns of their key (null for new keys)."""
        if state is None:
            types = {"changes": "bigint", "breaks": "bigint", "run_rows": "bigint", "run_start": "timestamp", "last_ts": "timestamp"}
            return rows.withColumns({f"__{f}": F.lit(None).cast(types[f]) for f in fields})
        other = state.select(*[F.col(k).alias(f"__k_{k}") for k in self.by], *[F.col(f).alias(f"__{f}") for f in fields])
        met = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.by]
        return rows.join(other, met, "left").drop(*[f"__k_{k}" for k in self.by])

    def filled(self, rows: DataFrame, day: str) -> DataFrame:
        """The day's rows with the value held from the last known one, of an earlier day if need be."""
        both, _ = self._bordered(rows, day, F.col("known"))
        return g.forward_fill(both, self._track(), [self.value]).filter(~F.col("__border")).drop("__border")

    def compacted(self, rows: DataFrame, day: str) -> DataFrame:
        """The day's rows whose value differs from the one before, of an earlier day if need be."""
        both, _ = self._bordered(rows, day, F.col("last.v"))
        return sp.change_only(both, self._track(), self.value).filter(~F.col("__border")).drop("__border")

    def segmented(self, rows: DataFrame, day: str, into: str = "segment_id") -> DataFrame:
        """The day's rows with the number of their gap-bounded segment, counted from the key's first row."""
        both, state = self._bordered(rows, day, F.lit(None).cast(dict(rows.dtypes)[self.value]))
        tagged = sp.gap_segments(both, self._track(), self.gap_seconds, into=into).filter(~F.col("__border")).drop("__border")
        placed = self._with_state(tagged, state, "breaks")
        return placed.withColumn(into, F.col(into) + F.coalesce("__breaks", F.lit(0))).drop("__breaks")

    def spans(self, rows: DataFrame, day: str) -> DataFrame:
        """Runs of one value that have rows on the day: run_no, value, start_ts, end_ts, n_rows, and whether the day ended in
        them (`open`). A run that goes on from an earlier day comes with all of its rows, so its row replaces the earlier one."""
        both, state = self._bordered(rows, day, F.col("last.v"))
        linked = previous(both, self._track(), {"__prev": F.col(self.value), "__any": F.lit(1)}, keep_chunk=True)
        turned = F.col("__any").isNotNull() & ~F.col(self.value).eqNullSafe(F.col("__prev"))
        tagged = carry(linked, self._track(), total={"__run": turned.cast("bigint")})
        runs = tagged.groupBy(*self.by, "__run").agg(
            F.first(F.struct(F.col(self.value).alias("v"))).alias("__v"), F.min(F.when(~F.col("__border"), F.col(self.ts))).alias("start_ts"),
            F.max(self.ts).alias("end_ts"), F.count_if(~F.col("__border")).alias("n_rows"), F.max("__border").alias("__goes_on"),
        )
        ends = runs.groupBy(*self.by).agg(F.max("__run").alias("__end"))
        same = [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in self.by]
        runs = runs.join(ends.select(*[F.col(k).alias(f"__e_{k}") for k in self.by], "__end"), same).filter("n_rows > 0")
        placed = self._with_state(runs, state, "changes", "run_start", "run_rows")
        return placed.select(
            *self.by, (F.col("__run") + F.coalesce("__changes", F.lit(0)) + 1).alias("run_no"), F.col("__v.v").alias(self.value),
            F.when(F.col("__goes_on"), F.col("__run_start")).otherwise(F.col("start_ts")).alias("start_ts"), "end_ts",
            (F.col("n_rows") + F.when(F.col("__goes_on"), F.col("__run_rows")).otherwise(0)).alias("n_rows"), (F.col("__run") == F.col("__end")).alias("open"),
        )

    def gridded(self, rows: DataFrame, day: str, step_seconds: int = g.STEP) -> DataFrame:
        """Ticks after the key's last row of an earlier day, up to its last row of this one, with the value held.

        The ticks of all days together are those from the first to the last row of the key.
        """
        both, state = self._bordered(rows, day, F.col("known"))
        ticks = self._with_state(g.grid(both, self.by, step_seconds, ts=self.ts), state, "last_ts")
        new = ticks.filter(F.col("__last_ts").isNull() | (F.col(self.ts) > F.col("__last_ts"))).drop("__last_ts")
        held = asof(new, both.filter(F.col(self.value).isNotNull()), self.by, [self.value], left_ts=self.ts, right_ts=self.ts, tie=self.tie)
        return held.withColumnRenamed(f"right_{self.value}", self.value).drop("right_ts")
