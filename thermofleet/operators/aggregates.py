"""Reports that are one or two aggregations. All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(readings: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    return readings.groupBy(*by).agg(F.max("ts").alias("latest_ts"), F.count(F.lit(1)).alias("n_rows"))


def table_stats(readings: DataFrame, by: Sequence[str] = ("site_id",), approximate: bool = False) -> DataFrame:
    """Distinct timestamps and names, span and size. Exact distinct counts go through distinct pairs, which
    spreads a hot site over tasks; `approximate` uses sketches instead."""
    if approximate:
        return readings.groupBy(*by).agg(
            F.approx_count_distinct("ts").alias("n_timestamps"),
            F.approx_count_distinct("name").alias("n_names"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("latest_ts"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    stamps = readings.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("n"))
    names = readings.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))
    a = stamps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_timestamps"), F.min("ts").alias("first_ts"), F.max("ts").alias("latest_ts"),
        F.sum("n").alias("n_rows"),
    )
    b = names.groupBy(*by).agg(F.count(F.lit(1)).alias("n_names"))
    return a.join(b, list(by))


def latest_snapshot(readings: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """All rows at a key's newest timestamp, by a join with the maxima (one row per key)."""
    newest = readings.groupBy(*by).agg(F.max("ts").alias("ts"))
    return readings.join(newest, [*by, "ts"], "left_semi")


def latest_per_name(readings: DataFrame, by: Sequence[str] = ("site_id", "name"), order: Column | None = None,
                    active_above: float = 0.5) -> DataFrame:
    """Newest value of every name, however long ago it was written, and whether it reads as active."""
    order = order if order is not None else F.col("ts")
    picked = readings.groupBy(*by).agg(F.max_by("value", order).alias("value"), F.max("ts").alias("ts"))
    return picked.withColumn("active", F.col("value").try_cast("double") > active_above)


def best_gain(gains: DataFrame, effectors: DataFrame, by: Sequence[str] = ("site_id", "sensor"),
              control_type: str = "trajectory", order: str | None = None) -> DataFrame:
    """Strongest positive gain per sensor among effectors of one control type; the first listed wins a tie."""
    kind = effectors.filter(F.col("control_type") == control_type).select("site_id", F.col("name").alias("effector"))
    candidates = gains.filter(F.col("gain_f_per_hour") > 0).join(kind, ["site_id", "effector"], "left_semi")
    rank = F.struct(-F.col("gain_f_per_hour"), F.col(order or "effector"))
    return candidates.groupBy(*by).agg(
        F.min_by("effector", rank).alias("effector"), F.max("gain_f_per_hour").alias("gain_f_per_hour")
    )


def _narrowed(mass: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    """Only the values of the range that holds each key's half (and one it borders on exactly).

    `mass` has `__v`, `__w`, the weight `__base` that lies before its first value, and `__half` once it is known.
    """
    points = F.percentile_approx("__v", F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), F.lit(1_000))
    edges = mass.groupBy(*keys).agg(F.array_sort(F.array_distinct(points)).alias("__edges"))
    placed = mass.join(edges, keys).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")
    run = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "__range").agg(F.sum("__w").alias("__rw"), F.max("__base").alias("__base"), F.max("__half").alias("__half"))
    totals = totals.withColumns({
        "__cum": F.col("__base") + F.sum("__rw").over(run), "__half": F.coalesce("__half", F.sum("__rw").over(whole) / 2.0)
    }).withColumn("__before", F.col("__cum") - F.col("__rw"))
    holding = totals.filter((F.col("__before") <= F.col("__half")) & (F.col("__cum") >= F.col("__half")))
    holding = holding.select(*keys, "__range", F.min("__before").over(whole).alias("__base"), "__half")
    return placed.drop("__base", "__half").join(holding, [*keys, "__range"]).drop("__range")


def middle_values(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, cuts: int = 128) -> DataFrame:
    """`lower` and `upper` per key: the smallest values whose cumulative weight reaches, and exceeds, half.

    Exact without holding or sorting a key's values in one place. Weights are summed per distinct value; a
    quantile sketch cuts each key's values into ranges; range totals tell which range holds the half. That range is
    cut again, so that about one of `cuts`² parts of a key's distinct values is left to be ranked.
    """
    keys = list(by)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    mass = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(amount.alias("__w"))
    mass = mass.withColumns({"__base": F.lit(0).cast(mass.schema["__w"].dataType), "__half": F.lit(None).cast("double")})
    inside = _narrowed(_narrowed(mass, keys, cuts), keys, cuts)
    rank = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("__at", F.col("__base") + F.sum("__w").over(rank))
    return ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("__at") >= F.col("__half"), F.col("__v"))).alias("lower"),
        F.min(F.when(F.col("__at") > F.col("__half"), F.col("__v"))).alias("upper"),
    )


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, decimals: int | None = 1,
                    into: str = "weighted_median") -> DataFrame:
    """Smallest value whose cumulative weight reaches half the total."""
    found = middle_values(df, by, value, weight).select(*by, F.col("lower").alias(into))
    return found if decimals is None else found.withColumn(into, F.round(into, decimals))


def median(df: DataFrame, by: Sequence[str], value: str, into: str = "median") -> DataFrame:
    """Exact median: the mean of the two middle values for an even count."""
    found = middle_values(df, by, value)
    return found.select(*by, ((F.col("lower") + F.coalesce("upper", "lower")) / 2.0).alias(into))


def accuracy_by_horizon(outcomes: DataFrame, by: Sequence[str] = ("site_id", "horizon"),
                        newer_than: Column | None = None, decimals: int = 3) -> DataFrame:
    rows = outcomes.filter(F.col("error").isNotNull())
    if newer_than is not None:
        rows = rows.filter(F.col("decision_ts") > newer_than)
    return rows.groupBy(*by).agg(
        F.round(F.avg(F.abs("error")), decimals).alias("mae"),
        F.round(F.avg("error"), decimals).alias("bias"),
        F.count(F.lit(1)).alias("n"),
    )


def error_sets(errors: DataFrame, sets: Sequence[Sequence[str]], error: str = "error") -> DataFrame:
    """RMSE, bias and count for several groupings in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return errors.filter(F.col(error).isNotNull()).groupingSets([[F.col(c) for c in s] for s in sets],
                                                               *[F.col(c) for c in columns]).agg(
        F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"),
        F.avg(error).alias("bias"),
        F.count(F.lit(1)).alias("n"),
    )


def comfort_stats(df: DataFrame, by: Sequence[str], temp: str = "temp", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Shares inside, below and above the band (band edges count as inside) and the mean violation of the
    violating rows. Rows need a temperature and a band; a group without any reads zeros."""
    t, a, b = F.col(temp), F.col(lo), F.col(hi)
    valid = t.isNotNull() & a.isNotNull()
    violation = F.when(valid & (t < a), a - t).when(valid & (t > b), t - b)

    def share(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(valid, F.when(condition, 100.0).otherwise(0.0))), F.lit(0.0))

    return df.groupBy(*by).agg(
        share((t >= a) & (t <= b)).alias("pct_in_band"),
        share(t < a).alias("pct_below"),
        share(t > b).alias("pct_above"),
        F.coalesce(F.avg(violation), F.lit(0.0)).alias("avg_violation"),
    )


def capacity_stats(df: DataFrame, by: Sequence[str], violation: str = "violation", at: str = "at_capacity") -> DataFrame:
    """Cold (positive) and hot (negative) violations, split by whether the devices were already flat out."""
    cold, hot, full = F.col(violation) > 0, F.col(violation) < 0, F.col(at)
    return df.groupBy(*by).agg(
        F.count_if(cold).alias("cold_total"),
        F.count_if(cold & full).alias("cold_capacity"),
        F.count_if(cold & ~full).alias("cold_control"),
        F.count_if(hot).alias("hot_total"),
        F.count_if(hot & full).alias("hot_capacity"),
        F.count_if(hot & ~full).alias("hot_control"),
    )


def usable_sources(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("site_id",), above: int = 100) -> DataFrame:
    """A source is usable at a site once it has more than `above` values."""
    return wide.groupBy(*by).agg(*[(F.count(c) > above).alias(f"{c}_usable") for c in columns])


def filled_fraction(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("site_id",), minimum: float = 0.5) -> DataFrame:
    """Share of non-null rows per column and whether it reaches the minimum, as long rows."""
    shares = wide.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot(list(by), list(columns), "column_name", "fraction").withColumn(
        "kept", F.col("fraction") >= minimum
    )


def supported_features(states: DataFrame, by: Sequence[str], state: str = "state", minimum: float = 50) -> DataFrame:
    """Environment columns with enough active rows to estimate."""
    return states.groupBy(*by).agg(F.sum(F.coalesce(F.col(state), F.lit(0.0))).alias("active_rows")).withColumn(
        "supported", F.col("active_rows") >= minimum
    )


def enough_rows(n_rows: Column, n_features: Column | int, minimum: int = 500) -> Column:
    p = F.lit(n_features) if isinstance(n_features, int) else n_features
    return n_rows >= F.greatest(p + 10, F.lit(minimum))


def run_means(run_targets: DataFrame, by: Sequence[str]) -> DataFrame:
    return run_targets.groupBy(*by).agg(
        F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.count(F.lit(1)).alias("n_targets")
    )


def latest_runs(runs: DataFrame, by: Sequence[str] = ("mode", "experiment"), order: str = "timestamp") -> DataFrame:
    """The newest run of every mode and experiment."""
    rest = [c for c in runs.columns if c not in by]
    picked = runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
    return picked.select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def win_loss_tie(pairs: DataFrame, by: Sequence[str], old: str = "old_rmse", new: str = "new_rmse",
                 margin: float = 0.005) -> DataFrame:
    delta = F.col(new) - F.col(old)
    counted = pairs.filter(delta.isNotNull())
    return counted.groupBy(*by).agg(
        F.count_if(delta < -margin).alias("wins"),
        F.count_if(delta > margin).alias("losses"),
        F.count_if((delta >= -margin) & (delta <= margin)).alias("ties"),
        F.avg(delta).alias("mean_delta"),
        F.count(F.lit(1)).alias("compared"),
    )


def direct_and_cross(gains: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Per effector the strongest significant gain (direct) against the mean and maximum of its other ones."""
    keys = [*by, "effector"]
    live = ~F.col("negligible")
    size = F.abs("gain_f_per_hour")
    order = Window.partitionBy(*keys).orderBy(live.desc(), size.desc(), F.col("sensor"))
    ranked = gains.withColumn("__r", F.row_number().over(order)).withColumns(
        {"__direct": live & (F.col("__r") == 1), "__cross": live & (F.col("__r") > 1)}
    )
    cross = F.when(F.col("__cross"), size)
    out = ranked.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__direct"), F.col("sensor"))), F.lit("(none)")).alias("direct_sensor"),
        F.coalesce(F.max(F.when(F.col("__direct"), F.col("gain_f_per_hour"))), F.lit(0.0)).alias("direct_gain"),
        F.coalesce(F.max(F.when(F.col("__direct"), F.col("t_statistic"))), F.lit(0.0)).alias("direct_t"),
        F.count(cross).alias("n_cross"),
        F.coalesce(F.avg(cross), F.lit(0.0)).alias("mean_cross_gain"),
        F.coalesce(F.max(cross), F.lit(0.0)).alias("max_cross_gain"),
    )
    ratio = F.when(F.abs("direct_gain") > 0, F.col("mean_cross_gain") / F.abs("direct_gain")).otherwise(0.0)
    return out.withColumn("cross_direct_ratio", ratio)


def grade_rollup(health: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Sensors per grade; those below B are listed by name (the list is bounded by a site's sensors)."""
    weak = F.when(~F.col("grade").isin("A", "B"), F.col("sensor"))
    return health.groupBy(*by, "grade").agg(
        F.count(F.lit(1)).alias("n_sensors"), F.sort_array(F.collect_list(weak)).alias("weak_sensors")
    )


def feature_importance(importances: DataFrame, top: int | None = None) -> DataFrame:
    """Mean gain per feature over models, strongest first."""
    mean = importances.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.count(F.lit(1)).alias("n_models"))
    return mean if top is None else mean.orderBy(F.col("mean_gain").desc(), "feature").limit(top)


def stable_segments(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Segments in which every listed column has at most one distinct non-null value (NULL is no value)."""
    same = F.lit(True)
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
        same = same & F.coalesce(F.col(f"__lo_{c}") == F.col(f"__hi_{c}"), F.lit(True))
    if not columns:
        return rows.select(*by).distinct()
    return rows.groupBy(*by).agg(*aggs).filter(same).select(*by)
