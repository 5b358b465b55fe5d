"""Time constants from passive segments, by aggregation only.

Least squares of `(T - To) / (T0 - To)` on `exp(-t / tau)` over a grid of candidates. The squared error of each
candidate is one sum, so a segment of any length is fitted by partial sums; two more rounds refine the grid
around the best candidate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import seconds_between
from thermofleet.operators.aggregates import weighted_median
from thermofleet.session import cut_lineage

LOWEST, HIGHEST = 1.0, 500.0
POINTS = 24


def first_grid(points: int = POINTS) -> list[float]:
    """Candidates from 1 to 500 hours, evenly spaced in the logarithm."""
    ratio = (HIGHEST / LOWEST) ** (1.0 / (points - 1))
    return [round(LOWEST * ratio**i, 6) for i in range(points)]


def normalised(rows: DataFrame, keys: Sequence[str], temp: str = "temp", outdoor: str = "outdoor_best",
               ts: str = "ts", min_gap: float = 1.0) -> DataFrame:
    """Hours since the start and normalised distance from the segment's mean outdoor temperature."""
    heads = rows.groupBy(*keys).agg(
        F.min(ts).alias("__t0"), F.min_by(temp, ts).alias("__temp0"), F.avg(outdoor).alias("__out"),
        F.count(F.lit(1)).alias("n_rows"),
    ).filter(F.abs(F.col("__temp0") - F.col("__out")) >= min_gap)
    joined = rows.join(heads, list(keys))
    return joined.select(
        *keys, "n_rows", (seconds_between(F.col(ts), F.col("__t0")) / 3600.0).alias("__h"),
        ((F.col(temp) - F.col("__out")) / (F.col("__temp0") - F.col("__out"))).alias("__z"),
    )


def _best_of(rows: DataFrame, keys: Sequence[str], candidates: Sequence[Column]) -> DataFrame:
    sums = []
    for i, tau in enumerate(candidates):
        miss = F.col("__z") - F.exp(-F.col("__h") / tau)
        sums.append(F.sum(miss * miss).alias(f"__e{i}"))
    firsts = [F.first(c).alias(f"__c{i}") for i, c in enumerate(candidates)]
    scored = rows.groupBy(*keys, "n_rows").agg(*sums, *firsts)
    ranked = F.array_min(F.array(*[
        F.struct(F.col(f"__e{i}").alias("sse"), F.col(f"__c{i}").alias("tau")) for i in range(len(candidates))
    ]))
    return scored.select(*keys, "n_rows", ranked.alias("b")).select(*keys, "n_rows", "b.tau", "b.sse")


def fit_segments(rows: DataFrame, keys: Sequence[str], temp: str = "temp", outdoor: str = "outdoor_best",
                 ts: str = "ts", rounds: int = 2, points: int = POINTS) -> DataFrame:
    """`(keys, n_rows, tau, sse)` per segment; segments that start within a degree of outdoors are left out."""
    # Three rounds read these narrow rows, so they are written once instead of being derived three times.
    normal = cut_lineage(normalised(rows, keys, temp, outdoor, ts))
    grid = first_grid(points)
    best = _best_of(normal, keys, [F.lit(c) for c in grid])
    factor = grid[1] / grid[0]
    for _ in range(rounds):
        centred = normal.join(best.select(*keys, F.col("tau").alias("__mid")), list(keys))
        candidates = [
            F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("__mid") * float(factor ** (2.0 * i / (points - 1) - 1.0))))
            for i in range(points)
        ]
        best = _best_of(centred, keys, candidates)
        factor = factor ** (2.0 / (points - 1))
    return best


def sensor_taus(segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """Median of the segment fits weighted by length; sensors without a fit keep their default.

    `sensors` has `(site_id, sensor, default_tau)`.
    """
    keys = ["site_id", "sensor"]
    segments = cut_lineage(segments)
    middle = weighted_median(segments, keys, "tau", "n_rows", 1, "__tau")
    counts = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return sensors.join(middle, keys, "left").join(counts, keys, "left").select(
        *keys, F.coalesce("__tau", "default_tau").alias("tau_base"), F.coalesce("__n", F.lit(0)).cast("int").alias("n_segments")
    )


def sealed_and_ventilated(rows: DataFrame, spans: DataFrame, default_ratio: float = 0.44, min_rows: int = 5,
                          reference_sensor: str | None = None) -> DataFrame:
    """Time constants with windows closed and open, from the first long enough run of each state.

    `rows` carry `run_no` and a boolean `state`; `spans` are their runs. A sensor without a ventilated run gets
    its sealed value times the ratio seen at the site's reference sensor, else times the default.
    """
    keys = ["site_id", "sensor", "run_no"]
    fits = fit_segments(rows, keys).join(spans.select(*keys, "state", "start_ts"), keys).filter(F.col("n_rows") >= min_rows)
    first = fits.groupBy("site_id", "sensor", "state").agg(F.min_by("tau", "start_ts").alias("tau"))
    wide = first.groupBy("site_id", "sensor").agg(
        F.round(F.max(F.when(~F.col("state"), F.col("tau"))), 1).alias("sealed"),
        F.round(F.max(F.when(F.col("state"), F.col("tau"))), 1).alias("fitted_ventilated"),
    )
    ratio_rows = wide if reference_sensor is None else wide.filter(F.col("sensor") == reference_sensor)
    ratio = ratio_rows.filter(F.col("sealed").isNotNull() & F.col("fitted_ventilated").isNotNull()).groupBy("site_id").agg(
        F.avg(F.col("fitted_ventilated") / F.col("sealed")).alias("__ratio")
    )
    filled = wide.join(ratio, ["site_id"], "left")
    guess = F.round(F.col("sealed") * F.coalesce("__ratio", F.lit(default_ratio)), 1)
    return filled.select(
        "site_id", "sensor", "sealed", F.coalesce("fitted_ventilated", guess).alias("ventilated"),
        F.col("fitted_ventilated").isNull().alias("estimated"),
    )
