"""From wide readings to regression rows.

Everything runs on a complete five-minute grid of `(site_id, ts)`, so row positions are tick numbers and all
rolling features of one site share one block partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.thermal import newton_residual, weather_controls
from thermofleet.functions.timekeys import day_harmonics, local_hour
from thermofleet.functions.weather import positive_sine, solar_elevation, solar_fraction
from thermofleet.operators.aggregates import stable_segments, usable_sources
from thermofleet.operators.grid import interpolate, tick
from thermofleet.operators.smoothing import bin_label, central_difference, lag_bin_mean, lag_bins, rolling_mean, wide_difference
from thermofleet.operators.spans import gap_segments
from thermofleet.operators.track import Track, over_rows


@dataclass(frozen=True)
class Effector:
    name: str
    column: str
    encoding: Mapping[str, float]
    max_lag_minutes: int = 90
    command_column: str | None = None
    command_encoding: Mapping[str, float] | None = None
    gate: str | None = None


@dataclass(frozen=True)
class Layout:
    """Which columns mean what. The catalog is shared by a group of sites with the same equipment.

    Place and zone here are those of sites that have no row of their own in the table given to `prepare`.
    """

    sensors: Sequence[str]
    effectors: Sequence[Effector] = ()
    environment: Mapping[str, str] = field(default_factory=dict)  # column -> kind
    gates: Mapping[str, tuple[str, Mapping[str, float]]] = field(default_factory=dict)
    outdoor_sensor: str | None = None
    weather_outdoor: str | None = "met_outdoor_temp"
    latitude: float = 47.6
    longitude: float = -122.3
    zone: str = "UTC"
    step_seconds: int = 300

    @property
    def step_hours(self) -> float:
        return self.step_seconds / 3600.0


def _encoded(column: str, table: Mapping[str, float]) -> Column:
    items = [F.lit(x) for k, v in table.items() for x in (str(k), float(v))]
    return F.element_at(F.create_map(*items), F.col(column).cast("string"))


def effector_activity(wide: DataFrame, layout: Layout) -> DataFrame:
    """State text to activity, the command where the state is missing, 0 otherwise; times its gate."""
    columns = {}
    for e in layout.effectors:
        state = _encoded(e.column, e.encoding) if e.column in wide.columns else F.lit(None).cast("double")
        if e.command_column and e.command_column in wide.columns:
            state = F.coalesce(state, _encoded(e.command_column, e.command_encoding or e.encoding))
        level = F.coalesce(state, F.lit(0.0))
        if e.gate and layout.gates[e.gate][0] in wide.columns:
            column, table = layout.gates[e.gate]
            level = level * F.coalesce(_encoded(column, table), F.lit(0.0))
        columns[f"eff_{e.name}"] = level
    return wide.withColumns(columns) if columns else wide


def best_outdoor(wide: DataFrame, layout: Layout, minimum: int = 100, limit: int = 24) -> DataFrame:
    """Outdoor temperature: the site's sensor where usable, filled by the interpolated weather service.

    A source counts once it has more than `minimum` values at the site.
    """
    track = Track(("site_id",))
    sources = [c for c in (layout.outdoor_sensor, layout.weather_outdoor) if c and c in wide.columns]
    if not sources:
        raise ValueError("no outdoor temperature column in the readings")
    usable = usable_sources(wide, sources, above=minimum)
    out = wide
    picks = []
    if layout.outdoor_sensor in sources:
        picks.append(F.when(F.col(f"{layout.outdoor_sensor}_usable"), F.col(layout.outdoor_sensor)))
    if layout.weather_outdoor in sources:
        out = interpolate(out, track, layout.weather_outdoor, limit, tick("ts", layout.step_seconds), into="__met")
        picks.append(F.when(F.col(f"{layout.weather_outdoor}_usable"), F.col("__met")))
    joined = out.join(usable, ["site_id"], "left").withColumn("outdoor_best", F.coalesce(*picks))
    return joined.drop("__met", *[f"{c}_usable" for c in sources])


def with_place(df: DataFrame, layout: Layout, places: DataFrame | None) -> DataFrame:
    """Add each site's latitude, longitude and zone."""
    defaults = {"latitude": F.lit(layout.latitude), "longitude": F.lit(layout.longitude), "zone": F.lit(layout.zone)}
    if places is None:
        return df.withColumns(defaults)
    own = places.select("site_id", *[F.col(c).alias(f"__{c}") for c in defaults])
    joined = df.join(own, ["site_id"], "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), d) for c, d in defaults.items()}).drop(*[f"__{c}" for c in defaults])


def with_sun(df: DataFrame) -> DataFrame:
    """Solar elevation, local hour and sun on a surface, from the row's place."""
    condition = F.col("weather_condition") if "weather_condition" in df.columns else F.lit("unknown")
    elevation = solar_elevation(F.col("latitude"), F.col("longitude"), F.col("ts"))
    return df.withColumns({"solar_elev_deg": elevation, "local_hour": local_hour(F.col("ts"), F.col("zone"))}).withColumn(
        "solar", positive_sine(F.col("solar_elev_deg")) * solar_fraction(condition)
    )


def prepare(wide: DataFrame, layout: Layout, min_outdoor: int = 100, places: DataFrame | None = None) -> DataFrame:
    """All features that look at neighbouring rows, on one partitioning, plus the sun.

    `places` has `(site_id, latitude, longitude, zone)`, one row per site.
    """
    ready = effector_activity(best_outdoor(wide, layout, min_outdoor), layout)
    ready = with_sun(with_place(ready, layout, places))
    hours = layout.step_hours
    longest = max([e.max_lag_minutes // 5 for e in layout.effectors], default=1)

    def first(w):
        out = {"outdoor_rate": central_difference(w, "outdoor_best", hours)}
        out.update({f"__smooth_{s}": rolling_mean(w, s) for s in layout.sensors})
        for e in layout.effectors:
            for start, end in lag_bins(e.max_lag_minutes):
                out[f"lag_{e.name}_{bin_label(start, end)}"] = lag_bin_mean(w, f"eff_{e.name}", start, end)
        return out

    def second(w):
        return {f"rate_{s}": wide_difference(w, f"__smooth_{s}", 3, hours) for s in layout.sensors}

    out = over_rows(ready, Track(("site_id",)), max(longest, 6), 6, [first, second], tick("ts", layout.step_seconds))
    return out.drop(*[f"__smooth_{s}" for s in layout.sensors])


def sensor_rows(prepared: DataFrame, layout: Layout) -> DataFrame:
    """One row per site, sensor and tick: temperature and rate beside the shared features."""
    shared = [c for c in prepared.columns if c not in layout.sensors and not c.startswith("rate_")]
    items = F.array(*[
        F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("temp"), F.col(f"rate_{s}").alias("rate"))
        for s in layout.sensors
    ])
    return prepared.select(*shared, F.explode(items).alias("s")).select(*shared, "s.sensor", "s.temp", "s.rate")


def passive_rows(rows: DataFrame, layout: Layout, max_sun: float = 5.0) -> DataFrame:
    """Rows with the sun low, every effector off and both temperatures known.

    Without a solar elevation column the hours 22 to 6 count as dark.
    """
    dark = (
        F.col("solar_elev_deg") < max_sun
        if "solar_elev_deg" in rows.columns
        else (F.col("local_hour") >= 22) | (F.col("local_hour") < 6)
    )
    idle = F.lit(True)
    for e in layout.effectors:
        idle = idle & (F.col(f"eff_{e.name}") == 0.0)
    return rows.filter(dark & idle & F.col("temp").isNotNull() & F.col("outdoor_best").isNotNull())


def uncontrolled_segments(rows: DataFrame, layout: Layout, gap_seconds: float = 600, min_rows: int = 12,
                          max_sun: float = 5.0) -> DataFrame:
    """Passive rows numbered by run; runs that are short or change a window or door are dropped."""
    track = Track(("site_id", "sensor"))
    found = gap_segments(passive_rows(rows, layout, max_sun), track, gap_seconds, min_rows)
    environment = [c for c in layout.environment if c in rows.columns]
    if not environment:
        return found
    keys = ["site_id", "sensor", "segment_id"]
    return found.join(stable_segments(found, keys, environment), keys, "left_semi")


def design(rows: DataFrame, taus: DataFrame, layout: Layout, min_active: float = 50) -> tuple[DataFrame, list[str]]:
    """Regression rows `(site_id, sensor, ts, x, y)` and the feature names in order.

    The target is the rate the time constant does not explain. Environment states enter times the temperature
    gap (shades: times the sun). A state with too little activity at a site and sensor is set to zero there,
    which the ridge turns into a zero coefficient. Rows with an unknown target or feature are dropped.
    """
    joined = rows.join(taus.select("site_id", "sensor", "tau_base"), ["site_id", "sensor"])
    environment = [c for c in layout.environment if c in rows.columns]
    if environment:
        active = joined.groupBy("site_id").agg(
            *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"__n_{c}") for c in environment]
        )
        active = active.withColumns({f"__n_{c}": F.col(f"__n_{c}") / max(len(layout.sensors), 1) for c in environment})
        joined = joined.join(active, ["site_id"])
    gap = F.col("outdoor_best") - F.col("temp")
    wind = F.col("wind_speed").try_cast("double") if "wind_speed" in rows.columns else F.lit(0.0)
    features: dict[str, Column] = {}
    for e in layout.effectors:
        for start, end in lag_bins(e.max_lag_minutes):
            name = f"lag_{e.name}_{bin_label(start, end)}"
            features[name] = F.col(name)
    features.update(weather_controls(F.col("outdoor_best"), F.col("temp"), wind, F.col("outdoor_rate")))
    features.update(day_harmonics(F.col("ts"), F.col("zone") if "zone" in rows.columns else layout.zone))

    def state(c: str) -> Column:
        return F.when(F.col(f"__n_{c}") >= min_active, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0)

    for c in environment:
        if layout.environment[c] != "shade":
            features[f"adv_tau_{c}"] = state(c) * gap
    features["solar_elev"] = F.col("solar")
    for c in environment:
        if layout.environment[c] == "shade":
            features[f"adv_solar_{c}"] = state(c) * F.col("solar")
    y = newton_residual(F.col("rate"), F.col("outdoor_best"), F.col("temp"), F.col("tau_base"))
    complete = y.isNotNull()
    for column in features.values():
        complete = complete & column.isNotNull()
    out = joined.filter(complete).select(
        "site_id", "sensor", "ts", F.array(*[c.cast("double") for c in features.values()]).alias("x"), y.alias("y")
    )
    return out, list(features)
