"""Entity states and state history to readings.

`dims` rows say what an entity is: `(site_id, entity_id, kind, name, active_state, mode_control, has_command)`
with kind one of climate, fan, numeric, state, binary, cover, weather.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GONE = ["unavailable", "unknown"]


def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(name))


def _number(value: Column, zero_fill: bool) -> Column:
    """Numeric text, or NULL (`"0"` with zero fill) when it is no number."""
    number = value.try_cast("double")
    text = F.when(number.isNotNull() & ~F.isnan(number), number.cast("string"))
    return F.coalesce(text, F.lit("0.0")) if zero_fill else text


def fan_mode(state: Column) -> Column:
    preset = _attr("preset_mode")
    return F.when(F.coalesce(state, F.lit("off")) == "off", "off").otherwise(F.when(preset != "", preset).otherwise("low"))


def open_fraction(active_state: Column) -> Column:
    """Cover position as the share of its active state, two decimals; without a position open counts as 1."""
    position = _attr("current_position").try_cast("double") / 100.0
    openness = F.coalesce(position, F.when(F.col("state") == "open", 1.0).otherwise(0.0))
    return F.round(F.when(active_state == "open", openness).otherwise(1.0 - openness), 2)


def with_absent(states: DataFrame, dims: DataFrame) -> DataFrame:
    """States with a row, without state and attributes, for every entity that a site's poll (`ts`) did not report."""
    polls = states.select("site_id", "ts").distinct()
    absent = polls.join(dims.select("site_id", "entity_id").distinct(), "site_id").join(
        states.select("site_id", "ts", "entity_id"), ["site_id", "ts", "entity_id"], "left_anti"
    )
    return states.unionByName(absent, allowMissingColumns=True)


def states_to_readings(states: DataFrame, dims: DataFrame, ts: Column | None = None, zero_fill: bool = False,
                       complete: bool = False) -> DataFrame:
    """One row per derived column. Missing or unparsable numbers are NULL rows, or `0` with `zero_fill`.

    `complete` gives every configured entity a row at every poll; one that did not report has its default.
    """
    ts = ts if ts is not None else F.coalesce("last_updated", "last_changed")
    timed = states.withColumn("ts", ts)
    joined = (with_absent(timed, dims) if complete else timed).join(dims, ["site_id", "entity_id"], "inner")
    state = F.col("state")
    name = F.col("name")
    manual = F.col("mode_control") == "manual"

    def row(suffix: str, value: Column, when: Column | None = None) -> Column:
        item = F.struct(F.concat(name, F.lit(suffix)).alias("name"), value.cast("string").alias("value"))
        return item if when is None else F.when(when, item)

    absent = F.lit("0") if zero_fill else F.lit(None).cast("string")

    def plain(key: str) -> Column:
        return F.coalesce(_attr(key), absent)

    rows = (
        F.when(
            F.col("kind") == "climate",
            F.array(
                row("_temp", _number(_attr("current_temperature"), zero_fill)),
                row("_target", _number(_attr("temperature"), zero_fill)),
                row("_action", F.coalesce(_attr("hvac_action"), F.lit("idle")), manual),
                row("_mode", F.coalesce(state, F.lit("off")), ~manual),
                row("_action", F.coalesce(_attr("hvac_action"), F.lit("off")), ~manual & F.col("has_command")),
            ),
        )
        .when(F.col("kind") == "fan", F.array(row("_mode", fan_mode(F.coalesce(state, F.lit("off"))))))
        .when(F.col("kind") == "numeric", F.array(row("", _number(state, zero_fill))))
        .when(F.col("kind") == "state", F.array(row("", F.coalesce(state, F.lit("")))))
        .when(
            F.col("kind") == "binary",
            F.array(row("", F.when(state == F.col("active_state"), "1").otherwise("0"))),
        )
        .when(F.col("kind") == "cover", F.array(row("", open_fraction(F.col("active_state")))))
        .when(
            F.col("kind") == "weather",
            F.array(
                F.struct(F.lit("met_outdoor_temp").alias("name"), plain("temperature").alias("value")),
                F.struct(F.lit("outdoor_humidity").alias("name"), plain("humidity").alias("value")),
                F.struct(F.lit("wind_speed").alias("name"), plain("wind_speed").alias("value")),
                F.struct(F.lit("weather_condition").alias("name"), F.coalesce(state, F.lit("unknown")).alias("value")),
                F.when(
                    _attr("cloud_coverage").isNotNull(),
                    F.struct(F.lit("cloud_coverage").alias("name"), _attr("cloud_coverage").alias("value")),
                ),
            ),
        )
    )
    long = joined.select("site_id", "ts", F.explode(F.array_compact(rows)).alias("__r"))
    return long.select("site_id", "ts", F.col("__r.name").alias("name"), F.col("__r.value").alias("value"))


def _usable_history(history: DataFrame) -> DataFrame:
    """Drop gone states and rows whose change time does not parse."""
    text = F.when(F.col("last_changed") != "", F.col("last_changed")).otherwise(F.col("last_updated"))
    parsed = history.withColumn("ts", F.try_to_timestamp(text))
    return parsed.filter(~F.coalesce(F.col("state"), F.lit("")).isin(GONE) & F.col("ts").isNotNull())


def history_to_series(history: DataFrame, kind: str, active_state: str | None = None) -> DataFrame:
    """State history to typed columns.

    `numeric` and `text` give `value`; `binary` compares with `active_state`; `climate` gives mode, temp, target
    and action; `fan` gives mode; `weather` gives condition, temperature, humidity and wind speed.
    """
    rows = _usable_history(history)
    state = F.col("state")
    shapes = {
        "numeric": [state.try_cast("double").alias("value")],
        "text": [state.alias("value")],
        "binary": [(state == active_state).alias("value")],
        "climate": [
            state.alias("mode"),
            _attr("current_temperature").try_cast("double").alias("temp"),
            _attr("temperature").try_cast("double").alias("target"),
            F.coalesce(_attr("hvac_action"), F.lit("idle")).alias("action"),
        ],
        "fan": [fan_mode(state).alias("mode")],
        "weather": [
            state.alias("condition"),
            _attr("temperature").try_cast("double").alias("temperature"),
            _attr("humidity").try_cast("double").alias("humidity"),
            _attr("wind_speed").try_cast("double").alias("wind_speed"),
        ],
    }
    return rows.select("site_id", "entity_id", "ts", *shapes[kind])


def classify_entities(entities: DataFrame) -> DataFrame:
    """Role of each reported entity from its domain, device class, unit and modes; gone entities are dropped."""
    domain = F.split_part(F.col("entity_id"), F.lit("."), F.lit(1))
    device_class = F.coalesce(F.col("device_class"), F.lit(""))
    unit = F.coalesce(F.col("unit"), F.lit(""))
    modes = F.coalesce(F.col("hvac_modes"), F.array().cast("array<string>"))
    thermostat = (
        F.array_contains(modes, "heat") & ~F.array_contains(modes, "cool") & ~F.array_contains(modes, "fan_only")
    )
    sensor_role = (
        F.when((device_class == "temperature") | unit.isin("°F", "°C"), "temperature")
        .when(device_class == "humidity", "humidity")
        .when(unit == "%", F.lit(None))
        .when(device_class.isin("power", "energy"), "power")
    )
    role = (
        F.when(domain == "climate", F.when(thermostat, "thermostat").otherwise("mini_split"))
        .when(domain == "fan", "fan")
        .when(domain == "sensor", sensor_role)
        .when(
            domain == "binary_sensor",
            F.when(device_class.isin("window", "opening"), "window").when(device_class == "door", "door"),
        )
        .when(domain == "weather", "weather")
    )
    present = entities.filter(~F.coalesce(F.col("state"), F.lit("unknown")).isin(GONE))
    return present.withColumn("domain", domain).withColumn("role", role)
