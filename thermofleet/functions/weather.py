"""Solar position and weather-condition lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Share of clear-sky sun that reaches the ground, by reported condition.
SOLAR_FRACTION = {
    "sunny": 1.0,
    "clear-night": 0.0,
    "partlycloudy": 0.5,
    "cloudy": 0.15,
    "fog": 0.15,
    "rainy": 0.05,
    "pouring": 0.02,
    "snowy": 0.1,
    "snowy-rainy": 0.05,
    "lightning": 0.1,
    "lightning-rainy": 0.05,
    "hail": 0.05,
    "windy": 0.7,
    "windy-variant": 0.5,
    "exceptional": 0.3,
    "unknown": 0.3,
    "unavailable": 0.3,
}
DEFAULT_SOLAR_FRACTION = 0.3

# Condition codes are positions in this list.
CONDITIONS = [
    "clear-night", "cloudy", "exceptional", "fog", "hail", "lightning", "lightning-rainy", "partlycloudy",
    "pouring", "rainy", "snowy", "snowy-rainy", "sunny", "windy", "windy-variant", "unknown",
]


def _lookup(table: dict, key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.element_at(literal, key)


def solar_fraction(condition: Column) -> Column:
    return F.coalesce(_lookup(SOLAR_FRACTION, condition), F.lit(DEFAULT_SOLAR_FRACTION))


def condition_code(condition: Column) -> Column:
    codes = {name: i for i, name in enumerate(CONDITIONS)}
    return F.coalesce(_lookup(codes, condition), F.lit(codes["unknown"]))


def solar_elevation(lat: Column, lon: Column, ts: Column) -> Column:
    """Degrees above the horizon at a UTC instant (day-of-year declination, hour angle from longitude)."""
    declination = F.radians(23.45 * F.sin(F.radians(360.0 / 365.0 * (F.dayofyear(ts) - 81))))
    utc_hour = F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0
    hour_angle = F.radians(15.0 * (utc_hour + lon / 15.0 - 12.0))
    phi = F.radians(lat)
    height = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))


def positive_sine(elevation_degrees: Column) -> Column:
    """Horizontal-surface sun: zero below the horizon."""
    return F.greatest(F.lit(0.0), F.sin(F.radians(elevation_degrees)))
