"""Newton cooling and set-point arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newton_residual(rate: Column, outdoor: Column, indoor: Column, tau: Column) -> Column:
    """Observed rate of change minus what passive exchange with outdoors explains."""
    return rate - (outdoor - indoor) / tau


def effective_tau(tau_base: Column, active_beta_sum: Column) -> Column:
    """Time constant after the open devices add their exchange rates; the rate is floored at 0.01 per hour."""
    rate = F.lit(1.0) / tau_base + F.coalesce(active_beta_sum, F.lit(0.0))
    return F.lit(1.0) / F.greatest(rate, F.lit(0.01))


def tau_flag(tau_eff: Column, tau_base: Column) -> Column:
    ratio = tau_eff / tau_base
    return F.when(ratio < 0.3, "extreme").when(ratio < 0.5, "fast").otherwise("")


def newton_fold(current: Column, outdoor: Column, tau: Column, hours: Column) -> Column:
    """Chain hourly cooling segments over an array of hourly outdoor temperatures.

    The last array value is reused past its end; a fractional last hour decays by its fraction. An empty
    array or a non-positive horizon returns the current temperature.
    """
    n = F.size(outdoor)
    whole = F.floor(hours).cast("int")
    rest = hours - whole

    def outdoor_of(i: Column) -> Column:
        return F.element_at(outdoor, (F.least(i, n - 1) + 1).cast("int"))

    steps = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    decayed = F.aggregate(
        steps,
        current.cast("double"),
        lambda t, i: outdoor_of(i) + (t - outdoor_of(i)) * F.exp(F.lit(-1.0) / tau),
    )
    last = outdoor_of(whole)
    ended = F.when(rest > 0, last + (decayed - last) * F.exp(-rest / tau)).otherwise(decayed)
    usable = F.coalesce(n, F.lit(0)) > 0
    return F.when(usable & (hours > 0), ended).otherwise(current.cast("double"))


def outdoor_at(current: Column, forecast: Column, hours: Column) -> Column:
    """Outdoor temperature at a lead time: linear inside the first hour, hourly steps after, last value held."""
    n = F.size(forecast)
    first = F.element_at(forecast, 1)
    index = F.greatest(F.lit(1), F.least(F.floor(hours).cast("int"), n))
    return (
        F.when((F.coalesce(n, F.lit(0)) <= 0) | (hours <= 0), current)
        .when(hours < 1.0, current + hours * (first - current))
        .otherwise(F.element_at(forecast, index))
    )


def weather_controls(outdoor: Column, indoor: Column, wind: Column, outdoor_rate: Column) -> dict[str, Column]:
    """Regression controls: signed squared difference, wind-driven exchange, outdoor rate of change."""
    gap = outdoor - indoor
    return {
        "weather_dt2": gap * gap * F.signum(gap),
        "weather_wind_dt": F.coalesce(wind, F.lit(0.0)) * gap,
        "weather_dtout_dt": outdoor_rate,
    }


def cautious_setpoint(
    current: Column,
    heating: Column,
    comfort_min: Column,
    offset: float = 2.0,
    floor: float = 62.0,
    ceiling: float = 78.0,
) -> Column:
    """A set-point that switches heating on or off without running away if the loop stops."""
    on = F.greatest(current + offset, comfort_min + offset)
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.when(heating, on).otherwise(comfort_min - 1)))


def command_confidence(total_cost: Column) -> Column:
    return F.lit(1.0) - F.least(total_cost / 10.0, F.lit(0.9))


def outdoor_source(sensor: Column, weather: Column) -> Column:
    """The site's own sensor where it reported, else the weather service. A real 0.0 is a value."""
    return F.coalesce(sensor, weather)
