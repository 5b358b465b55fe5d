"""Degrees Fahrenheit are canonical; absolute values and differences convert differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_temp(fahrenheit: Column, unit: Column) -> Column:
    return F.when(unit == "F", fahrenheit).otherwise((fahrenheit - 32.0) * 5.0 / 9.0)


def delta_temp(fahrenheit: Column, unit: Column) -> Column:
    return F.when(unit == "F", fahrenheit).otherwise(fahrenheit * (5.0 / 9.0))
