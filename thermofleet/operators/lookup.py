"""Joins against dimensions and between versions of a table.

No join carries a broadcast hint: dimensions grow with the fleet, so Spark decides from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_schedule(schedules: DataFrame, by: Sequence[str] = ("site_id", "sensor")) -> DataFrame:
    """One row per key and hour of day: the first entry in list order whose `[start, end)` holds the hour.

    A start after the end wraps midnight. Turning ranges into hours makes the lookup an equi-join.
    """
    whole = F.sequence(F.lit(0), F.lit(23))
    start, end = F.col("start_hour"), F.col("end_hour")
    hours = F.filter(
        whole, lambda h: F.when(start <= end, (h >= start) & (h < end)).otherwise((h >= start) | (h < end))
    )
    exploded = schedules.withColumn("hour", F.explode(hours))
    rest = [c for c in schedules.columns if c not in by]
    first = exploded.groupBy(*by, "hour").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("__e"))
    return first.select(*by, "hour", *[F.col(f"__e.{c}").alias(c) for c in rest])


def resolve_schedule(df: DataFrame, schedules: DataFrame, hour: Column, by: Sequence[str] = ("site_id", "sensor"),
                     drop_unmatched: bool = False) -> DataFrame:
    """Attach the schedule entry in force at an hour."""
    table = hourly_schedule(schedules, by).drop("seq", "start_hour", "end_hour")
    keyed = df.withColumn("hour", hour.cast("int"))
    return keyed.join(table, [*by, "hour"], "inner" if drop_unmatched else "left")


def encode_states(df: DataFrame, encodings: DataFrame, owner: Column, state: Column, fallback: Column | None = None,
                  into: str = "activity", fallback_owner: Column | None = None) -> DataFrame:
    """Category to number by `(owner, label, code)` rows; then the fallback column; then 0.0."""
    codes = encodings.select(F.col("owner").alias("__owner"), F.col("label").alias("__label"), F.col("code").alias("__code"))
    out = df.withColumns({"__owner": owner, "__label": state}).join(codes, ["__owner", "__label"], "left")
    picked = F.col("__code")
    if fallback is not None:
        second = codes.select(
            F.col("__owner").alias("__owner2"), F.col("__label").alias("__label2"), F.col("__code").alias("__code2")
        )
        out = out.withColumns({"__owner2": fallback_owner if fallback_owner is not None else owner, "__label2": fallback})
        out = out.join(second, ["__owner2", "__label2"], "left")
        picked = F.coalesce(picked, F.col("__code2"))
    out = out.withColumn(into, F.coalesce(picked, F.lit(0.0)))
    return out.drop("__owner", "__label", "__code", "__owner2", "__label2", "__code2")


def gated(activity: Column, gate: Column) -> Column:
    """Activity counts only while the confirming state is on."""
    return activity * F.coalesce(gate, F.lit(0.0))


def compare_versions(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Union of keys with both values; a missing side reads 0 and the row says `new`, `removed` or `both`."""
    left = old.select(*keys, F.col(value).alias("__old"))
    right = new.select(*keys, F.col(value).alias("__new"))
    status = (
        F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").otherwise("both")
    )
    return left.join(right, list(keys), "full_outer").select(
        *keys,
        F.coalesce("__old", F.lit(0.0)).alias("old_value"),
        F.coalesce("__new", F.lit(0.0)).alias("new_value"),
        status.alias("status"),
    )


def compare_common(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Only keys on both sides, each value next to its counterpart."""
    left = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    right = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values])
    return left.join(right, list(keys), "inner")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of the first source, and of the second only the keys the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti").select(*first.columns))


def with_effect(devices: DataFrame, effects: Sequence[DataFrame], keys: Sequence[str] = ("site_id", "device")) -> DataFrame:
    """Devices that appear in at least one table of fitted effects."""
    seen = effects[0].select(*keys)
    for table in effects[1:]:
        seen = seen.unionByName(table.select(*keys))
    return devices.join(seen.distinct(), list(keys), "left_semi")


def numbered_choices(options: DataFrame, by: Sequence[str], owner: str, order: Sequence[Column],
                     into: str = "option_no") -> DataFrame:
    """0-based option number inside `(by, owner)`; option lists are short and come from configuration."""
    window = Window.partitionBy(*by, owner).orderBy(*order)
    return options.withColumn(into, (F.row_number().over(window) - 1).cast("bigint"))


PAGE = 10_000  # rows that one page unfolds into, at most
PAGES = 20  # pages in one partition, about


def spread_pages(rows: DataFrame, size: Column, into: str, by: Sequence[str]) -> DataFrame:
    """Each row once per page of the `size` rows it will unfold into, dealt over as many partitions as those rows fill.

    Rows with pages are few and small but unfold a lot. One sum tells how much beforehand; a given number of partitions is
    not merged again at run time, so the unfolding stays spread.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    last = F.greatest(F.ceil(size / PAGE).cast("bigint") - 1, F.lit(0))
    paged = rows.withColumn(into, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    # few pages still get a partition each
    parts = min(total // PAGE, max(total // (PAGE * PAGES), 64)) + 1
    return paged.repartition(int(min(parts, MAX_PARTITIONS)), *by, into)


MAX_PARTITIONS = 20_000  # partitions hold more pages beyond that


def _ordered(items: Column, field: str) -> Column:
    return F.array_sort(items, lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0))


def combination_pages(options: DataFrame, by: Sequence[str], owner: str, beside: DataFrame | None = None) -> DataFrame:
    """Keys with the numbers of their combinations in pages: `(by, __owners, __plans, __first, __last)` and `beside`'s columns.

    A key's options become one row (its owners and their option lists come from configuration). Combinations are numbered
    `0 .. __plans - 1`; each of `__owners` has the `list` of its options, and the `size` and `stride` by which its option is
    read off the number (mixed radix, first owner slowest). Sizes are whole numbers; a key with more combinations than a long
    can number is an error.
    """
    rest = [c for c in options.columns if c not in (*by, owner, "option_no")]
    lists = options.groupBy(*by, owner).agg(_ordered(F.collect_list(F.struct(owner, "option_no", *rest)), "option_no").alias("__list"))
    keys = lists.groupBy(*by).agg(_ordered(F.collect_list(F.struct(F.col(owner).alias("__owner"), "__list")), "__owner").alias("__lists"))
    sizes = F.transform("__lists", lambda o: F.size(o["__list"]).cast("bigint"))
    one = F.lit(1).cast("bigint")
    keys = keys.withColumn("__sizes", sizes).withColumn("__plans", F.aggregate("__sizes", one, lambda n, size: n * size))
    stride = lambda i: F.aggregate(F.slice("__sizes", i + 2, F.size("__sizes")), one, lambda n, size: n * size)
    keys = keys.withColumn("__owners", F.transform("__lists", lambda o, i: F.struct(
        o["__owner"].alias("owner"), o["__list"].alias("list"), F.get("__sizes", i).alias("size"), stride(i).alias("stride")))).drop("__lists", "__sizes")
    if beside is not None:
        keys = keys.join(beside, list(by), "left")
    pages = spread_pages(keys, F.col("__plans"), "__page", by)
    first = F.col("__page") * PAGE
    return pages.withColumns({"__first": first, "__last": F.least(first + PAGE, F.col("__plans")) - 1}).drop("__page")


def option_index(number: Column, o: Column) -> Column:
    """Place in the list of one of `__owners` that a combination's number stands for."""
    return (F.call_function("div", number, o["stride"]) % o["size"]).cast("int")


def combination_rows(options: DataFrame, by: Sequence[str], owner: str, into: str = "plan_id", beside: DataFrame | None = None) -> DataFrame:
    """Every combination that takes one option per owner: `(by, plan_id, choices)`, plus the columns of `beside` (per key).

    Each owner's option is read off the combination's number in place: nothing is crossed, joined or gathered per combination.
    Number 0 takes option 0 everywhere.
    """
    pages = combination_pages(options, by, owner, beside).withColumn(into, F.explode(F.sequence("__first", "__last")))
    choices = F.transform("__owners", lambda o: F.get(o["list"], option_index(F.col(into), o)))
    own = [] if beside is None else [c for c in beside.columns if c not in by]
    return pages.select(*by, into, choices.alias("choices"), *own)


def combination_table(options: DataFrame, by: Sequence[str], owner: str, into: str = "plan_id") -> DataFrame:
    """The combinations as long rows `(by, plan_id, owner, option_no, ...)`.

    Pages are unfolded owner by owner, so that generated code makes a row from a number and a list, and no list is built for a
    combination.
    """
    pages = combination_pages(options, by, owner).select(*by, "__first", "__last", F.explode("__owners").alias("__o"))
    numbered = pages.withColumn(into, F.explode(F.sequence("__first", "__last")))
    taken = F.get(F.col("__o.list"), option_index(F.col(into), F.col("__o")))
    return numbered.select(*by, into, taken.alias("__c")).select(*by, into, "__c.*")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Set intersection by key."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Set difference by key."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")
