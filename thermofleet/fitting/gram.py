"""Cross-product matrices of regression rows, summed across the cluster.

Each task turns its Arrow batches into one small matrix per group (numpy), Spark sums the matrices cell by cell
with a map-side combine, and what reaches one place is a single `(p+2) x (p+2)` matrix per group, whatever the
group's row count. The last two columns stand for the constant and the target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 512  # matrices a task keeps before handing them on


def _augmented(part: pd.DataFrame) -> np.ndarray:
    x = np.stack(part["x"].to_numpy()) if len(part) else np.zeros((0, 0))
    return np.column_stack([x, np.ones(len(part)), part["y"].to_numpy(dtype=float)])


def draws(replicates: int, blocks: int) -> np.ndarray:
    """How often each replicate draws each block: `blocks` draws with replacement, in 32-bit integer steps that SQL can share.

    Draw j of replicate r mixes x = r * blocks + j + 1 as x * 2654435761, x ^ (x >> 15), x * 2246822519, x ^ (x >> 13), all
    modulo 2 ** 32, and takes the block x % blocks.
    """
    x = np.arange(1, replicates * blocks + 1, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for factor, shift in ((2_654_435_761, 15), (2_246_822_519, 13)):
        x = x * np.uint64(factor) & low
        x ^= x >> np.uint64(shift)
    drawn = (x % np.uint64(blocks)).astype(np.int64).reshape(replicates, blocks)
    return np.stack([np.bincount(row, minlength=blocks) for row in drawn]).astype(float)


def _whole(half: Column) -> Column:
    """The full matrix, row by row, from its upper triangle; only the triangle goes through the shuffle."""
    d = ((F.sqrt(8.0 * F.size(half) + 1.0) - 1.0) / 2.0).cast("int")

    def cell(q: Column) -> Column:
        row, column = F.floor(q / d).cast("int"), (q % d).cast("int")
        a, b = F.least(row, column), F.greatest(row, column)
        return F.element_at(half, (a * d - F.floor(a * (a - 1) / 2).cast("int") + b - a + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), d * d - 1), cell)


def gram(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(by, g array<double>)` from rows `(by, x array<double>, y)`."""
    keys = list(by)
    types = dict(rows.dtypes)
    out_schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", g array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def emit() -> pd.DataFrame:
            data = [(*k, m[np.triu_indices(len(m))]) for k, m in held.items()]
            held.clear()
            return pd.DataFrame(data, columns=[*keys, "g"])

        for batch in batches:
            if batch.empty:
                continue
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                z = _augmented(part)
                held[key] = held.get(key, 0.0) + z.T @ z
            if len(held) >= HELD:
                yield emit()
        if held:
            yield emit()

    cells = rows.select(*keys, "x", "y").mapInPandas(partial, out_schema).select(*keys, F.posexplode("g").alias("cell", "v"))
    summed = cells.groupBy(*keys, "cell").agg(F.sum("v").alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("cell", "v")))
    return summed.groupBy(*keys).agg(F.transform(ordered, lambda c: c["v"]).alias("g")).withColumn("g", _whole(F.col("g")))
