"""Ridge regression, its errors and its diagnostics, all from summed cross-product matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.fitting.gram import draws, gram

SCALED_PREFIXES = ("solar_", "adv_")
OPTIONAL_PREFIX = "adv_"


def _unpack(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, float]:
    """XtX, Xty, column sums, n, sum of y, sum of y squared."""
    p = int(round(np.sqrt(len(g)))) - 2
    m = np.asarray(g, dtype=float).reshape(p + 2, p + 2)
    return m[:p, :p], m[:p, p + 1], m[:p, p], m[p, p], m[p, p + 1], m[p + 1, p + 1]


def _scale(xtx: np.ndarray, sums: np.ndarray, n: float, scaled: np.ndarray) -> np.ndarray:
    """Population standard deviation of the scaled columns; 1 elsewhere and for constant columns."""
    variance = np.maximum(np.diag(xtx) / n - (sums / n) ** 2, 0.0)
    return np.where(scaled & (variance > 0), np.sqrt(variance), 1.0)


def _solve(xtx: np.ndarray, xty: np.ndarray, scale: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.linalg.inv(xtx / np.outer(scale, scale) + lam * np.eye(len(scale)))
    return inverse @ (xty / scale) / scale, inverse


def _sse(beta: np.ndarray, xtx: np.ndarray, xty: np.ndarray, yy: float) -> float:
    return float(max(yy - 2 * beta @ xty + beta @ xtx @ beta, 0.0))


def _vif(xtx: np.ndarray, sums: np.ndarray, n: float) -> np.ndarray:
    p = len(sums)
    out = np.ones(p)
    for j in range(p):
        rest = np.arange(p) != j
        a, b = xtx[np.ix_(rest, rest)], xtx[rest, j]
        beta = np.linalg.solve(a + 0.001 * n * np.eye(p - 1), b) if p > 1 else np.zeros(0)
        total = xtx[j, j] - sums[j] ** 2 / n
        r2 = 1.0 - (xtx[j, j] - 2 * beta @ b + beta @ a @ beta) / total if total > 0 else 0.0
        out[j] = 1.0 / (1.0 - min(r2, 0.9999))
    return out


def ridge(design: DataFrame, features: Sequence[str], by: Sequence[str] = ("site_id", "sensor"),
          min_rows: int = 500) -> DataFrame:
    """One row per group: `n, n_features, lam, cond, r_squared, s2` and arrays `beta, se, t, vif, scale`.

    No intercept. Penalty 0.01 n, ten times that for an ill-conditioned matrix. Solar and environment columns are
    divided by their spread first, the others are not. Optional columns that are zero throughout are left out of
    the fit and read zero. Groups with fewer than max(p + 10, min_rows) rows have no row here.
    """
    return solve_ridge(gram(design, by), features, by, min_rows)


def solve_ridge(grams: DataFrame, features: Sequence[str], by: Sequence[str], min_rows: int = 500) -> DataFrame:
    keys = list(by)
    types = dict(grams.dtypes)
    names = list(features)
    scaled = np.array([n.startswith(SCALED_PREFIXES) for n in names])
    optional = np.array([n.startswith(OPTIONAL_PREFIX) for n in names])
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", n bigint, n_features int, lam double, cond double, r_squared double, s2 double, "
        "beta array<double>, se array<double>, t array<double>, vif array<double>, scale array<double>"
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                xtx, xty, sums, n, sum_y, yy = _unpack(record.g)
                live = ~(optional & (np.diag(xtx) == 0))
                p = int(live.sum())
                if n < max(p + 10, min_rows):
                    continue
                a, b, s = xtx[np.ix_(live, live)], xty[live], sums[live]
                scale = _scale(a, s, n, scaled[live])
                spectrum = np.linalg.eigvalsh(a / np.outer(scale, scale))
                cond = float(np.sqrt(spectrum[-1] / spectrum[0])) if spectrum[0] > 0 else float("inf")
                lam = 0.01 * n * (10.0 if cond > 1e6 else 1.0)
                beta, inverse = _solve(a, b, scale, lam)
                sse = _sse(beta, a, b, yy)
                total = yy - sum_y**2 / n
                s2 = sse / max(n - p, 1)
                se = np.sqrt(np.abs(np.diag(s2 * inverse))) / scale
                t = np.divide(beta, se, out=np.zeros(p), where=se > 0)
                vif = _vif(a / np.outer(scale, scale), s / scale, n)

                def full(values: np.ndarray, fill: float) -> list[float]:
                    out = np.full(len(names), fill)
                    out[live] = values
                    return out.tolist()

                rows.append((
                    *[getattr(record, k) for k in keys], int(n), p, lam, cond,
                    1.0 - sse / total if total > 0 else 0.0, s2,
                    full(beta, 0.0), full(se, 0.0), full(t, 0.0), full(vif, 1.0), full(scale, 1.0),
                ))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return grams.select(*keys, "g").mapInPandas(fit, schema)


def coefficients(fits: DataFrame, features: Sequence[str], by: Sequence[str] = ("site_id", "sensor")) -> DataFrame:
    """One row per group and feature."""
    names = F.array(*[F.lit(n) for n in features])
    zipped = F.arrays_zip(names.alias("feature"), F.col("beta"), F.col("se"), F.col("t"), F.col("vif"))
    return fits.select(*by, "n", F.posexplode(zipped).alias("feature_no", "c")).select(
        *by, "n", "feature_no", F.col("c.feature").alias("feature"), "c.beta", "c.se", "c.t", "c.vif"
    )


def residual(x: Column, y: Column, beta: Column) -> Column:
    """Target minus the dot product with the coefficients."""
    return y - F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def with_residuals(design: DataFrame, fits: DataFrame, by: Sequence[str] = ("site_id", "sensor")) -> DataFrame:
    joined = design.join(fits.select(*by, "beta"), list(by))
    return joined.withColumn("residual", residual(F.col("x"), F.col("y"), F.col("beta"))).drop("beta")


def holdout(design: DataFrame, fits: DataFrame, by: Sequence[str] = ("site_id", "sensor"), min_rows: int = 1_000,
            share: int = 5, held: Column | None = None) -> DataFrame:
    """Error on a fifth of the rows when fitted on the rest, with the full fit's penalty and scale.

    `held` marks the rows held out; without it they are dealt by a hash of their key. Two matrices per group are
    summed, and both errors follow from them: no second pass over the rows.
    """
    keys = list(by)
    held = held if held is not None else F.pmod(F.xxhash64(*keys, "ts"), F.lit(share)) == 0
    dealt = design.withColumn("fold", held.cast("int"))
    grams = gram(dealt, [*keys, "fold"])
    sides = grams.groupBy(*keys).agg(
        F.max(F.when(F.col("fold") == 0, F.col("g"))).alias("train"), F.max(F.when(F.col("fold") == 1, F.col("g"))).alias("test")
    ).join(fits.filter(F.col("n") >= min_rows).select(*keys, "lam", "scale"), keys).filter(
        F.col("train").isNotNull() & F.col("test").isNotNull()
    )
    types = dict(sides.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", in_rmse double, out_rmse double, degradation double"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                xtx, xty, _, n, _, yy = _unpack(record.train)
                vxx, vxy, _, m, _, vyy = _unpack(record.test)
                beta, _ = _solve(xtx, xty, np.asarray(record.scale), record.lam)
                inside = float(np.sqrt(_sse(beta, xtx, xty, yy) / n))
                outside = float(np.sqrt(_sse(beta, vxx, vxy, vyy) / m))
                worse = (outside - inside) / inside if inside > 0 and outside > 0 else None
                rows.append((*[getattr(record, k) for k in keys], inside, outside, worse))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return sides.mapInPandas(judge, schema)


def bootstrap_cv(design: DataFrame, fits: DataFrame, features: Sequence[str], by: Sequence[str] = ("site_id", "sensor"),
                 replicates: int = 50, blocks: int = 32, min_rows: int = 500, block: Column | None = None) -> DataFrame:
    """Mean and spread of every coefficient over block resamples, and spread over mean (0 where the mean is about zero).

    Rows are dealt into blocks by `block` (from 0 on), or by a hash of their key. One matrix per group and block goes through the
    shuffle; a replicate draws blocks with replacement and weighs their matrices, so the number of replicates moves no data.
    """
    keys = list(by)
    place = block if block is not None else F.pmod(F.xxhash64(*keys, "ts"), F.lit(blocks))
    dealt = design.withColumn("__block", place.cast("int")).join(fits.filter(F.col("n") >= min_rows).select(*keys), keys, "left_semi")
    held = gram(dealt, [*keys, "__block"]).groupBy(*keys).agg(F.collect_list(F.struct("__block", "g")).alias("blocks")).join(fits.select(*keys, "lam", "scale"), keys)
    types = dict(held.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", feature string, mean_beta double, sd_beta double, cv double"
    weights, names = draws(replicates, blocks), list(features)

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                size = len(record.blocks[0]["g"])
                cells = np.zeros((blocks, size))
                for own in record.blocks:
                    cells[own["__block"]] = own["g"]
                betas = np.stack([_solve(*_unpack(g)[:2], np.asarray(record.scale), record.lam)[0] for g in weights @ cells])
                for name, mean, spread in zip(names, betas.mean(axis=0), betas.std(axis=0), strict=True):
                    rows.append((*[getattr(record, k) for k in keys], name, mean, spread, spread / abs(mean) if abs(mean) > 1e-10 else 0.0))
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "feature", "mean_beta", "sd_beta", "cv"])

    return held.mapInPandas(refit, schema)
