"""Scalers over array features and linear projections.

Statistics are population ones (no degrees of freedom taken off); a spread below ``FLOOR`` counts as 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR, SHRINK = 1e-12, 64


def fit_scaler(df: DataFrame, features: str = "f", keys: Sequence[str] = ()) -> DataFrame:
    """keys, mean and scale arrays: one row a group. Features are exploded by place, so sums combine before the shuffle."""
    long = df.select(*keys, F.posexplode(F.col(features)).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    scale = F.when(F.col("s") < FLOOR, 1.0).otherwise(F.col("s"))
    row = F.array_sort(F.collect_list(F.struct("i", "m", scale.alias("s"))))
    return long.groupBy(*keys).agg(row.alias("r")).select(*keys, F.transform("r", lambda r: r["m"]).alias("mean"), F.transform("r", lambda r: r["s"]).alias("scale"))


def standardise(features: Column, mean: Column, scale: Column, as_float: bool = True) -> Column:
    z = F.transform(F.arrays_zip(features.alias("x"), mean.alias("m"), scale.alias("s")), lambda t: (t["x"].cast("double") - t["m"]) / t["s"])
    return z.cast("array<float>") if as_float else z


def apply_scaler(df: DataFrame, scaler: DataFrame, features: str = "f", as_float: bool = True) -> DataFrame:
    """Features become standardised ones; the scaler is one row."""
    names = [c for c in df.columns if c != features]
    return df.join(F.broadcast(scaler.select("mean", "scale")), F.lit(True)).select(*names, standardise(F.col(features), F.col("mean"), F.col("scale"), as_float).alias(features))


def transform_queries(df: DataFrame, scaler: DataFrame, descriptor: str, features: str = "f") -> DataFrame:
    """``apply_scaler`` by a frozen scaler (one row with its descriptor_id); reading a row under another descriptor is an error."""
    names = [c for c in df.columns if c != features]
    joined = df.join(F.broadcast(scaler.select("mean", "scale", "descriptor_id")), F.lit(True))
    same = F.assert_true(F.col("descriptor_id").eqNullSafe(F.lit(descriptor)), F.lit("the scaler is of another descriptor")).isNull()
    return joined.filter(same).select(*names, standardise(F.col(features), F.col("mean"), F.col("scale")).alias(features))


def fit_shrunk_scaler(df: DataFrame, key: str, block: Column, value: str, shrink: int = SHRINK) -> DataFrame:
    """Per key: mean, variance shrunk by n / (n + shrink) towards its prior, and mode.

    The prior is the pooled variance of the other keys of the block (mode 1), else that of the other blocks (mode 2), else the key's own (mode 3).
    Everything follows from one aggregation to a row a key.
    """
    x = F.col(value).cast("double")
    own = df.groupBy(F.col(key), block.alias("block")).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    blocks = own.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"), F.sum("q").alias("bq"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    j = own.join(blocks, "block").join(F.broadcast(total), F.lit(True))

    def variance(n, s, q):
        return F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))

    on, os, oq = F.col("bn") - F.col("n"), F.col("bs") - F.col("s"), F.col("bq") - F.col("q")
    en, es, eq = F.col("tn") - F.col("bn"), F.col("ts") - F.col("bs"), F.col("tq") - F.col("bq")
    local = variance(F.col("n"), F.col("s"), F.col("q"))
    mode = F.when(on > 0, 1).when(en > 0, 2).otherwise(3)
    prior = F.when(on > 0, variance(on, os, oq)).when(en > 0, variance(en, es, eq)).otherwise(local)
    w = F.col("n") / (F.col("n") + shrink)
    return j.select(key, "block", "n", (F.col("s") / F.col("n")).alias("mean"), (w * local + (1 - w) * prior).alias("variance"), mode.alias("mode"))


def apply_keyed_scaler(df: DataFrame, scaler: DataFrame, key: str, value: str, name: str = "z") -> DataFrame:
    """Values by their key's scaler; a key without one gives 0."""
    s = F.sqrt("variance")
    j = df.join(scaler.select(key, "mean", "variance"), key, "left")
    return j.withColumn(name, F.coalesce((F.col(value) - F.col("mean")) / F.when(s < FLOOR, 1.0).otherwise(s), F.lit(0.0))).drop("mean", "variance")


def fit_pca(df: DataFrame, components: int, features: str = "f") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows) and variances. Two passes: sums, then the centred scatter, each one row a task; the driver gets width * width numbers.

    Each component's loading of largest size is positive.
    """
    mean = np.array(fit_scaler(df, features).first()["mean"])
    width = len(mean)

    def scatter(batches):
        total, n = np.zeros((width, width)), 0
        for b in batches:
            x = np.stack(b["f"]).astype(float) - mean
            total, n = total + x.T @ x, n + len(x)
        if n:
            yield pd.DataFrame({"i": range(-1, width * width), "v": np.r_[float(n), total.ravel()]})

    rows = df.select(F.col(features).alias("f")).mapInPandas(scatter, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # width * width rows
    got = {r["i"]: r["v"] for r in rows}
    s = np.array([got[i] for i in range(width * width)]).reshape(width, width) / got[-1]
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    rows = vectors[:, order].T
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return mean, rows * np.where(sign == 0, 1, sign)[:, None], np.maximum(values[order], 0)


def svd_pca(x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_pca`` of one matrix by its singular values, for samples that fit in a process."""
    x = np.asarray(x, float)
    if x.ndim != 2 or not np.isfinite(x).all() or not 1 <= components <= min(x.shape):
        raise ValueError("a finite matrix with as many rows and columns as components is needed")
    mean = x.mean(0)
    _, size, rows = np.linalg.svd(x - mean, full_matrices=False)
    rows = rows[:components]
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return mean, rows * np.where(sign == 0, 1, sign)[:, None], size[:components] ** 2 / len(x)


def apply_pca(df: DataFrame, mean: np.ndarray, rows: np.ndarray, features: str = "f", name: str = "projected") -> DataFrame:
    """(x - mean) times the components; the model has width * components numbers."""

    @F.pandas_udf("array<double>")
    def project(f: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(f).astype(float) - mean) @ rows.T)) if len(f) else pd.Series([], dtype=object)

    return df.withColumn(name, project(features))


def fold_schedule(families: Sequence) -> list[tuple[object, object | None, tuple]]:
    """(outer, inner or None, families to fit on) of a nested leave-one-family-out run."""
    out = []
    for outer in families:
        rest = [f for f in families if f != outer]
        out += [(outer, inner, tuple(f for f in rest if f != inner)) for inner in rest]
        out.append((outer, None, tuple(rest)))
    return out
