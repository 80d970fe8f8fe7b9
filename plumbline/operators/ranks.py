"""Ranks within groups and masked Gaussian smoothing on a grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.prefix import running


def percentile_rank(keys: Sequence[str], score: str, tie: str) -> Column:
    """Row number by (score, tie) over group size: in (0, 1]."""
    w = Window.partitionBy(*keys)
    return F.row_number().over(w.orderBy(score, tie)) / F.count(F.lit(1)).over(w)


def supported_rank(keys: Sequence[str], score: str, tie: str, supported: Column) -> Column:
    """The percentile rank among supported rows; 0 for the others."""
    w = Window.partitionBy(*keys, supported)
    return F.when(supported, F.row_number().over(w.orderBy(score, tie)) / F.count(F.lit(1)).over(w)).otherwise(F.lit(0.0))


def midrank(keys: Sequence[str], value: str) -> Column:
    """(Average 1-based rank - 0.5) / n, ties sharing their average."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return (F.rank().over(w.orderBy(value)) + (ties - 1) * F.lit(0.5) - F.lit(0.5)) / F.count(F.lit(1)).over(w)


def with_percentile_rank(df: DataFrame, keys: Sequence[str], score: str, tie: str, name: str = "rank", supported: Column | None = None) -> DataFrame:
    """df with ``percentile_rank`` (or, with supported, ``supported_rank``) of groups of any size."""
    ok = supported if supported is not None else F.lit(True)
    out = running(df.withColumn("__ok", ok), [*keys, "__ok"], [F.col(score), F.col(tie)], {"__nth": F.lit(1).cast("long")})
    return out.withColumn(name, F.when(F.col("__ok"), F.col("__nth") / F.col("__nth_all")).otherwise(F.lit(0.0))).drop("__ok", "__nth", "__nth_all")


def with_midrank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """df with ``midrank`` of groups of any size: ranks of distinct values, joined back."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    seen = running(counted, keys, [F.col(value)], {"__n": "__c"})
    rank = ((F.col("__n") - (F.col("__c") - 1) * F.lit(0.5) - F.lit(0.5)) / F.col("__n_all")).alias(name)
    seen = seen.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), rank)
    on = F.col(value).eqNullSafe(F.col("__v"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(seen, on).drop("__v", *[f"__k{i}" for i in range(len(keys))])


def with_running_sum(df: DataFrame, keys: Sequence[str], value: str, order: Sequence, name: str = "total") -> DataFrame:
    """df with ``running_sum`` of groups of any size. The order must tell rows apart."""
    return running(df, keys, order, {name: value}).drop(f"{name}_all")


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> list[tuple[int, float]]:
    """(offset, weight), weights adding to 1."""
    if sigma <= 0:
        return [(0, 1.0)]
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i - r, w / sum(raw)) for i, w in enumerate(raw)]


def _axis(df: DataFrame, keys: Sequence[str], axes: Sequence[str], axis: str, size: int, kernel) -> DataFrame:
    """One axis of a separable convolution with zeros outside: every cell gives to 2 r + 1 cells, summed on the map side first."""
    offsets = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel])
    spread = df.withColumn("k", F.explode(offsets)).withColumn(axis, F.col(axis) + F.col("k.o")).filter((F.col(axis) >= 0) & (F.col(axis) < size))
    return spread.groupBy(*keys, *axes).agg(F.sum(F.col("num") * F.col("k.w")).alias("num"), F.sum(F.col("den") * F.col("k.w")).alias("den"))


def masked_gaussian(df: DataFrame, keys: Sequence[str], axes: dict[str, int], value: str, supported: Column, sigma: float, truncate: float = 3.0) -> DataFrame:
    """G(value * mask) / G(mask) at every cell that any supported cell reaches. df: one row a cell; axes: name to size."""
    kernel, names = gaussian_kernel(sigma, truncate), list(axes)
    out = df.filter(supported).select(*keys, *[F.col(a).cast("int").alias(a) for a in names], F.col(value).cast("double").alias("num"), F.lit(1.0).alias("den"))
    for a in names:
        out = _axis(out, keys, names, a, axes[a], kernel)
    return out.filter("den > 0").select(*keys, *names, (F.col("num") / F.col("den")).alias("smooth"))


def smoothing_states(df: DataFrame, keys: Sequence[str], axes: dict[str, int], value: str, supported: Column, sigma: float, truncate: float = 3.0) -> DataFrame:
    """Every cell of df with its smoothed value and state: supported, imputed from neighbours, or unimputable (value 0)."""
    smooth = masked_gaussian(df, keys, axes, value, supported, sigma, truncate)
    joined = df.withColumn("__s", supported).join(smooth, [*keys, *axes], "left")
    state = F.when(F.col("__s"), "supported").when(F.col("smooth").isNotNull(), "imputed").otherwise("unimputable")
    return joined.withColumn("state", state).withColumn("smooth", F.coalesce("smooth", F.lit(0.0))).drop("__s")


def running_sum(keys: Sequence[str], value: str, *order) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
