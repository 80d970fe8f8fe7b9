"""Joins on identity, set-equality checks, pairing across blocks and arc-target lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows of either side, keys that both have, that only one has, and keys that occur more than once."""
    one = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("ca"))
    two = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("cb"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return one.join(two, list(keys), "full").agg(
        F.coalesce(F.sum("ca"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("cb"), F.lit(0)).alias("right_rows"), n(F.col("ca").isNotNull() & F.col("cb").isNotNull()).alias("matched"),
        n(F.col("cb").isNull()).alias("left_only"), n(F.col("ca").isNull()).alias("right_only"), n((F.col("ca") > 1) | (F.col("cb") > 1)).alias("repeated"),
    )


def exact_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join, after a check that both sides have the same keys, each once."""
    d = key_differences(a, b, keys).first()
    if d["left_only"] or d["right_only"] or d["repeated"]:
        raise ValueError(f"the sides differ: {d.asDict()}")
    return a.join(b, list(keys))


def value_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per value column, the number of shared keys whose values differ (nulls equal)."""
    j = a.select(*keys, *values).join(b.select(*keys, *[F.col(v).alias(f"__{v}") for v in values]), list(keys))
    return j.agg(*[F.sum(F.when(F.col(v).eqNullSafe(F.col(f"__{v}")), 0).otherwise(1)).cast("long").alias(v) for v in values])


def pair_blocks(df: DataFrame, keys: Sequence[str], block: str, value: str, valid: Column) -> DataFrame:
    """One row a centre with both blocks' values and validity; an absent block is null and invalid. One aggregation, no self join."""
    out = [F.max(F.when(F.col(block) == b, F.col(value))).alias(n) for b, n in ((0, "first"), (1, "second"))]
    ok = [F.coalesce(F.max(F.when(F.col(block) == b, valid)), F.lit(False)).alias(n) for b, n in ((0, "first_valid"), (1, "second_valid"))]
    return df.groupBy(*keys).agg(*out, *ok)


def project_back(rows: DataFrame, centres: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Centre columns on the centre's rows; rows without a centre have nulls."""
    return rows.join(centres.select(*keys, *columns), list(keys), "left")


def arc_targets(path: DataFrame, key: str, order: Sequence[str], coordinates: Sequence[str], samples: int) -> DataFrame:
    """samples points at equal arc distances along each ordered path, by linear interpolation within segments.

    A segment emits the targets that it contains, so nothing is joined by range. Paths of no length, or one point, give no rows.
    """
    w = Window.partitionBy(key).orderBy(*order)
    steps = [F.col(c) - F.lag(c).over(w) for c in coordinates]
    length = F.sqrt(sum((s * s for s in steps[1:]), steps[0] * steps[0]))
    seg = path.select(key, *order, *coordinates, *[F.lag(c).over(w).alias(f"__{c}") for c in coordinates], length.alias("__len"))
    seg = seg.withColumn("__hi", F.sum("__len").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__len > 0")
    seg = seg.withColumn("__lo", F.col("__hi") - F.col("__len")).withColumn("__total", F.max("__hi").over(Window.partitionBy(key)))
    step = F.col("__total") / F.lit(float(samples - 1))
    first = F.when(F.col("__lo") <= 0, F.lit(0)).otherwise(F.floor(F.col("__lo") / step) + 1)
    last = F.when(F.col("__hi") >= F.col("__total"), F.lit(samples - 1)).otherwise(F.floor(F.col("__hi") / step))
    out = seg.withColumn("__a", first.cast("int")).withColumn("__b", last.cast("int")).filter("__a <= __b").withColumn("sample", F.explode(F.sequence("__a", "__b")))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("sample") * step - F.col("__lo")) / F.col("__len")))
    return out.select(key, "sample", *[(F.col(f"__{c}") + share * (F.col(c) - F.col(f"__{c}"))).alias(c) for c in coordinates])
