"""Projections, filters and fail-closed checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.prefix import quantiles


def centred(keys: Sequence[str], columns: Sequence[str], *order) -> list[Column]:
    """Columns less their first value in the group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return [(F.col(c) - F.first(c).over(w)).alias(c) for c in columns]


def pick(features: Column, indices: Sequence[int]) -> Column:
    """The features at 0-based places, in that order."""
    return F.transform(F.array(*[F.lit(int(i)) for i in indices]), lambda i: F.get(features, i))


def feature_indices(kind: str, frequencies: int = 6, lines: int = 7, chirality: bool = True) -> list[int]:
    """Places of parts of a descriptor whose lines hold (real, imaginary, cosine) for each frequency, then frequencies - 1 chiralities.

    kind: ``all``, or parts joined by ``_`` out of real, imag, cosine and chirality, then optionally center, neighbor or all.
    """
    block = 3 * frequencies + (frequencies - 1 if chirality else 0)
    if kind == "all":
        return list(range(lines * block))
    words = kind.split("_")
    scope = {"center": [0], "neighbor": list(range(1, lines)), "all": list(range(lines))}.get(words[-1])
    parts = words if scope is None else words[:-1]
    places = {"real": range(0, 3 * frequencies, 3), "imag": range(1, 3 * frequencies, 3), "cosine": range(2, 3 * frequencies, 3), "chirality": range(3 * frequencies, block)}
    if not parts or any(w not in places for w in parts):
        raise ValueError(f"unknown part: {kind!r}")
    return [line * block + o for line in (scope or range(lines)) for w in parts for o in places[w]]


def complete_only(df: DataFrame, keys: Sequence[str], ok: Column, members: int) -> DataFrame:
    """Groups all of whose members hold and that have all of them."""
    good = df.groupBy(*keys).agg(F.bool_and(ok).alias("__ok"), F.count(F.lit(1)).alias("__n")).filter((F.col("__n") == members) & F.col("__ok")).select(*keys)
    return df.join(good, list(keys), "left_semi")


def percentile_mask(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.95, name: str = "mask") -> DataFrame:
    """value >= the group's linear percentile, which comes from two-level running counts, a row a group."""
    cut = quantiles(df, keys, value, {"__cut": share})
    j = df.join(cut, list(keys)) if keys else df.join(F.broadcast(cut), F.lit(True))
    return j.withColumn(name, F.col(value) >= F.col("__cut")).drop("__cut")


def scale_digits(scale: Column) -> list[Column]:
    """The three digits of a scale id of a 10 x 10 x 10 table, block offset removed."""
    local = scale % 1000
    return [F.floor(local / 100).cast("int").alias("dx"), (F.floor(local / 10) % 10).cast("int").alias("ds"), (local % 10).cast("int").alias("arc")]


def reshape_index(place: Column, lines: int = 7, samples: int = 32) -> list[Column]:
    """Line, sample and axis of a flat place in row-major order."""
    return [F.floor(place / (samples * 3)).cast("int").alias("line"), (F.floor(place / 3) % samples).cast("int").alias("sample"), (place % 3).cast("int").alias("axis")]


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The same rows; reading one that fails the condition is an error."""
    return df.filter(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def binary_label(column: str) -> Column:
    return F.col(column).cast("double").isin(0.0, 1.0)


def finite_features(column: str, width: int) -> Column:
    big = F.lit(3.4028234663852886e38)
    return (F.size(column) == width) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big))


def role(phase: Column, ordinal: Column) -> Column:
    """development: first two ordinals library, others tuning; confirmation: test."""
    return F.when(phase == "confirmation", "test").when(ordinal < 2, "library").otherwise("tuning")


def held_out(df: DataFrame, family: str, value) -> DataFrame:
    return df.filter(~F.col(family).eqNullSafe(F.lit(value)))


def concat_features(a: str, b: str, name: str = "features") -> Column:
    return F.concat(F.col(a).cast("array<float>"), F.col(b).cast("array<float>")).alias(name)


def confusion_class(label: str, prediction: str) -> Column:
    y, p = F.col(label), F.col(prediction)
    return F.when(y & p, "tp").when(~y & p, "fp").when(y & ~p, "fn").otherwise("tn")
