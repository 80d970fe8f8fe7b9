"""Top fractions, thresholds, 1-D two-means, candidate grids and choice, stratified samples, farthest points."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.prefix import running


def top_fraction(df: DataFrame, keys: Sequence[str], score: str, tie: str, fraction: float | Column, eligible: Column | None = None, positive: bool = True, at_least_one: bool = False, name: str = "selected") -> DataFrame:
    """Marks the first ceil(fraction * all rows of the group) by (score descending, tie) among eligible rows.

    positive: only scores above 0 may be chosen. Rows that may not be chosen still count in the group's size.
    """
    ok = eligible if eligible is not None else F.lit(True)
    if positive:
        ok = ok & (F.col(score) > 0)
    share = F.lit(fraction).cast("double") if not isinstance(fraction, Column) else fraction
    marked = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    numbered = running(marked, keys, [F.desc("__ok"), F.desc(score), F.col(tie)], {"__nth": F.lit(1).cast("long")})
    n = F.ceil(share * F.col("__nth_all"))
    n = F.greatest(n, F.lit(1)) if at_least_one else n
    return numbered.withColumn(name, F.col("__ok") & (F.col("__nth") <= n)).drop("__ok", "__nth", "__nth_all")


def threshold(score: str, t: float | Column, eligible: Column | None = None, strict: bool = False) -> Column:
    s, ok = F.col(score), eligible if eligible is not None else F.lit(True)
    return F.coalesce(ok & ((s > t) if strict else (s >= t)), F.lit(False))


def two_means(df: DataFrame, keys: Sequence[str], score: str, eligible: Column | None = None, name: str = "high") -> DataFrame:
    """Marks the upper cluster of the best split of sorted values; of equally good splits the lowest. A constant group has none.

    Values are shifted and scaled to [0, 1] first. Distinct values with their counts are added up in two levels.
    """
    ok = eligible if eligible is not None else F.lit(True)
    rows = df.filter(ok)
    values = rows.groupBy(*keys, F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = values.groupBy(*keys).agg(F.min("v").alias("__low"), F.max("v").alias("__high"))
    scaled = values.join(ends, list(keys)) if keys else values.join(F.broadcast(ends), F.lit(True))
    scaled = scaled.select(*keys, "v", "c", F.when(F.col("__high") > F.col("__low"), (F.col("v") - F.col("__low")) / (F.col("__high") - F.col("__low"))).alias("x"))
    s = running(scaled, keys, [F.col("v")], {"n1": "c", "s1": F.col("c") * F.col("x"), "q1": F.col("c") * F.col("x") * F.col("x")}).withColumnsRenamed({"n1_all": "n", "s1_all": "s", "q1_all": "q"})
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    error = F.col("q1") - F.col("s1") * F.col("s1") / F.col("n1") + (F.col("q") - F.col("q1")) - s2 * s2 / n2
    best = s.filter((n2 > 0) & F.col("s").isNotNull()).withColumn("e", F.round(error, 12)).groupBy(*keys).agg(F.min_by("v", F.struct("e", "v")).alias("__cut"))
    joined = df.join(best, list(keys), "left") if keys else df.join(best, F.lit(True), "left")
    return joined.withColumn(name, F.coalesce(ok & (F.col(score) > F.col("__cut")), F.lit(False))).drop("__cut")


def best_f1_threshold(df: DataFrame, keys: Sequence[str], label: str, score: str, by_precision: bool = False) -> DataFrame:
    """The score whose inclusive threshold has the largest F1; of equal ones the highest threshold (or first the better precision)."""
    y = F.col(label)
    steps = df.groupBy(*keys, F.col(score).alias("cut")).agg(F.sum(F.when(y, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("c"))
    seen = running(steps, keys, [F.desc("cut")], {"tp": "pos", "k": "c"}).withColumnRenamed("tp_all", "p")
    f1 = F.round(F.when(F.col("k") + F.col("p") > 0, 2 * F.col("tp") / (F.col("k") + F.col("p"))).otherwise(0.0), 12)
    order = F.struct("f1", "precision", "cut") if by_precision else F.struct("f1", "cut")
    seen = seen.withColumn("f1", f1).withColumn("precision", F.round(F.col("tp") / F.col("k"), 12))
    return seen.groupBy(*keys).agg(F.max_by("cut", order).alias("threshold"), F.max("f1").alias("best_f1"))


def candidate_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the axes' values, numbered in order; a bounded literal table."""
    names = list(axes)
    rows = [(i, *map(str, combo)) for i, combo in enumerate(itertools.product(*axes.values()))]
    return spark.createDataFrame(rows, "candidate long, " + ", ".join(f"{n} string" for n in names))


def select_candidate(df: DataFrame, keys: Sequence[str] = (), candidate: str = "candidate") -> DataFrame:
    """The candidate with the largest (f1, average_precision, balanced_accuracy, precision, recall), then the smallest id."""
    order = F.struct(*[-F.coalesce(F.col(c), F.lit(-1.0)) for c in ("f1", "average_precision", "balanced_accuracy", "precision", "recall")], F.col(candidate))
    return df.groupBy(*keys).agg(F.min_by(candidate, order).alias(candidate), F.max("f1").alias("f1"))


def stable_seed(base: int, *identity) -> int:
    """The first eight bytes, little-endian, of SHA-256 over the base and the identity."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, (base, *identity))).encode()).digest()[:8], "little")


def balanced_sample(df: DataFrame, strata: Sequence[str], label: str, identity: str, most: int, seed: int = 0, skip_single: bool = True) -> DataFrame:
    """As many rows of each class in each stratum: min(most, fewer of the two), by a hash order that no partitioning changes."""
    counts = df.groupBy(*strata).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("c"))
    take = F.least(F.lit(most), F.col("p"), F.col("c") - F.col("p"))
    counts = counts.select(*strata, (take if skip_single else F.least(F.lit(most), F.greatest(take, F.lit(0)))).alias("__take"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")))
    nth = F.row_number().over(Window.partitionBy(*strata, label).orderBy(order, identity))
    return df.join(counts, list(strata)).withColumn("__nth", nth).filter("__nth <= __take").drop("__nth", "__take")


def sequential_draws(counts: DataFrame, strata: Sequence[str], most: int, seed: int, limit: int = 1 << 22) -> DataFrame:
    """The ordinals drawn in each two-class stratum, in order, by one generator over all strata; strata that are skipped draw nothing.

    counts: strata, n0, n1; one row a stratum (a bounded table: strata, not rows). Returns strata, class and ordinal. One generator means one
    process, so more than ``limit`` drawn rows are an error, never a cut; ``balanced_sample`` has no such bound.
    """
    drawn = counts.agg(F.sum(2 * F.least(F.lit(most), F.col("n0"), F.col("n1")))).first()[0] or 0
    if drawn > limit:
        raise ValueError(f"{drawn} rows to draw; one generator draws no more than {limit}")
    rng, out = np.random.default_rng(seed), []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in strata)
    for r in counts.orderBy(*strata).collect():
        n = min(most, r["n0"], r["n1"])
        if n > 0:
            for cls, size in ((0, r["n0"]), (1, r["n1"])):
                out += [(*[r[k] for k in strata], cls, int(i)) for i in np.sort(rng.choice(size, n, replace=False))]
    return counts.sparkSession.createDataFrame(out, f"{schema}, class int, ordinal long")


def farthest_points(points: np.ndarray, count: int, start: int, ties: np.random.Generator | None = None) -> list[int]:
    """Greedy maximin order: each next point is the farthest from all chosen ones, of equally far ones the first, or one that ties draws."""
    if not len(points):
        return []
    chosen = [start]
    distance = ((points - points[start]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)):
        far = np.flatnonzero(distance == distance.max())
        chosen.append(int(far[0] if ties is None or len(far) == 1 else ties.choice(far)))
        distance = np.minimum(distance, ((points - points[chosen[-1]]) ** 2).sum(1))
        distance[chosen] = -1
    return chosen


def farthest_sample(df: DataFrame, strata: Sequence[str], identity: str, features: Sequence[str], count: int, seed: int = 0, group_limit: int = 50_000, random_ties: bool = False) -> DataFrame:
    """Up to count spread-out rows a stratum, with their order of choice. A stratum beyond group_limit rows is an error, never a cut."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group_limit)
    if not sizes.isEmpty():
        raise ValueError(f"a stratum has more than {group_limit} rows; refine the strata")

    def pick(key, pdf):
        pdf = pdf.sort_values(identity, kind="stable").reset_index(drop=True)
        start = stable_seed(seed, *key) % len(pdf)
        ties = np.random.default_rng(stable_seed(seed, "ties", *key)) if random_ties else None
        at = farthest_points(pdf[list(features)].to_numpy(float), count, start, ties)
        return pd.DataFrame({**{k: v for k, v in zip(strata, key)}, identity: pdf[identity].iloc[at].to_numpy(), "nth": range(len(at))})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*strata, identity]) + ", nth long"
    return df.select(*strata, identity, *features).groupBy(*strata).applyInPandas(pick, schema)
