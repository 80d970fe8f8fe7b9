"""Binary-decision metrics, their groupings, macro means and paired bootstrap.

Metrics are null where they are undefined (no positives for AP; one class for AUROC and balanced accuracy). Precision, recall and F1 are 0 on a
zero denominator. Equal scores are one threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import quantiles, running


def _n(condition: Column, weight: str | None = None) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(weight) if weight else 1).otherwise(0)), F.lit(0)).cast("long")


def _ratio(a: Column, b: Column, empty=0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def confusion(df: DataFrame, keys: Sequence[str], label: str = "y", prediction: str = "p", weight: str | None = None) -> DataFrame:
    """Counts per group, in one partially aggregated pass; weight: how many rows a row stands for."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*keys).agg(_n(F.lit(True), weight).alias("n"), _n(y, weight).alias("positives"), _n(y & p, weight).alias("tp"), _n(~y & p, weight).alias("fp"), _n(~y & ~p, weight).alias("tn"), _n(y & ~p, weight).alias("fn"))


def decision_metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 and balanced_accuracy to confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    both = (tp + fn > 0) & (tn + fp > 0)
    return counts.select(
        "*", _ratio(tp + tn, F.col("n"), None).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when(both, (recall + spec) / 2).alias("balanced_accuracy"),
    )


def ranking(df: DataFrame, keys: Sequence[str], label: str = "y", score: str = "s", weight: str | None = None) -> DataFrame:
    """average_precision and auroc per group, from one table of distinct scores.

    The first aggregation is by score; the distinct scores are then added up in two levels, so a group may have any number of them.
    """
    y = F.col(label)
    steps = df.groupBy(*keys, score).agg(_n(y, weight).alias("pos"), _n(~y, weight).alias("neg"))
    seen = running(steps, keys, [F.desc(score)], {"tp": "pos", "fp": "neg"}).withColumnsRenamed({"tp_all": "p", "fp_all": "q"})
    ap = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    area = F.sum(F.col("pos") * (F.col("q") - F.col("fp") + F.col("neg") * F.lit(0.5)))
    p, q = F.first("p"), F.first("q")
    return seen.groupBy(*keys).agg(F.when(p > 0, ap / p).alias("average_precision"), F.when((p > 0) & (q > 0), area / (p * q).cast("double")).alias("auroc"))


def metric_rows(df: DataFrame, keys: Sequence[str], label: str = "y", prediction: str = "p", score: str = "s") -> DataFrame:
    """All metrics per group. Rows are first counted by group, score, label and decision; both halves read that one exchange, so df runs once."""
    base = df.groupBy(*keys, score, label, prediction).agg(F.count(F.lit(1)).alias("__c"))
    counts, ranked = decision_metrics(confusion(base, keys, label, prediction, "__c")), ranking(base, keys, label, score, "__c")
    return counts.join(ranked, list(keys) if keys else F.lit(True))


def with_coverage(rows: DataFrame, assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds assigned, valid, invalid and coverage; groups without any valid row stay, with nulls. assigned: keys, assigned."""
    out = assigned.join(rows, list(keys), "left")
    valid = F.coalesce("n", F.lit(0)).cast("long")
    return out.withColumn("valid", valid).withColumn("invalid", F.col("assigned") - valid).withColumn("coverage", _ratio(valid, F.col("assigned"), None))


def grouping_levels(df: DataFrame, levels: Sequence[Sequence[str]], label: str = "y", prediction: str = "p") -> DataFrame:
    """Confusion metrics at several levels by one GROUPING SETS; absent keys are null and ``level`` is the grouping id."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    y, p = F.col(label), F.col(prediction)
    sets = [[F.col(k) for k in level] for level in levels]
    out = df.groupingSets(sets, *keys).agg(
        F.grouping_id(*keys).cast("long").alias("level"), F.count(F.lit(1)).alias("n"), _n(y).alias("positives"), _n(y & p).alias("tp"), _n(~y & p).alias("fp"), _n(~y & ~p).alias("tn"), _n(y & ~p).alias("fn")
    )
    return decision_metrics(out)


def subset_f1(df: DataFrame, keys: Sequence[str], mask: Column, label: str = "y", prediction: str = "p") -> DataFrame:
    """F1 over the masked rows; null where the mask selects none."""
    y, p = F.col(label), F.col(prediction)
    tp, fp, fn = _n(mask & y & p), _n(mask & ~y & p), _n(mask & y & ~p)
    return df.groupBy(*keys).agg(F.when(_n(mask) > 0, _ratio(2 * tp, 2 * tp + fp + fn)).alias("subset_f1"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], label: str = "y", score: str = "s", eligible: Column | None = None) -> DataFrame:
    """tp, fp and f1 at each threshold (score >= threshold), by one histogram over threshold intervals and a suffix sum."""
    cuts = sorted(thresholds)
    ok = eligible if eligible is not None else F.lit(True)
    slot = sum(F.when(ok & (F.col(score) >= t), 1).otherwise(0) for t in cuts)
    hist = df.groupBy(slot.cast("int").alias("slot")).agg(_n(F.col(label)).alias("pos"), _n(~F.col(label)).alias("neg"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(cuts)], "k int, threshold double")
    joined = grid.join(hist, F.lit(True)).groupBy("threshold").agg(
        F.sum(F.when(F.col("slot") >= F.col("k"), F.col("pos")).otherwise(0)).cast("long").alias("tp"), F.sum(F.when(F.col("slot") >= F.col("k"), F.col("neg")).otherwise(0)).cast("long").alias("fp"), F.sum("pos").cast("long").alias("positives")
    )
    return joined.withColumn("f1", _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")))


def macro_mean(df: DataFrame, levels: Sequence[Sequence[str]], value: str, keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Means of means, finest level first; keep: columns kept at every level.

    strict: an undefined value at any level makes the mean above it undefined; otherwise it is skipped.
    """
    out = df.select(*dict.fromkeys([*keep, *levels[0]]), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v"))
    for level in [*levels[1:], ()]:
        mean = F.avg("v")
        out = out.groupBy(*dict.fromkeys([*keep, *level])).agg((F.when(F.count("v") == F.count(F.lit(1)), mean) if strict else mean).alias("v"))
    return out.withColumnRenamed("v", value)


def coverage_counts(df: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """How many rows only one, both or none of two conditions cover."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return df.groupBy(*keys).agg(_n(a & b).alias("both"), _n(a & ~b).alias("first_only"), _n(~a & b).alias("second_only"), _n(~a & ~b).alias("neither"))


def stratum_coverage(df: DataFrame, strata: DataFrame, keys: Sequence[str], label: str = "y") -> DataFrame:
    """Counts for every stratum of a full grid; those without rows have zeros."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _n(F.col(label)).alias("positives"))
    out = strata.join(counts, list(keys), "left").na.fill(0, ["n", "positives"])
    return out.withColumn("two_class", (F.col("positives") > 0) & (F.col("positives") < F.col("n")))


def paired_bootstrap(units: DataFrame, draws: DataFrame, first: str, second: str, family: str = "family", position: str = "pos", levels=(0.025, 0.975)) -> DataFrame:
    """Point difference and percentile interval of first - second.

    units: one row a unit, numbered from 0 within its family. draws: (replicate, family, pos), the same draws for both sides. A
    replicate's value is the mean over families of its mean difference; only one row for each replicate is ever aggregated globally.
    Draws are many more than any estimate of what makes them says, so both sides of their join are sorted, and neither is broadcast.
    """
    diff = units.select(family, position, (F.col(first) - F.col(second)).alias("d"))
    by_family = draws.hint("merge").join(diff, [family, position]).groupBy("replicate", family).agg(F.avg("d").alias("d"))
    replicates = by_family.groupBy("replicate").agg(F.avg("d").alias("d"))
    lo, hi = (F.percentile("d", F.lit(p)) for p in levels)
    interval = replicates.agg(lo.alias("ci_lower"), hi.alias("ci_upper"), F.count("d").alias("replicates"))
    point = diff.groupBy(family).agg(F.avg("d").alias("d")).agg(F.avg("d").alias("point"))
    return point.join(interval, F.lit(True))


def counterexamples(df: DataFrame, keys: Sequence[str], method: str, value: str, ours: str, theirs: str) -> DataFrame:
    """Groups in which our method is no better than the other."""
    wide = df.groupBy(*keys).agg(F.max(F.when(F.col(method) == ours, F.col(value))).alias("ours"), F.max(F.when(F.col(method) == theirs, F.col(value))).alias("theirs"))
    return wide.withColumn("difference", F.col("ours") - F.col("theirs")).filter("difference <= 0")


def success_rule(df: DataFrame, value: str, least: float, count: int, mean: float) -> DataFrame:
    """Whether at least ``count`` rows reach ``least`` and the mean reaches ``mean``."""
    good = _n(F.col(value) >= least)
    return df.agg(good.alias("reached"), F.avg(value).alias("mean"), ((good >= count) & (F.avg(value) >= mean)).alias("success"))


def stop_certificate(df: DataFrame, value: str, total: int, target: float) -> DataFrame:
    """The best mean still possible if all remaining units scored 1, and whether the target is out of reach."""
    bound = (F.sum(value) + (F.lit(total) - F.count(value))) / F.lit(float(total))
    return df.agg(F.count(value).alias("done"), bound.alias("upper_bound"), (bound < target).alias("stop"))


def quantile(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Linear quantiles of the finite values; null for a group without any."""
    v = F.when(F.abs(F.nanvl(F.col(value).cast("double"), F.lit(None))) < F.lit(float("inf")), F.col(value).cast("double"))
    return quantiles(df.select(*keys, v.alias("__value")), keys, "__value", {f"q{round(p * 1000)}": p for p in probabilities})
