"""Empirical tails, shrunk tails, histograms, likelihood ratios and their combination over families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import running


def counts_below(reference: DataFrame, queries: DataFrame, keys: Sequence[str], value: str, identity: str) -> DataFrame:
    """Each query with n (reference rows of its key), lt (less than it) and ge (at least it).

    One union and one running count over (key, value) instead of a range join, in two levels, so a key may have any number of rows;
    reference rows are first counted by value.
    """
    ref = reference.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ref = ref.select(*keys, "__v", "__c", F.lit(1).alias("__tag"), F.lit(None).cast(dict(queries.dtypes)[identity]).alias(identity))
    qry = queries.select(*keys, F.col(value).cast("double").alias("__v"), F.lit(0).cast("long").alias("__c"), F.lit(0).alias("__tag"), identity)
    # Queries stand before equal references.
    both = running(ref.unionByName(qry), keys, [F.col("__v"), F.col("__tag")], {"lt": "__c"}).withColumnRenamed("lt_all", "n")
    return both.filter("__tag = 0").select(*keys, identity, F.col("__v").alias(value), "n", "lt", (F.col("n") - F.col("lt")).alias("ge"))


def tail_probability(reference: DataFrame, queries: DataFrame, keys: Sequence[str], value: str, identity: str) -> DataFrame:
    """(1 + number of references at least the value) / (n + 1)."""
    return counts_below(reference, queries, keys, value, identity).withColumn("tail", (F.col("ge") + 1) / (F.col("n") + 1))


def strict_ecdf(reference: DataFrame, queries: DataFrame, keys: Sequence[str], value: str, identity: str) -> DataFrame:
    """Number of references less than the value / (n + 1)."""
    return counts_below(reference, queries, keys, value, identity).withColumn("ecdf", F.col("lt") / (F.col("n") + 1))


def difference_tail(superset: DataFrame, excluded: DataFrame, queries: DataFrame, keys: Sequence[str], value: str, identity: str) -> DataFrame:
    """The tail probability against the superset less the excluded rows, from two counts."""
    a = counts_below(superset, queries, keys, value, identity).select(*keys, identity, value, F.col("n").alias("n1"), F.col("ge").alias("g1"))
    b = counts_below(excluded, queries, keys, value, identity).select(*keys, identity, F.col("n").alias("n2"), F.col("ge").alias("g2"))
    return a.join(b, [*keys, identity]).withColumn("tail", (F.col("g1") - F.col("g2") + 1) / (F.col("n1") - F.col("n2") + 1))


def shrunk_tail(reference: DataFrame, queries: DataFrame, key: str, block: str, value: str, identity: str, shrink: int = 64) -> DataFrame:
    """Tails shrunk from a key to the other keys of its block, or to the other blocks; and the mode.

    Modes: 0 nothing to go by, 1 key and block, 2 key and rest, 3 key only, 4 block only, 5 rest only.
    """
    own = counts_below(reference, queries, [block, key], value, identity).select(identity, block, key, value, "n", "ge")
    blk = counts_below(reference, queries, [block], value, identity).select(identity, F.col("n").alias("bn"), F.col("ge").alias("bg"))
    every = counts_below(reference, queries, [], value, identity).select(identity, F.col("n").alias("tn"), F.col("ge").alias("tg"))
    j = own.join(blk, identity).join(every, identity)
    n, on, en = F.col("n"), F.col("bn") - F.col("n"), F.col("tn") - F.col("bn")
    local = (F.col("ge") + 1) / (n + 1)
    near, far = (F.col("bg") - F.col("ge") + 1) / (on + 1), (F.col("tg") - F.col("bg") + 1) / (en + 1)
    w = n / (n + shrink)
    mode = F.when((n > 0) & (on > 0), 1).when((n > 0) & (en > 0), 2).when(n > 0, 3).when(on > 0, 4).when(en > 0, 5).otherwise(0)
    tail = F.when(mode == 1, w * local + (1 - w) * near).when(mode == 2, w * local + (1 - w) * far).when(mode == 3, local).when(mode == 4, near).when(mode == 5, far)
    return j.select(identity, block, key, value, mode.alias("mode"), tail.alias("tail"), (1 - tail).alias("anomaly"), (mode > 0).alias("supported"))


def histogram(df: DataFrame, keys: Sequence[str], rank: str, bins: int, beta: float) -> DataFrame:
    """Smoothed bin masses (count + beta) / (n + bins * beta) for every bin of every group."""
    bin_ = F.least(F.floor(F.col(rank) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return groups.join(counts, [*keys, "bin"], "left").withColumn("mass", (F.coalesce("c", F.lit(0)) + F.lit(float(beta))) / (F.col("n") + F.lit(float(bins * beta)))).drop("c")


def likelihood_ratio(df: DataFrame, family: str, label: str, rank: str, bins: int, beta: float) -> DataFrame:
    """Per bin the log ratio of the positives' and the negatives' masses, each the mean over families."""
    mass = histogram(df, [family, label], rank, bins, beta).groupBy(label, "bin").agg(F.avg("mass").alias("m"))
    wide = mass.groupBy("bin").agg(F.max(F.when(F.col(label), F.col("m"))).alias("pos"), F.max(F.when(~F.col(label), F.col("m"))).alias("neg"))
    return wide.withColumn("llr", F.log(F.col("pos") / F.col("neg")))


def score_ranks(df: DataFrame, model: DataFrame, rank: str, bins: int) -> DataFrame:
    """Adds the log ratio of each row's bin; the model has a row a bin."""
    return df.withColumn("bin", F.least(F.floor(F.col(rank) * bins), F.lit(bins - 1)).cast("int")).join(F.broadcast(model.select("bin", "llr")), "bin")


def left_out_counts(df: DataFrame, family: str, source: str, label: str, rank: str, bins: int) -> DataFrame:
    """Histogram counts of a family without each of its sources, by subtraction from the family's counts."""
    bin_ = F.least(F.floor(F.col(rank) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    own = df.groupBy(family, source, label, bin_).agg(F.count(F.lit(1)).alias("c"))
    total = own.groupBy(family, label, "bin").agg(F.sum("c").alias("t"))
    grid = df.select(family, source).distinct().join(total, family)
    return grid.join(own, [family, source, label, "bin"], "left").select(family, source, label, "bin", (F.col("t") - F.coalesce("c", F.lit(0))).alias("c"))


def combine_families(df: DataFrame, row: Sequence[str], families: int, positive: str = "pos", negative: str = "neg", supported: str = "supported") -> DataFrame:
    """Equal-weight means over jointly supported families; a row needs a strict majority of all families.

    score = (1 + positive - negative) / 2, 0 where unsupported.
    """
    ok = F.col(supported)
    out = df.groupBy(*row).agg(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("support"), F.avg(F.when(ok, F.col(positive))).alias("pos"), F.avg(F.when(ok, F.col(negative))).alias("neg"))
    enough = F.col("support") >= families // 2 + 1
    return out.withColumn("supported", enough).withColumn("score", F.when(enough, (1 + F.col("pos") - F.col("neg")) / 2).otherwise(F.lit(0.0))).drop("pos", "neg")


def fuse_pair(first: Column, second: Column, first_ok: Column, second_ok: Column, weight: float) -> Column:
    """weight * first + (1 - weight) * second where both hold, else the one that does, else null."""
    return F.when(first_ok & second_ok, weight * first + (1 - weight) * second).when(first_ok, first).when(second_ok, second)
