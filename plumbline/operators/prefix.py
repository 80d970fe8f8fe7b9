"""Running sums, ranks and quantiles of groups of any size, in two levels.

Rows are dealt by range of (keys, order) and written, with the number of their partition. Each partition adds up its own part of a group; the parts' totals,
a row a partition and group, are added up along the partitions; both meet. So no task holds more than a
partition, however large a group is, and equal places in the order share a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.scratch import Scratch


def running(df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, str | Column]) -> DataFrame:
    """df with, for each name, the sum up to and with the row in its group's order, and ``<name>_all``, the group's."""
    keys, names = list(keys), list(sums)
    add = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    dealt = df.withColumns({f"__{n}": c for n, c in add.items()}).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    dealt = Scratch(df.sparkSession, "prefix").write(dealt, "dealt")
    along = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    whole = Window.partitionBy(*keys)
    parts = dealt.groupBy("__part", *keys).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names])
    parts = parts.select("__part", *keys, *[F.coalesce(F.sum(f"__{n}").over(along), F.lit(0)).alias(f"__{n}_before") for n in names], *[F.sum(f"__{n}").over(whole).alias(f"{n}_all") for n in names])
    parts = parts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__{n}_before" for n in names], *[f"{n}_all" for n in names])
    own = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({n: F.sum(f"__{n}").over(own) for n in names})
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = local.join(parts, on).withColumns({n: F.col(n) + F.col(f"__{n}_before") for n in names})
    return out.drop("__part", "__p", *[f"__k{i}" for i in range(len(keys))], *[f"__{n}" for n in names], *[f"__{n}_before" for n in names])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear quantiles of the values that aren't null, by name; a row a group, null without values.

    Values are counted first; the ones at the two ranks that a quantile lies between are found by running counts.
    """
    keys = list(keys)
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    seen = running(counted, keys, [F.col("__v")], {"__n": "__c"})
    first, n = F.col("__n") - F.col("__c"), F.col("__n_all")
    out = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (n - 1)
        at = lambda r: F.max(F.when((first <= r) & (r < F.col("__n")), F.col("__v")))
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    found = seen.groupBy(*keys).agg(*out)
    if not keys:
        return found
    same = [groups[k].eqNullSafe(found[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return groups.join(found, on, "left").select(*[groups[k] for k in keys], *probabilities)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """df with the row's number in its group's order and ``<name>_all``, the size of the group. The order must tell rows apart."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})
