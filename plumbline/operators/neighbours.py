"""Exact nearest neighbours: a matrix product finds what may be near, direct differences in double precision decide; all pairs in blocks.

Queries and library rows are dealt to a grid of (query block, library block) cells of bounded size; a cell computes its distances
and keeps the least k of each query and class, and cells meet per query. Nothing is broadcast, no cell grows with the input, and a
hot key (for keyed search) is just more blocks. Within a class ties go to the smaller library id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES, ROWS = 2048, 16384


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and b, one by one, by direct differences: equal rows are at exactly 0."""
    return np.sqrt(((a - b) ** 2).sum(1))


def least(a: np.ndarray, b: np.ndarray, k: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b, of ties the first; apart: pairs that don't count.

    A matrix product gives all squared distances up to rounding. What may be among the k least within that rounding is measured by
    direct differences, which alone decide.
    """
    out = []
    square = (b**2).sum(1)
    for lo in range(0, len(a), step := max(1, (1 << 22) // max(1, len(b)))):
        some = a[lo : lo + step]
        own = (some**2).sum(1)
        near = own[:, None] + square - 2 * (some @ b.T)
        if apart is not None:
            near[apart[lo : lo + step]] = np.inf
        n = min(k, len(b))
        slack = 1e-12 * (a.shape[1] + 8) * (own + np.nan_to_num(square).max(initial=0.0)) + 1e-300
        x, y = np.nonzero((near <= np.partition(near, n - 1, axis=1)[:, n - 1 : n] + slack[:, None]) & np.isfinite(near))
        d = distances(some[x], b[y])
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        first = np.searchsorted(x, x)
        chosen = np.arange(len(x)) - first < n
        out.append((x[chosen] + lo, y[chosen], d[chosen]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _blocks(df: DataFrame, keys: Sequence[str], size: int, identity: str, name: str) -> tuple[DataFrame, DataFrame | int]:
    """df with a block number, so that a block of a key has about size rows; and the number of blocks of each key.

    Without keys the number is one count; with keys it is a table of a row a key.
    """
    if not keys:
        n = max(1, -(-df.count() // size))
        return df.withColumn(name, F.pmod(F.xxhash64(identity), F.lit(n)).cast("int")), n
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return df.join(n, list(keys)).withColumn(name, F.pmod(F.xxhash64(identity), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), n


def _spread(df: DataFrame, keys: Sequence[str], blocks, name: str) -> DataFrame:
    """df once for every block of the other side's key."""
    if not keys:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return df.join(blocks, list(keys)).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1))).drop(f"{name}s")


def nearest(queries: DataFrame, library: DataFrame, k: int = 1, keys: Sequence[str] = (), identity: str = "id", features: str = "f", label: str | None = "y", exclude_self: bool = False) -> DataFrame:
    """The k nearest library rows of each query, class and key: query_id, keys, y, library_id, d, nth."""
    keys = list(keys)
    kind = queries.select(*keys).union(library.select(*keys)).schema if keys else {}
    # Both sides' keys have one type: cogrouped rows are dealt by the hash of their own, and 1 as int isn't where 1 as long is.
    q = queries.select(F.col(identity).alias("query_id"), *[F.col(k).cast(kind[k].dataType).alias(k) for k in keys], F.col(features).alias("qf"))
    b = library.select(F.col(identity).alias("library_id"), *[F.col(k).cast(kind[k].dataType).alias(k) for k in keys], F.col(features).alias("bf"), (F.col(label) if label else F.lit(True)).alias("y"))
    (q, of_q), (b, of_b) = _blocks(q, keys, QUERIES, "query_id", "qb"), _blocks(b, keys, ROWS, "library_id", "bb")
    q, b = _spread(q, keys, of_b, "bb").select(*keys, "qb", "bb", "query_id", "qf"), _spread(b, keys, of_q, "qb").select(*keys, "qb", "bb", "library_id", "bf", "y")
    cell = [*keys, "qb", "bb"]
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *b.schema.fields]}

    def search(key, left, right):
        columns = ["query_id", *keys, "y", "library_id", "d"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        right = right.sort_values("library_id", kind="stable")
        a, out = np.stack(left["qf"]).astype(float), []
        for y, some in right.groupby("y"):
            ids = some["library_id"].to_numpy()
            apart = left["query_id"].to_numpy()[:, None] == ids[None] if exclude_self else None
            x, at, d = least(a, np.stack(some["bf"]).astype(float), k, apart)
            out.append(pd.DataFrame({"query_id": left["query_id"].to_numpy()[x], "y": y, "library_id": ids[at], "d": d}))
        out = pd.concat(out)
        for name, value in zip(keys, key):
            out[name] = value
        return out[columns]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["query_id", *keys, "y", "library_id"]) + ", d double"
    cells = q.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(search, schema)
    nth = F.row_number().over(Window.partitionBy("query_id", *keys, "y").orderBy("d", "library_id"))
    return cells.withColumn("nth", nth).filter(F.col("nth") <= k)


def class_margin(queries: DataFrame, library: DataFrame, identity: str = "id", features: str = "f", label: str = "y") -> DataFrame:
    """Nearest of each class: score = negative distance - positive distance; positive only above 0; the matched row is the nearer one's."""
    best = nearest(queries, library, 1, (), identity, features, label)
    wide = best.groupBy("query_id").agg(
        F.max(F.when(F.col("y"), F.col("d"))).alias("d_pos"), F.max(F.when(~F.col("y"), F.col("d"))).alias("d_neg"), F.max(F.when(F.col("y"), F.col("library_id"))).alias("id_pos"), F.max(F.when(~F.col("y"), F.col("library_id"))).alias("id_neg")
    )
    out = wide.withColumn("s", F.col("d_neg") - F.col("d_pos")).withColumn("p", F.col("s") > 0)
    return out.withColumn("matched_id", F.when(F.col("p"), F.col("id_pos")).otherwise(F.col("id_neg")))


def kth_distances(queries: DataFrame, library: DataFrame, ks: Sequence[int], keys: Sequence[str] = (), identity: str = "id", features: str = "f", exclude_self: bool = False, strict: bool = False) -> DataFrame:
    """query_id, keys, k, distance and supported for every query and k, from one search; unsupported ones have a null distance.

    strict: a key with fewer library rows than the largest k is an error that names it.
    """
    keys = list(keys)
    if strict and keys:
        have = library.groupBy(*keys).agg(F.count(F.lit(1)).alias("available"))
        short = queries.select(*keys).distinct().join(have, keys, "left").na.fill(0, ["available"]).filter(F.col("available") < max(ks) + int(exclude_self)).limit(1).collect()  # one row for the message
        if short:
            raise ValueError(f"{short[0].asDict()} has too few rows; {max(ks) + int(exclude_self)} are needed")
    found = nearest(queries, library, max(ks), keys, identity, features, None, exclude_self).select("query_id", *keys, F.col("nth").alias("k"), F.col("d").alias("distance"))
    grid = queries.select(F.col(identity).alias("query_id"), *keys).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return grid.join(found, ["query_id", *keys, "k"], "left").withColumn("supported", F.col("distance").isNotNull())
