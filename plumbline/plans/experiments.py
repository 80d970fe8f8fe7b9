"""Composite runs: library build and query, leave-one-family-out, calibrated tails, class-conditional and rank-likelihood models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import calibration, metrics, neighbours, ranks, scaling, selection


def library_match(features: DataFrame, is_library: Column, identity: str = "id", values: str = "f", label: str = "y") -> DataFrame:
    """The scaler is fitted on library rows alone; every other row is matched with them. Adds the query's label."""
    library, queries = features.filter(is_library), features.filter(~is_library)
    scaler = scaling.fit_scaler(library, values)
    b, q = (scaling.apply_scaler(x.select(identity, values, label), scaler, values) for x in (library, queries))
    out = neighbours.class_margin(q, b, identity, values, label)
    return out.join(queries.select(F.col(identity).alias("query_id"), label), "query_id")


def prior(df: DataFrame, is_library: Column, label: str = "y") -> DataFrame:
    """The library's share of positives as a constant score, and its decision."""
    return df.filter(is_library).agg(F.avg(F.col(label).cast("double")).alias("prior_score")).withColumn("prior_prediction", F.col("prior_score") > 0.5)


def family_folds(features: DataFrame, families: Sequence, family: str = "family", identity: str = "id", values: str = "f", label: str = "y") -> DataFrame:
    """Every family matched against a library of all others, its scaler fitted without it. One plan: a union over the folds."""
    out = None
    for f in families:
        fold = library_match(features, F.col(family) != F.lit(f), identity, values, label).withColumn("fold", F.lit(f))
        out = fold if out is None else out.unionByName(fold)
    return out


class TailCalibrator:
    """k-th neighbour distances to negatives of the same key, as tails of the negatives' own leave-one-out distances."""

    def __init__(self, train: DataFrame, key: str, block: str, ks: Sequence[int], identity: str = "id", values: str = "f", label: str = "y"):
        self.key, self.block, self.ks, self.identity, self.values = key, block, list(ks), identity, values
        self.negatives = train.filter(~F.col(label)).select(identity, key, block, values)
        own = neighbours.kth_distances(self.negatives, self.negatives, self.ks, [key], identity, values, exclude_self=True)
        self.reference = own.filter("supported").join(self.negatives.select(F.col(identity).alias("query_id"), block), "query_id").select(key, block, "k", "distance")

    def query(self, rows: DataFrame) -> DataFrame:
        """query_id, k, key, block, distance, mode, tail, anomaly, supported."""
        found = neighbours.kth_distances(rows, self.negatives, self.ks, [self.key], self.identity, self.values)
        found = found.join(rows.select(F.col(self.identity).alias("query_id"), self.block), "query_id").filter("supported")
        out = None
        for k in self.ks:
            one = calibration.shrunk_tail(self.reference.filter(F.col("k") == k), found.filter(F.col("k") == k), self.key, self.block, "distance", "query_id").withColumn("k", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out


def class_conditional(train: DataFrame, queries: DataFrame, families: Sequence, key: str, k: int, family: str = "family", identity: str = "id", values: str = "f", label: str = "y") -> DataFrame:
    """Tails to each family's positives and negatives of the same key, combined over jointly supported families.

    Families and classes are parts of one search key, so there is one join, not one for each.
    """
    fit = train.select(identity, key, F.col(family).alias("__fam"), F.col(label).alias("__cls"), values)
    own = neighbours.kth_distances(fit, fit, [k], [key, "__fam", "__cls"], identity, values, exclude_self=True).filter("supported")
    grid = F.array(*[F.struct(F.lit(f).alias("__fam"), F.lit(c).alias("__cls")) for f in families for c in (True, False)])
    q = queries.select(identity, key, values, F.explode(grid).alias("g")).select(identity, key, values, F.col("g.__fam").alias("__fam"), F.col("g.__cls").alias("__cls"))
    found = neighbours.kth_distances(q, fit, [k], [key, "__fam", "__cls"], identity, values)
    reference = own.select(key, "__fam", "__cls", "distance")
    tails = calibration.tail_probability(reference, found.filter("supported"), [key, "__fam", "__cls"], "distance", "query_id")
    tails = tails.withColumn("tail", F.when(F.col("n") > 0, F.col("tail")))
    wide = tails.groupBy("query_id", "__fam").agg(F.max(F.when(F.col("__cls"), F.col("tail"))).alias("pos"), F.max(F.when(~F.col("__cls"), F.col("tail"))).alias("neg"))
    wide = queries.select(F.col(identity).alias("query_id")).join(wide, "query_id", "left").withColumn("supported", F.col("pos").isNotNull() & F.col("neg").isNotNull())
    return calibration.combine_families(wide, ["query_id"], len(families))


def rank_likelihood(train: DataFrame, queries: DataFrame, family: str, label: str, rank: str, bins: int, beta: float, identity: str) -> DataFrame:
    """The bins' log ratios, then each query's strict ECDF among each family's scores, averaged over families: query id, llr, score."""
    model = calibration.likelihood_ratio(train, family, label, rank, bins, beta)
    reference = calibration.score_ranks(train, model, rank, bins).select(family, "llr")
    asked = calibration.score_ranks(queries.select(identity, rank), model, rank, bins).select(identity, "llr")
    every = asked.join(train.select(family).distinct(), F.lit(True))  # queries x families, a few
    ecdf = calibration.strict_ecdf(reference, every, [family], "llr", identity)
    return ecdf.groupBy(identity).agg(F.first("llr").alias("llr"), F.avg("ecdf").alias("score"))


def nested_selection(scores: DataFrame, candidates: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per outer family: each candidate's macro mean over the inner families, then the best candidate. scores: outer, inner, candidate, metrics."""
    names = ("f1", "average_precision", "balanced_accuracy", "precision", "recall")
    means = scores.filter(F.col(outer) != F.col(inner)).groupBy(outer, "candidate").agg(*[F.avg(n).alias(n) for n in names])
    return selection.select_candidate(means.join(candidates.select("candidate"), "candidate"), [outer])


def sealed(predictions: DataFrame, labels: DataFrame, path: str, keys: Sequence[str], label: str = "y") -> DataFrame:
    """Predictions are written, without labels, before any label is read; then joined with them from the written table."""
    if label in predictions.columns:
        raise ValueError("predictions must not hold the label")
    predictions.write.mode("errorifexists").parquet(path)
    return predictions.sparkSession.read.schema(predictions.schema).parquet(path).join(labels.select(*keys, label), list(keys))


def resume(spark, path: str, build) -> DataFrame:
    """The table at ``<path>/table`` if an earlier run completed it and its files are those of its manifest, else built, written and read."""
    from plumbline.sources.tables import file_manifest, verify_manifest

    jvm = spark._jvm.org.apache.hadoop.fs
    marker = jvm.Path(f"{path}/manifest/_SUCCESS")
    files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.exists(marker) and verify_manifest(file_manifest(spark, f"{path}/table", "*.parquet"), spark.read.parquet(f"{path}/manifest")).isEmpty()
    if not whole:
        files.delete(jvm.Path(f"{path}/manifest"), True)  # it must not vouch for what follows
        build().write.mode("overwrite").parquet(f"{path}/table")
        file_manifest(spark, f"{path}/table", "*.parquet").write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/table")


def fuse_centres(rows: DataFrame, keys: Sequence[str], weight: float, fraction: float, centre: str = "centre", block: str = "block", value: str = "s", valid: str = "valid") -> DataFrame:
    """Both blocks' scores at a centre, fused where both hold; the top fraction of all centres is selected."""
    from plumbline.operators.joins import pair_blocks

    wide = pair_blocks(rows, [*keys, centre], block, value, F.col(valid))
    fused = wide.withColumn("fused", calibration.fuse_pair(F.col("first"), F.col("second"), F.col("first_valid"), F.col("second_valid"), weight))
    return selection.top_fraction(fused, keys, "fused", centre, fraction, F.col("fused").isNotNull())


def evaluate(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of matched queries by group."""
    return metrics.metric_rows(matched, keys, "y", "p", "s")


__all__ = ["TailCalibrator", "class_conditional", "evaluate", "family_folds", "fuse_centres", "library_match", "nested_selection", "prior", "rank_likelihood", "ranks", "resume", "sealed"]
