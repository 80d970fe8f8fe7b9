"""Whole evaluation runs: library choice and fit, the split evaluation with its sink and levels, nested selection with sealed predictions,
calibrated tails of a key's own scale, block arms and direct diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import calibration, joins, metrics, neighbours, ranks, scaling, selection
from plumbline.operators.prefix import running
from plumbline.plans import experiments


def select_library(train: DataFrame, strata: Sequence[str], label: str, identity: str, most: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The balanced sample that forms the library, and one row with the prior: the share of positives among all training rows."""
    chosen = selection.balanced_sample(train, strata, label, identity, most, seed)
    return chosen, train.agg(F.avg(F.col(label).cast("double")).alias("prior_score")).withColumn("prior_prediction", F.col("prior_score") > 0.5)


def select_and_fit(train: DataFrame, strata: Sequence[str], label: str, identity: str, features: str, most: int, components: int, seed: int = 0):
    """Library, prior, its scaler, and the mean, rows and variances of its projection: the sample first, then the fit's two passes over it."""
    chosen, prior = select_library(train, strata, label, identity, most, seed)
    return chosen, prior, scaling.fit_scaler(chosen, features), scaling.fit_pca(chosen, components, features)


def match_method(rows: DataFrame, library: DataFrame, features: str, method: str, identity: str = "id", label: str = "y", about: Sequence[str] = ()) -> DataFrame:
    """A method's columns of the sink: decision, score, both distances, the nearer one, and identity, label and ``about`` of the matched row."""
    scaler = scaling.fit_scaler(library, features)
    b, q = (scaling.apply_scaler(x.select(identity, label, F.col(features).alias("f")), scaler, "f") for x in (library, rows))
    out = neighbours.class_margin(q, b, identity, "f", label)
    found = out.select("query_id", F.col("p").alias("prediction"), F.col("s").alias("score"), "d_pos", "d_neg", F.least("d_pos", "d_neg").alias("distance"), F.col("matched_id").alias("matched"))
    whose = library.select(F.col(identity).alias("matched"), F.col(label).alias("matched_label"), *[F.col(a).alias(f"matched_{a}") for a in about])
    found = found.join(whose, "matched", "left")
    return found.select(F.col("query_id").alias(identity), *[F.col(c).alias(f"{method}_{c}") for c in found.columns if c != "query_id"])


def match_rows(rows: DataFrame, library: DataFrame, prior: DataFrame, methods: dict[str, str], identity: str = "id", label: str = "y", keys: Sequence[str] = (), about: Sequence[str] = ()) -> DataFrame:
    """The sink: one row a query with identity, keys, label and prior, then a group of columns for each method (name to feature column)."""
    out = rows.select(identity, *keys, label).join(F.broadcast(prior), F.lit(True))  # one row
    for name, features in methods.items():
        out = out.join(match_method(rows, library, features, name, identity, label, about), identity, "left")
    return out


def level_rows(df: DataFrame, levels: dict[str, Sequence[str]], label: str = "y", prediction: str = "p", score: str = "s") -> DataFrame:
    """All metrics, AP and AUROC included, at several grouping levels: level, keys (null where a level lacks them), metrics.

    Rows are first counted by all keys, score, label and decision; only these counts go to every level.
    """
    keys = list(dict.fromkeys(k for own in levels.values() for k in own))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    base = df.groupBy(*keys, score, label, prediction).agg(F.count(F.lit(1)).alias("__c"))
    group = lambda name, own: F.struct(F.lit(name).alias("level"), *[(F.col(k) if k in own else F.lit(None).cast(kinds[k])).alias(k) for k in keys])
    spread = base.select(F.explode(F.array(*[group(n, own) for n, own in levels.items()])).alias("__g"), score, label, prediction, "__c")
    counts = metrics.decision_metrics(metrics.confusion(spread, ["__g"], label, prediction, "__c"))
    ranked = metrics.ranking(spread, ["__g"], label, score, "__c")
    return counts.join(ranked, "__g").select("__g.level", *[F.col(f"__g.{k}").alias(k) for k in keys], *[c for c in counts.columns if c != "__g"], "average_precision", "auroc")


def evaluate_split(features: DataFrame, is_library: Column, methods: dict[str, str], levels: dict[str, Sequence[str]], identity: str = "id", label: str = "y", about: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Library to match to metrics: the sink, and every method's metrics at every level."""
    library, rows = features.filter(is_library), features.filter(~is_library)
    keys = list(dict.fromkeys(k for own in levels.values() for k in own))
    sink = match_rows(rows, library, experiments.prior(features, is_library, label), methods, identity, label, keys, about)
    out = None
    for name in methods:
        one = level_rows(sink.select(*keys, label, F.col(f"{name}_prediction").alias("p"), F.col(f"{name}_score").alias("s")), levels, label).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return sink, out


def bootstrap_methods(sink: DataFrame, first: str, second: str, family: str, unit: str, replicates: int, place: Column, label: str = "y") -> DataFrame:
    """Paired bootstrap of the F1 of two methods over a family's units. place: a unit's number from (replicate, family, slot, n), below n."""
    score = lambda m: metrics.subset_f1(sink, [family, unit], F.lit(True), label, f"{m}_prediction").withColumnRenamed("subset_f1", m)
    units = score(first).join(score(second), [family, unit])
    units = running(units, [family], [F.col(unit)], {"pos": F.lit(1).cast("long")}).withColumn("pos", F.col("pos") - 1).withColumnRenamed("pos_all", "n")
    draws = units.groupBy(family).agg(F.max("n").alias("n")).join(units.sparkSession.range(replicates).select(F.col("id").alias("replicate")), F.lit(True))  # families x replicates
    draws = draws.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("replicate", family, place.cast("long").alias("pos"))
    return metrics.paired_bootstrap(units.drop("n"), draws, first, second, family)


def candidate_decisions(df: DataFrame, candidates: DataFrame, keys: Sequence[str], score: str, identity: str, eligible: Column | None = None) -> DataFrame:
    """df once for each candidate (candidate, rule, value: a bounded table) with its decision ``p``.

    Rules: ``top`` (the first ceil(value * rows) of the group by falling positive score, then identity), ``at_least`` and ``above`` a value.
    Rows are ranked once for all candidates. Ineligible rows are never chosen but count in the group's size.
    """
    ok = F.coalesce(eligible if eligible is not None else F.lit(True), F.lit(False))
    ranked = running(df.withColumn("__ok", ok), keys, [F.desc("__ok"), F.desc(score), F.col(identity)], {"__nth": F.lit(1).cast("long")})
    every = ranked.join(F.broadcast(candidates.select("candidate", "rule", F.col("value").cast("double").alias("__value"))), F.lit(True))
    s, v = F.col(score), F.col("__value")
    rule = F.when(F.col("rule") == "top", (s > 0) & (F.col("__nth") <= F.ceil(v * F.col("__nth_all")))).when(F.col("rule") == "at_least", s >= v).when(F.col("rule") == "above", s > v)
    return every.withColumn("p", F.coalesce(F.col("__ok") & rule, F.lit(False))).drop("__ok", "__nth", "__nth_all", "__value", "rule")


def rank_fit(family: str, label: str, rank: str, bins: int, beta: float, identity: str) -> Callable:
    """A fit of (train, queries) that scores queries by rank likelihood."""
    return lambda train, queries: experiments.rank_likelihood(train, queries, family, label, rank, bins, beta, identity).select(identity, "score")


def tail_fit(keys: Sequence[str], label: str, value: str, identity: str) -> Callable:
    """A fit of (train, queries) that scores queries by one less their tail among the training negatives of their key."""

    def fit(train, queries):
        tails = calibration.tail_probability(train.filter(~F.col(label)), queries, keys, value, identity)
        return tails.select(identity, (1 - F.col("tail")).alias("score"))

    return fit


def nested_run(df: DataFrame, family: str, families: Sequence, candidates: DataFrame, fit: Callable, path: str, keys: Sequence[str] = (), identity: str = "id", label: str = "y") -> tuple[DataFrame, DataFrame]:
    """Family-held-out selection with refit and sealed outer prediction: (outer, chosen candidate), and the outer metrics.

    For each outer family every other one is held out in turn: the fit without both scores the inner family, each candidate decides, and the best mean
    over inner families is chosen. The refit without the outer family then scores it; the decisions are written before any of its labels is read.
    """
    inner, outer = None, None
    for o in families:
        for i in [f for f in families if f != o]:
            queries = df.filter(F.col(family) == F.lit(i))
            one = fit(df.filter(~F.col(family).isin(o, i)), queries.drop(label)).withColumns({"outer": F.lit(o), "inner": F.lit(i)})
            inner = one if inner is None else inner.unionByName(one)
        one = fit(df.filter(F.col(family) != F.lit(o)), df.filter(F.col(family) == F.lit(o)).drop(label)).withColumn("outer", F.lit(o))
        outer = one if outer is None else outer.unionByName(one)
    own = df.select(identity, *keys)
    decided = candidate_decisions(inner.join(own, identity), candidates, ["outer", "inner", *keys], "score", identity).join(df.select(identity, label), identity)
    scores = metrics.metric_rows(decided, ["outer", "inner", "candidate"], label, "p", "score")
    chosen = experiments.nested_selection(scores, candidates, "outer", "inner")
    predictions = candidate_decisions(outer.join(own, identity), candidates, ["outer", *keys], "score", identity).join(chosen.select("outer", "candidate"), ["outer", "candidate"])
    opened = experiments.sealed(predictions, df, path, [identity], label)
    return chosen, metrics.metric_rows(opened, ["outer", "candidate"], label, "p", "score")


def scale_tail(negatives: DataFrame, queries: DataFrame, key: str, block: Column, value: str, identity: str, shrink: int = scaling.SHRINK) -> DataFrame:
    """Per key: values by the negatives' shrunk scaler, then the tail among the key's scaled negatives. A key without negatives has none."""
    model = scaling.fit_shrunk_scaler(negatives, key, block, value, shrink)
    z = lambda df: scaling.apply_keyed_scaler(df.join(model.select(key), key, "left_semi"), model, key, value)
    out = calibration.tail_probability(z(negatives), z(queries), [key], "z", identity)
    return queries.select(identity, key).join(out.select(identity, "z", "tail"), identity, "left").withColumn("supported", F.col("tail").isNotNull())


def block_arms(rows: DataFrame, keys: Sequence[str], fraction: float, centre: str = "centre", block: str = "block", value: str = "s", valid: str = "valid") -> DataFrame:
    """Each block alone: the top fraction of all centres by its own positive score, where it holds."""
    wide = joins.pair_blocks(rows, [*keys, centre], block, value, F.col(valid))
    for name in ("first", "second"):
        wide = selection.top_fraction(wide, keys, name, centre, fraction, F.col(f"{name}_valid"), name=f"{name}_selected")
    return wide.select(*keys, centre, "first_selected", "second_selected")


def direct_diagnostics(rows: DataFrame, keys: Sequence[str], fraction: float = 0.05, centre: str = "centre", block: str = "block", level: str = "level", step: str = "dx", value: str = "s") -> DataFrame:
    """Two scores without a model: the value of the block with the smaller step (the first on ties), and the mean of both blocks' midranks within
    (keys, block, level). The top fraction of centres is selected by each. Every centre must have one row in each block."""
    joins_ok = rows.groupBy(*keys, centre).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(block).alias("b")).filter("n <> 2 or b <> 2")
    if not joins_ok.isEmpty():
        raise ValueError("every centre needs exactly one row in each of two blocks")
    ranked = ranks.with_midrank(rows, [*keys, block, level], value, "__rank")
    side = lambda c, b: F.max(F.when(F.col(block) == b, F.col(c)))
    wide = ranked.groupBy(*keys, centre).agg(side(value, 0).alias("a"), side(value, 1).alias("b"), side(step, 0).alias("da"), side(step, 1).alias("db"), F.avg("__rank").alias("rank_mean"))
    wide = wide.select(*keys, centre, F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("least_step"), "rank_mean")
    for score in ("least_step", "rank_mean"):
        wide = selection.top_fraction(wide, keys, score, centre, fraction, positive=False, name=f"{score}_selected")
    return wide


def merge_scenes(first: DataFrame, second: DataFrame, keys: Sequence[str], shared: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row a centre from two blocks' scenes: shared columns must be equal in both, values come once for each block."""
    wrong = {k: v for k, v in joins.value_mismatches(first, second, keys, shared).first().asDict().items() if v}
    if wrong:
        raise ValueError(f"the scenes differ: {wrong}")
    side = lambda df, n: df.select(*keys, *[F.col(v).alias(f"{n}_{v}") for v in values])
    return joins.exact_join(first.select(*keys, *shared), joins.exact_join(side(first, "first"), side(second, "second"), keys), keys)


def display_rows(df: DataFrame, strata: Sequence[str], label: str, identity: str, features: Sequence[str], low: Sequence[float], high: Sequence[float], count: int = 120, seed: int = 0) -> DataFrame:
    """Up to count spread-out rows of each class and stratum, by maximin over features scaled to the unit box; with their order of choice."""
    scaled = df.select(*strata, label, identity, *[((F.col(c) - float(a)) / float(b - a)).alias(c) for c, a, b in zip(features, low, high)])
    return selection.farthest_sample(scaled, [*strata, label], identity, features, count, seed, random_ties=True)


__all__ = ["block_arms", "bootstrap_methods", "candidate_decisions", "direct_diagnostics", "display_rows", "evaluate_split", "level_rows", "match_rows", "merge_scenes", "nested_run", "rank_fit", "scale_tail", "select_and_fit", "select_library", "tail_fit"]
