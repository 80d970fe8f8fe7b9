"""Registered queries: every relational operator on the shared tables, with the SQL that must give the same rows.

Stand-ins: ``embeddings`` are feature vectors (label < 3 is positive, vec_id mod 5 = 0 a query, mod 4 a scale, mod 7 a family); ``events``
are scored rows (the rounded value a score with ties, an error positive, a user a group) and ordered paths; ``lineitem`` is a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import calibration, fields, joins, metrics, neighbours, predicates, ranks, scaling, selection
from plumbline.operators.prefix import ranked
from plumbline.plans import experiments
from plumbline.plans.catalog import query
from plumbline.plans.scratch import table
from plumbline.sources import tables

# Views of the stand-ins, for both engines.
E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label < 3 AS y, vec_id % 4 AS scale, (vec_id % 4) // 2 AS block, vec_id % 7 AS family, vec_id % 5 <> 0 AS lib FROM embeddings)"
V = "v AS (SELECT event_id AS id, user_id AS g, user_id % 10 AS family, event_type = 'error' AS y, round(value, 0) AS s, round(value, 0) >= 50 AS p, event_id % 3 <> 0 AS ok FROM events)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(i.alias("id"), F.col("embedding").alias("f"), (F.col("label") < 3).alias("y"), (i % 4).alias("scale"), F.floor((i % 4) / 2).alias("block"), (i % 7).alias("family"), (i % 5 != 0).alias("lib"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = F.round("value", 0)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("g"), (F.col("user_id") % 10).alias("family"), (F.col("event_type") == "error").alias("y"), s.alias("s"), (s >= 50).alias("p"), (F.col("event_id") % 3 != 0).alias("ok"))


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


DIST = "sqrt(list_sum(list_transform(list_zip(q.f, b.f), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"
MARGIN = f"""
{E}, mo AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM e WHERE lib) GROUP BY i),
sc AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN sd < 1e-12 THEN 1 ELSE sd END ORDER BY i) AS sd FROM mo),
z AS (SELECT id, y, lib, list_transform(list_zip(f, m, sd), lambda t: ((t[1] - t[2]) / t[3])::FLOAT::DOUBLE) AS f FROM e, sc),
d AS (SELECT q.id AS query_id, q.y, b.y AS cls, b.id AS bid, {DIST} AS d FROM z q, z b WHERE NOT q.lib AND b.lib),
k AS (SELECT query_id, any_value(y) AS y, min(d) FILTER (cls) AS d_pos, min(d) FILTER (NOT cls) AS d_neg, arg_min(bid, (d, bid)) FILTER (cls) AS id_pos, arg_min(bid, (d, bid)) FILTER (NOT cls) AS id_neg FROM d GROUP BY query_id),
m AS (SELECT query_id, y, d_pos, d_neg, d_neg - d_pos AS s, d_neg - d_pos > 0 AS p, CASE WHEN d_neg - d_pos > 0 THEN id_pos ELSE id_neg END AS matched_id FROM k)"""

METRICS = """round((tp + tn)::DOUBLE / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS "precision",
round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END, 6) AS balanced_accuracy"""
COUNTS = "count(*) AS n, count(*) FILTER (y) AS positives, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn"
RATES = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")


def ranking_sql(source: str, keys: str) -> str:
    on = f"PARTITION BY {keys}" if keys else ""
    group, pre = (f"GROUP BY {keys}", f"{keys}, ") if keys else ("", "")
    return f"""st AS (SELECT {pre}s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM {source} GROUP BY {pre}s),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({on}) AS p, sum(neg) OVER ({on}) AS q FROM st WINDOW w AS ({on} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
rk AS (SELECT {pre}round(CASE WHEN any_value(p) > 0 THEN sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(p) END, 6) AS average_precision,
round(CASE WHEN any_value(p) > 0 AND any_value(q) > 0 THEN sum(pos * (q - fp + neg * 0.5::DOUBLE)) / (any_value(p) * any_value(q))::DOUBLE END, 6) AS auroc FROM cu {group})"""


# Nearest neighbours (JN, SL1-4).


def _margin(spark, d):
    df = vectors(spark, d)
    return experiments.library_match(df, F.col("lib"))


@query("knn1_class_margin", f"WITH {MARGIN} SELECT query_id, y, p, matched_id, round(d_pos, 5) AS d_pos, round(d_neg, 5) AS d_neg FROM m")
def knn1_class_margin(spark, d):
    return _margin(spark, d).select("query_id", "y", "p", "matched_id", r("d_pos", 5), r("d_neg", 5))


@query("knn1_metrics", f"WITH {MARGIN}, {ranking_sql('m', '')}, c AS (SELECT {COUNTS} FROM m) SELECT n, positives, tp, fp, tn, fn, {METRICS}, average_precision, auroc FROM c, rk")
def knn1_metrics(spark, d):
    return metrics.metric_rows(_margin(spark, d), []).select("n", "positives", "tp", "fp", "tn", "fn", *[r(c) for c in (*RATES, "average_precision", "auroc")])


KNN = f"d AS (SELECT q.id AS query_id, q.scale, {DIST} AS d, b.id AS bid FROM e q JOIN e b ON "


@query("knn_k_same_key", f"WITH {E}, {KNN} q.scale = b.scale WHERE NOT q.lib AND b.lib AND NOT b.y), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, bid) AS k FROM d) SELECT query_id, scale, k, round(d, 6) AS distance, true AS supported FROM k WHERE k IN (1, 3, 5)")
def knn_k_same_key(spark, d):
    df = vectors(spark, d)
    return neighbours.kth_distances(df.filter("not lib"), df.filter("lib and not y"), [1, 3, 5], ["scale"], strict=True).select("query_id", "scale", F.col("k").cast("long").alias("k"), r("distance"), "supported")


@query("knn_leave_one_out", f"WITH {E}, {KNN} q.scale = b.scale AND q.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, bid) AS k FROM d) SELECT query_id, scale, k, round(d, 6) AS distance FROM k WHERE k = 5")
def knn_leave_one_out(spark, d):
    df = vectors(spark, d)
    return neighbours.kth_distances(df, df, [5], ["scale"], exclude_self=True).select("query_id", "scale", F.col("k").cast("long").alias("k"), r("distance"))


@query("knn_partial_support", f"WITH {E}, {KNN} q.scale = b.scale AND q.family = b.family WHERE NOT q.lib AND b.lib AND b.y), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, bid) AS k FROM d) SELECT id AS query_id, g.k::BIGINT AS k, round(k.d, 6) AS distance, k.d IS NOT NULL AS supported FROM (SELECT id, unnest([1, 2, 4]) AS k FROM e WHERE NOT lib) g LEFT JOIN k ON g.id = k.query_id AND g.k = k.k")
def knn_partial_support(spark, d):
    df = vectors(spark, d)
    return neighbours.kth_distances(df.filter("not lib"), df.filter("lib and y"), [1, 2, 4], ["scale", "family"]).select("query_id", F.col("k").cast("long").alias("k"), r("distance"), "supported")


@query("library_scaler", f"WITH {E} SELECT i - 1 AS i, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS scale FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM e WHERE lib) GROUP BY i")
def library_scaler(spark, d):
    s = scaling.fit_scaler(vectors(spark, d).filter("lib"))
    return s.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("i", "p")).select(F.col("i").cast("long").alias("i"), F.round("p.mean", 8).alias("mean"), F.round("p.scale", 8).alias("scale"))


@query("prior_method", f"WITH {E} SELECT round(avg(y::INT::DOUBLE), 8) AS prior_score, avg(y::INT::DOUBLE) > 0.5 AS prior_prediction FROM e WHERE lib")
def prior_method(spark, d):
    return experiments.prior(vectors(spark, d), F.col("lib")).select(r("prior_score", 8), "prior_prediction")


SHRUNK = """o AS (SELECT g, family, count(*) AS n, sum(s) AS s, sum(s * s) AS q FROM v GROUP BY ALL), b AS (SELECT family, sum(n) bn, sum(s) bs, sum(q) bq FROM o GROUP BY family), t AS (SELECT sum(n) tn, sum(s) ts, sum(q) tq FROM o),
j AS (SELECT *, greatest(q / n - (s / n) * (s / n), 0) AS lv, bn - n AS onn, bs - s AS os, bq - q AS oq, tn - bn AS en, ts - bs AS es, tq - bq AS eq FROM o JOIN b USING (family), t),
k AS (SELECT *, CASE WHEN onn > 0 THEN 1 WHEN en > 0 THEN 2 ELSE 3 END AS mode, CASE WHEN onn > 0 THEN greatest(oq / onn - (os / onn) * (os / onn), 0) WHEN en > 0 THEN greatest(eq / en - (es / en) * (es / en), 0) ELSE lv END AS pv FROM j)"""


@query("per_group_scaler", f"WITH {V}, {SHRUNK} SELECT g, family AS block, n, round(s / n, 6) AS mean, round(n / (n + 64.0::DOUBLE) * lv + (1 - n / (n + 64.0::DOUBLE)) * pv, 5) AS variance, mode FROM k")
def per_group_scaler(spark, d):
    return scaling.fit_shrunk_scaler(scored(spark, d), "g", F.col("family"), "s").select("g", "block", "n", r("mean"), r("variance", 5), "mode")


@query("per_group_standardised", f"WITH {V}, {SHRUNK}, w AS (SELECT g, s / n AS mean, sqrt(n / (n + 64.0::DOUBLE) * lv + (1 - n / (n + 64.0::DOUBLE)) * pv) AS sd FROM k) SELECT id, round(coalesce((v.s - mean) / sd, 0), 5) AS z FROM v LEFT JOIN w ON v.g = w.g AND v.g <> 3")
def per_group_standardised(spark, d):
    df = scored(spark, d)
    model = scaling.fit_shrunk_scaler(df, "g", F.col("family"), "s").filter("g <> 3")
    return scaling.apply_keyed_scaler(df, model, "g", "s").select("id", r("z", 5))


# Metrics (AG).


@query("metrics_grouped", f"WITH {V}, c AS (SELECT g, {COUNTS} FROM v GROUP BY g), {ranking_sql('v', 'g')} SELECT g, n, positives, tp, fp, tn, fn, {METRICS}, average_precision, auroc FROM c JOIN rk USING (g)")
def metrics_grouped(spark, d):
    return metrics.metric_rows(scored(spark, d), ["g"]).select("g", "n", "positives", "tp", "fp", "tn", "fn", *[r(c) for c in (*RATES, "average_precision", "auroc")])


@query("metrics_grouping_sets", f"WITH {V}, c AS (SELECT family, g, grouping(family, g) AS level, {COUNTS} FROM v GROUP BY GROUPING SETS ((family, g), (family), ())) SELECT family, g, level, n, positives, tp, fp, tn, fn, {METRICS} FROM c")
def metrics_grouping_sets(spark, d):
    return metrics.grouping_levels(scored(spark, d), [["family", "g"], ["family"], []]).select("family", "g", "level", "n", "positives", "tp", "fp", "tn", "fn", *[r(c) for c in RATES])


@query("average_precision_ties", f"WITH {V}, {ranking_sql('v', '')} SELECT average_precision FROM rk")
def average_precision_ties(spark, d):
    return metrics.ranking(scored(spark, d), []).select(r("average_precision"))


@query("auroc_ties", f"WITH {V}, {ranking_sql('v', 'family')} SELECT family, auroc FROM rk")
def auroc_ties(spark, d):
    return metrics.ranking(scored(spark, d), ["family"]).select("family", r("auroc"))


@query("metric_coverage", f"WITH {V}, a AS (SELECT g, count(*) AS assigned FROM v GROUP BY g), c AS (SELECT g, count(*) AS n FROM v WHERE ok AND g % 7 <> 0 GROUP BY g) SELECT g, assigned, coalesce(n, 0) AS valid, assigned - coalesce(n, 0) AS invalid, round(coalesce(n, 0)::DOUBLE / assigned, 6) AS coverage FROM a LEFT JOIN c USING (g)")
def metric_coverage(spark, d):
    df = scored(spark, d)
    rows = metrics.confusion(df.filter("ok and g % 7 <> 0"), ["g"])
    return metrics.with_coverage(rows, df.groupBy("g").agg(F.count(F.lit(1)).alias("assigned")), ["g"]).select("g", "assigned", "valid", "invalid", r("coverage"))


@query("subset_f1", f"WITH {V} SELECT g, round(CASE WHEN count(*) FILTER (ok) > 0 THEN CASE WHEN 2 * count(*) FILTER (ok AND y AND p) + count(*) FILTER (ok AND (y <> p)) > 0 THEN 2.0::DOUBLE * count(*) FILTER (ok AND y AND p) / (2 * count(*) FILTER (ok AND y AND p) + count(*) FILTER (ok AND (y <> p))) ELSE 0 END END, 6) AS subset_f1 FROM v GROUP BY g")
def subset_f1(spark, d):
    return metrics.subset_f1(scored(spark, d), ["g"], F.col("ok")).select("g", r("subset_f1"))


@query("threshold_sweep", f"WITH {V}, t AS (SELECT unnest([5, 20, 50, 100, 200])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (ok AND y AND s >= threshold) AS tp, count(*) FILTER (ok AND NOT y AND s >= threshold) AS fp, count(*) FILTER (y) AS positives FROM v, t GROUP BY threshold) SELECT *, round(2.0::DOUBLE * tp / (tp + fp + positives), 6) AS f1 FROM c")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(scored(spark, d), [5, 20, 50, 100, 200], eligible=F.col("ok")).select("threshold", "tp", "fp", "positives", r("f1"))


@query("macro_mean", f"WITH {V}, a AS (SELECT family, g, avg(s) AS v FROM v GROUP BY ALL), b AS (SELECT family, avg(v) AS v FROM a GROUP BY family) SELECT round(avg(v), 6) AS s FROM b")
def macro_mean(spark, d):
    units = scored(spark, d).groupBy("family", "g").agg(F.avg("s").alias("s"))
    return metrics.macro_mean(units, [["family", "g"], ["family"]], "s").select(r("s"))


@query("macro_mean_skipping", f"WITH {V}, a AS (SELECT family, g, CASE WHEN g % 4 <> 0 THEN avg(s) END AS v FROM v GROUP BY family, g), b AS (SELECT family, avg(v) AS v, count(v) = count(*) AS ful FROM a GROUP BY family) SELECT round(avg(v), 6) AS skipping, CASE WHEN min(ful::INT) = 1 THEN round(avg(v), 6) END AS strict FROM b")
def macro_mean_skipping(spark, d):
    units = scored(spark, d).groupBy("family", "g").agg(F.avg("s").alias("s")).withColumn("s", F.when(F.col("g") % 4 != 0, F.col("s")))
    loose = metrics.macro_mean(units, [["family", "g"], ["family"]], "s", strict=False).select(F.round("s", 6).alias("skipping"))
    return loose.join(metrics.macro_mean(units, [["family", "g"], ["family"]], "s").select(F.round("s", 6).alias("strict")), F.lit(True))


@query("coverage_counts", f"WITH {V} SELECT family, count(*) FILTER (ok AND p) AS both, count(*) FILTER (ok AND NOT p) AS first_only, count(*) FILTER (NOT ok AND p) AS second_only, count(*) FILTER (NOT ok AND NOT p) AS neither FROM v GROUP BY family")
def coverage_counts(spark, d):
    return metrics.coverage_counts(scored(spark, d), ["family"], F.col("ok"), F.col("p"))


@query("stratum_coverage_zero_rows", f"WITH {V}, st AS (SELECT f.family, b.bucket FROM (SELECT unnest(range(10)) AS family) f, (SELECT unnest(range(40)) AS bucket) b), c AS (SELECT family, floor(s / 10)::INT AS bucket, count(*) AS n, count(*) FILTER (y) AS positives FROM v GROUP BY ALL) SELECT family, bucket, coalesce(n, 0) AS n, coalesce(positives, 0) AS positives, coalesce(positives > 0 AND positives < n, false) AS two_class FROM st LEFT JOIN c USING (family, bucket)")
def stratum_coverage_zero_rows(spark, d):
    df = scored(spark, d).withColumn("bucket", F.floor(F.col("s") / 10))
    grid = spark.range(10).select(F.col("id").alias("family")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("bucket", F.col("bucket").cast("long"))
    return metrics.stratum_coverage(df, grid, ["family", "bucket"])


@query("query_audit", f"WITH {V} SELECT family, y, grouping(family, y) AS level, count(*) AS assigned, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM v GROUP BY GROUPING SETS ((family), (family, y))")
def query_audit(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return scored(spark, d).groupingSets([[F.col("family")], [F.col("family"), F.col("y")]], "family", "y").agg(F.grouping_id("family", "y").cast("long").alias("level"), F.count(F.lit(1)).alias("assigned"), n(F.col("ok")).alias("valid"), n(~F.col("ok")).alias("invalid"))


#: As many draws with replacement as the family has units, from a mixing of (replicate, family, slot).
MIX = "(((replicate * 1000003 + family * 7919 + slot * 104729 + 12345) * 48271 % 2147483647) * 69621 % 2147483647) * 16807 % 2147483647"
BOOT = f"u AS (SELECT family, g, row_number() OVER (PARTITION BY family ORDER BY g) - 1 AS pos, avg(s) AS a, avg(s) FILTER (ok) AS b FROM v GROUP BY family, g), n AS (SELECT family, count(*) AS n FROM u GROUP BY family), dr AS (SELECT replicate, family, {MIX} % n AS pos FROM n, range(200) r(replicate), LATERAL (SELECT unnest(range(n)) AS slot))"


@query("paired_bootstrap", f"WITH {V}, {BOOT}, x AS (SELECT family, pos, a - b AS d FROM u), bf AS (SELECT replicate, family, avg(d) AS d FROM dr JOIN x USING (family, pos) GROUP BY ALL), rp AS (SELECT replicate, avg(d) AS d FROM bf GROUP BY replicate), pt AS (SELECT avg(d) AS point FROM (SELECT family, avg(d) AS d FROM x GROUP BY family)) SELECT round(any_value(point), 6) AS point, round(quantile_cont(d, 0.025), 6) AS ci_lower, round(quantile_cont(d, 0.975), 6) AS ci_upper, count(d) AS replicates FROM rp, pt")
def paired_bootstrap(spark, d):
    units, draws = bootstrap_draws(spark, d)
    return metrics.paired_bootstrap(units, draws, "a", "b").select(r("point"), r("ci_lower"), r("ci_upper"), "replicates")


def bootstrap_draws(spark, d):
    """Every unit with its place in its family, and for each replicate as many places as the family has."""
    units = scored(spark, d).groupBy("family", "g").agg(F.avg("s").alias("a"), F.avg(F.when(F.col("ok"), F.col("s"))).alias("b"))
    units = ranked(units, ["family"], [F.col("g")], "pos").drop("pos_all").withColumn("pos", F.col("pos") - 1)
    sizes = units.groupBy("family").agg(F.count(F.lit(1)).alias("n"))  # a row a family
    draws = spark.range(200).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(sizes))
    draws = draws.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return units, draws.select("replicate", "family", F.expr(f"cast({MIX} % n AS int)").alias("pos"))


@query("counterexamples", f"WITH {V}, m AS (SELECT g, avg(s) FILTER (y) AS ours, avg(s) FILTER (NOT y) AS theirs FROM v GROUP BY g) SELECT g, round(ours, 6) AS ours, round(theirs, 6) AS theirs, round(ours - theirs, 6) AS difference FROM m WHERE ours - theirs <= 0")
def counterexamples(spark, d):
    rows = scored(spark, d).groupBy("g", F.when(F.col("y"), "ours").otherwise("theirs").alias("method")).agg(F.avg("s").alias("value"))
    return metrics.counterexamples(rows, ["g"], "method", "value", "ours", "theirs").select("g", r("ours"), r("theirs"), r("difference"))


@query("success_rule", f"WITH {V}, u AS (SELECT family, avg(p::INT::DOUBLE) AS x FROM v GROUP BY family) SELECT count(*) FILTER (x >= 0.36) AS reached, round(avg(x), 6) AS mean, count(*) FILTER (x >= 0.36) >= 4 AND avg(x) >= 0.3 AS success FROM u")
def success_rule(spark, d):
    rows = scored(spark, d).groupBy("family").agg(F.avg(F.col("p").cast("int").cast("double")).alias("x"))
    return metrics.success_rule(rows, "x", 0.36, 4, 0.3).select("reached", r("mean"), "success")


@query("stop_certificate", f"WITH {V}, u AS (SELECT family, avg(p::INT::DOUBLE) AS x FROM v WHERE family < 7 GROUP BY family) SELECT count(x) AS done, round((sum(x) + 10 - count(x)) / 10.0::DOUBLE, 6) AS upper_bound, (sum(x) + 10 - count(x)) / 10.0::DOUBLE < 0.6 AS stop FROM u")
def stop_certificate(spark, d):
    rows = scored(spark, d).filter("family < 7").groupBy("family").agg(F.avg(F.col("p").cast("int").cast("double")).alias("x"))
    return metrics.stop_certificate(rows, "x", 10, 0.6).select("done", r("upper_bound"), "stop")


@query("quantile_summary", f"WITH {V} SELECT family, round(quantile_cont(s, 0.05), 6) AS q50, round(quantile_cont(s, 0.5), 6) AS q500, round(quantile_cont(s, 0.95), 6) AS q950 FROM v GROUP BY family")
def quantile_summary(spark, d):
    return metrics.quantile(scored(spark, d), ["family"], "s", [0.05, 0.5, 0.95]).select("family", r("q50"), r("q500"), r("q950"))


# Ranks and smoothing (WN).


@query("percentile_rank", f"WITH {V} SELECT id, round(row_number() OVER (PARTITION BY g ORDER BY s, id)::DOUBLE / count(*) OVER (PARTITION BY g), 9) AS rank FROM v")
def percentile_rank(spark, d):
    return ranks.with_percentile_rank(scored(spark, d), ["g"], "s", "id").select("id", r("rank", 9))


@query("supported_rank", f"WITH {V} SELECT id, round(CASE WHEN ok THEN row_number() OVER (PARTITION BY g, ok ORDER BY s, id)::DOUBLE / count(*) OVER (PARTITION BY g, ok) ELSE 0 END, 9) AS rank FROM v")
def supported_rank(spark, d):
    return ranks.with_percentile_rank(scored(spark, d), ["g"], "s", "id", supported=F.col("ok")).select("id", r("rank", 9))


@query("midrank", f"WITH {V} SELECT id, round((rank() OVER (PARTITION BY family, y ORDER BY s) + (count(*) OVER (PARTITION BY family, y, s) - 1) * 0.5::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY family, y), 9) AS rank FROM v")
def midrank(spark, d):
    return ranks.with_midrank(scored(spark, d), ["family", "y"], "s").select("id", r("rank", 9))


@query("running_sum", f"WITH {V} SELECT id, sum(s) OVER (PARTITION BY g ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM v")
def running_sum(spark, d):
    return ranks.with_running_sum(scored(spark, d), ["g"], "s", [F.desc("s"), F.col("id")]).select("id", "total")


GRID = "c AS (SELECT (l_quantity - 1)::INT AS x, l_linenumber - 1 AS z, avg(l_extendedprice) AS s FROM lineitem GROUP BY ALL), cells AS (SELECT x, z, s, (x * 7 + z * 3) % 5 <> 0 AS ok FROM c)"


def _cells(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_quantity") - 1).cast("int").alias("x"), (F.col("l_linenumber") - 1).alias("z")).agg(F.avg("l_extendedprice").alias("s"))
    return g.withColumn("ok", (F.col("x") * 7 + F.col("z") * 3) % 5 != 0)


KERNEL = "k AS (SELECT o, exp(-0.5::DOUBLE * (o / 1.5::DOUBLE) * (o / 1.5::DOUBLE)) / sum(exp(-0.5::DOUBLE * (o / 1.5::DOUBLE) * (o / 1.5::DOUBLE))) OVER () AS w FROM range(-5, 6) r(o))"


@query("masked_gaussian", f"WITH {GRID}, {KERNEL} SELECT x + a.o AS x, z + b.o AS z, round(sum(s * a.w * b.w) / sum(a.w * b.w), 4) AS smooth FROM cells, k a, k b WHERE ok AND x + a.o BETWEEN 0 AND 49 AND z + b.o BETWEEN 0 AND 6 GROUP BY ALL")
def masked_gaussian(spark, d):
    return ranks.masked_gaussian(_cells(spark, d), [], {"x": 50, "z": 7}, "s", F.col("ok"), 1.5).select(F.col("x").cast("long").alias("x"), F.col("z").cast("long").alias("z"), r("smooth", 4))


@query("smoothing_states", f"WITH {GRID}, {KERNEL}, m AS (SELECT x + a.o AS x, z + b.o AS z, sum(s * a.w * b.w) / sum(a.w * b.w) AS smooth FROM cells, k a, k b WHERE ok AND x < 20 AND x + a.o BETWEEN 0 AND 49 AND z + b.o BETWEEN 0 AND 6 GROUP BY ALL) SELECT cells.x, cells.z, round(coalesce(smooth, 0), 4) AS smooth, CASE WHEN ok AND cells.x < 20 THEN 'supported' WHEN smooth IS NOT NULL THEN 'imputed' ELSE 'unimputable' END AS state FROM cells LEFT JOIN m ON cells.x = m.x AND cells.z = m.z")
def smoothing_states(spark, d):
    return ranks.smoothing_states(_cells(spark, d), [], {"x": 50, "z": 7}, "s", F.col("ok") & (F.col("x") < 20), 1.5).select("x", "z", r("smooth", 4), "state")


# Selection (TK).


@query("top_fraction", f"WITH {V}, m AS (SELECT id, ok AND s > 0 AS e, ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY g)) AS n, row_number() OVER (PARTITION BY g, ok AND s > 0 ORDER BY s DESC, id) AS k FROM v) SELECT id, e AND k <= n AS selected FROM m")
def top_fraction(spark, d):
    return selection.top_fraction(scored(spark, d), ["g"], "s", "id", 0.1, F.col("ok")).select("id", "selected")


@query("top_fraction_at_least_one", f"WITH {V}, m AS (SELECT id, greatest(1, ceil(0.001::DOUBLE * count(*) OVER (PARTITION BY g))) AS n, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS k FROM v) SELECT id, k <= n AS selected FROM m")
def top_fraction_at_least_one(spark, d):
    return selection.top_fraction(scored(spark, d), ["g"], "s", "id", 0.001, positive=False, at_least_one=True).select("id", "selected")


@query("prevalence_top_fraction", f"WITH {V}, pr AS (SELECT family, avg(y::INT::DOUBLE) AS a FROM v GROUP BY family), o AS (SELECT p.family, avg(q.a) AS share FROM pr p JOIN pr q ON p.family <> q.family GROUP BY p.family), m AS (SELECT id, ceil(share * count(*) OVER (PARTITION BY v.family)) AS n, row_number() OVER (PARTITION BY v.family ORDER BY s DESC, id) AS k FROM v JOIN o ON v.family = o.family) SELECT id, k <= n AS selected FROM m")
def prevalence_top_fraction(spark, d):
    df = scored(spark, d)
    p = df.groupBy("family").agg(F.avg(F.col("y").cast("int").cast("double")).alias("a"))  # a row a family
    total = p.agg(F.sum("a").alias("t"), F.count("a").alias("c"))
    share = p.join(total, F.lit(True)).select("family", ((F.col("t") - F.col("a")) / (F.col("c") - 1)).alias("share"))
    return selection.top_fraction(df.join(share, "family"), ["family"], "s", "id", F.col("share"), positive=False).select("id", "selected")


@query("threshold_rules", f"WITH {V} SELECT id, ok AND s >= 50 AS inclusive, ok AND s > 50 AS strict FROM v")
def threshold_rules(spark, d):
    return scored(spark, d).select("id", selection.threshold("s", 50, F.col("ok")).alias("inclusive"), selection.threshold("s", 50, F.col("ok"), True).alias("strict"))


TWO = """a AS (SELECT g, s AS v, count(*) AS c FROM v WHERE ok GROUP BY ALL), b AS (SELECT g, v, c, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS x FROM a WINDOW w AS (PARTITION BY g)),
d AS (SELECT g, v, sum(c) OVER u AS n1, sum(c * x) OVER u AS s1, sum(c * x * x) OVER u AS q1, sum(c) OVER w AS n, sum(c * x) OVER w AS s, sum(c * x * x) OVER w AS q FROM b WINDOW u AS (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY g)),
cut AS (SELECT g, arg_min(v, (round(q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1), 12), v)) AS cut FROM d WHERE n > n1 AND s IS NOT NULL GROUP BY g)"""


@query("two_means", f"WITH {V}, {TWO} SELECT id, coalesce(ok AND s > cut, false) AS high FROM v LEFT JOIN cut USING (g)")
def two_means(spark, d):
    return selection.two_means(scored(spark, d), ["g"], "s", F.col("ok")).select("id", "high")


F1 = "a AS (SELECT family, s AS cut, count(*) FILTER (y) AS pos, count(*) AS c FROM v GROUP BY ALL), b AS (SELECT family, cut, sum(pos) OVER u AS tp, sum(c) OVER u AS k, sum(pos) OVER (PARTITION BY family) AS p FROM a WINDOW u AS (PARTITION BY family ORDER BY cut DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, round(2.0::DOUBLE * tp / (k + p), 12) AS f1, round(tp::DOUBLE / k, 12) AS pr FROM b)"


@query("oracle_max_f1", f"WITH {V}, {F1} SELECT family, arg_max(cut, (f1, cut)) AS threshold, round(max(f1), 6) AS best_f1 FROM f GROUP BY family")
def oracle_max_f1(spark, d):
    return selection.best_f1_threshold(scored(spark, d), ["family"], "y", "s").select("family", "threshold", r("best_f1"))


@query("best_f1_by_precision", f"WITH {V}, {F1} SELECT family, arg_max(cut, (f1, pr, cut)) AS threshold, round(max(f1), 6) AS best_f1 FROM f GROUP BY family")
def best_f1_by_precision(spark, d):
    return selection.best_f1_threshold(scored(spark, d), ["family"], "y", "s", True).select("family", "threshold", r("best_f1"))


@query("candidate_select", f"WITH {V}, c AS (SELECT family, t::BIGINT AS candidate, count(*) FILTER (y AND s >= t * 10) AS tp, count(*) FILTER (s >= t * 10) AS k, count(*) FILTER (y) AS p FROM v, range(1, 11) r(t) GROUP BY ALL), m AS (SELECT family, candidate, round(2.0::DOUBLE * tp / (k + p), 9) AS f1 FROM c) SELECT family, arg_min(candidate, (-f1, candidate)) AS candidate, round(max(f1), 6) AS f1 FROM m GROUP BY family")
def candidate_select(spark, d):
    hits = scored(spark, d).withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("h", F.col("s") >= F.col("candidate") * 10)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    m = hits.groupBy("family", F.col("candidate").cast("long").alias("candidate")).agg(n(F.col("y") & F.col("h")).alias("tp"), n(F.col("h")).alias("k"), n(F.col("y")).alias("pos"))
    m = m.select("family", "candidate", F.round(2 * F.col("tp") / (F.col("k") + F.col("pos")), 9).alias("f1"), *[F.lit(None).cast("double").alias(c) for c in ("average_precision", "balanced_accuracy", "precision", "recall")])
    return selection.select_candidate(m, ["family"]).select("family", "candidate", r("f1"))


@query("candidate_grid", "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS candidate, a::VARCHAR AS k, b::VARCHAR AS sigma, ['rank', 'tail'][c] AS rule FROM (SELECT unnest([1, 3, 5]) AS a), (SELECT unnest([0, 1, 2, 4]) AS b), (SELECT unnest([1, 2]) AS c)")
def candidate_grid(spark, d):
    return selection.candidate_grid(spark, k=[1, 3, 5], sigma=[0, 1, 2, 4], rule=["rank", "tail"])


@query("balanced_sample", f"WITH {V}, c AS (SELECT g, least(5, count(*) FILTER (y), count(*) FILTER (NOT y)) AS take FROM v GROUP BY g), n AS (SELECT v.*, row_number() OVER (PARTITION BY g, y ORDER BY md5('7:' || id), id) AS nth FROM v) SELECT id, g, y FROM n JOIN c USING (g) WHERE nth <= take")
def balanced_sample(spark, d):
    return selection.balanced_sample(scored(spark, d), ["g"], "y", "id", 5, 7).select("id", "g", "y")


@query("balanced_assignment", f"WITH {V} SELECT id, ((row_number() OVER (PARTITION BY g ORDER BY md5('3:' || id), id) - 1) % 7)::INT AS scale FROM v")
def balanced_assignment(spark, d):
    return fields.balanced_assignment(scored(spark, d), "id", 7, 3, ["g"]).select("id", "scale")


# Predicates (PR).


@query("percentile_mask", "SELECT l_orderkey, l_linenumber, l_extendedprice >= quantile_cont(l_extendedprice, 0.95) OVER (PARTITION BY l_returnflag) AS mask FROM lineitem")
def percentile_mask(spark, d):
    return predicates.percentile_mask(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_orderkey", "l_linenumber", "mask")


@query("complete_only", f"WITH {V}, k AS (SELECT g, floor(id / 500) AS b FROM v GROUP BY ALL HAVING bool_and(s < 250) AND count(*) = 4) SELECT id FROM v JOIN k ON v.g = k.g AND floor(v.id / 500) = k.b")
def complete_only(spark, d):
    df = scored(spark, d).withColumn("b", F.floor(F.col("id") / 500))
    return predicates.complete_only(df, ["g", "b"], F.col("s") < 250, 4).select("id")


@query("scale_digits", "SELECT l_orderkey % 2000 AS scale, ((l_orderkey % 1000) // 100)::INT AS dx, ((l_orderkey % 1000) // 10 % 10)::INT AS ds, (l_orderkey % 10)::INT AS arc, l_linenumber FROM lineitem")
def scale_digits(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("scale"), *predicates.scale_digits(F.col("l_orderkey") % 2000), "l_linenumber")


@query("feature_subset", f"WITH {E} SELECT id, round(f[2], 6) AS a, round(f[5], 6) AS b, round(f[64], 6) AS c FROM e")
def feature_subset(spark, d):
    picked = predicates.pick(F.col("f"), [1, 4, 63])
    return vectors(spark, d).select("id", *[F.round(F.get(picked, F.lit(i)).cast("double"), 6).alias(n) for i, n in enumerate("abc")])


@query("family_filter_roles", f"WITH {V} SELECT id, CASE WHEN y THEN 'test' WHEN g < 2 THEN 'library' ELSE 'tuning' END AS role FROM v WHERE family <> 4")
def family_filter_roles(spark, d):
    df = predicates.held_out(scored(spark, d), "family", 4)
    return df.select("id", predicates.role(F.when(F.col("y"), "confirmation").otherwise("development"), F.col("g")).alias("role"))


@query("confusion_partition", f"WITH {V} SELECT id, CASE WHEN y AND p THEN 'tp' WHEN p THEN 'fp' WHEN y THEN 'fn' ELSE 'tn' END AS part FROM v")
def confusion_partition(spark, d):
    return scored(spark, d).select("id", predicates.confusion_class("y", "p").alias("part"))


@query("validated_features", f"WITH {E} SELECT count(*) AS rows, sum(len(f)) AS numbers FROM e")
def validated_features(spark, d):
    df = predicates.checked(vectors(spark, d), predicates.finite_features("f", 64) & predicates.binary_label("y"), "features must be 64 finite numbers")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("f")).alias("numbers"))


@query("centred_time", "SELECT event_id AS id, round(value - first(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value FROM events")
def centred_time(spark, d):
    df = table(spark, d, "events")
    return df.select(F.col("event_id").alias("id"), *predicates.centred(["user_id"], ["value"], "ts", "event_id")).select("id", r("value"))


# Joins (JN10-21).


@query("identity_join_check", "SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS matched, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS left_only, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS right_only, 0 AS repeated")
def identity_join_check(spark, d):
    return joins.key_differences(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("exact_group_join", "SELECT o_orderkey AS id, o_orderstatus, round(o_totalprice, 2) AS price FROM orders")
def exact_group_join(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return joins.exact_join(o.select("id", "o_orderstatus"), o.select("id", "o_totalprice"), ["id"]).select("id", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


@query("value_mismatches", "SELECT count(*) FILTER (quality IS DISTINCT FROM toxic) AS quality, 0 AS doc FROM labels")
def value_mismatches(spark, d):
    a = table(spark, d, "labels").select("doc_id", "quality", F.col("doc_id").alias("doc"))
    b = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("quality"), F.col("doc_id").alias("doc"))
    return joins.value_mismatches(a, b, ["doc_id"], ["quality", "doc"])


PAIRS = "b AS (SELECT g, id // 40 AS centre, id // 20 % 2 AS block, max(s) AS s, bool_or(ok) AS valid FROM v GROUP BY ALL), w AS (SELECT g, centre, max(s) FILTER (block = 0) AS first, max(s) FILTER (block = 1) AS second, coalesce(bool_or(valid) FILTER (block = 0), false) AS first_valid, coalesce(bool_or(valid) FILTER (block = 1), false) AS second_valid FROM b GROUP BY ALL)"


def _pairs(spark, d):
    rows = scored(spark, d).groupBy("g", F.floor(F.col("id") / 40).alias("centre"), (F.floor(F.col("id") / 20) % 2).alias("block")).agg(F.max("s").alias("s"), F.bool_or("ok").alias("valid"))
    return rows


@query("block_pairing", f"WITH {V}, {PAIRS} SELECT * FROM w")
def block_pairing(spark, d):
    return joins.pair_blocks(_pairs(spark, d), ["g", "centre"], "block", "s", F.col("valid"))


@query("paired_fusion", f"WITH {V}, {PAIRS}, f AS (SELECT *, CASE WHEN first_valid AND second_valid THEN 0.75::DOUBLE * first + 0.25::DOUBLE * second WHEN first_valid THEN first WHEN second_valid THEN second END AS fused FROM w), m AS (SELECT *, fused IS NOT NULL AND fused > 0 AS e FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY g, e ORDER BY fused DESC, centre) AS k, ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY g)) AS c FROM m) SELECT g, centre, round(fused, 6) AS fused, e AND k <= c AS selected FROM n")
def paired_fusion(spark, d):
    return experiments.fuse_centres(_pairs(spark, d), ["g"], 0.75, 0.2).select("g", "centre", r("fused"), "selected")


@query("project_back", f"WITH {V}, c AS (SELECT g, max(s) AS top FROM v WHERE ok GROUP BY g) SELECT id, top FROM v LEFT JOIN c USING (g)")
def project_back(spark, d):
    df = scored(spark, d)
    return joins.project_back(df, df.filter("ok").groupBy("g").agg(F.max("s").alias("top")), ["g"], ["top"]).select("id", "top")


ARC = """e AS (SELECT user_id AS g, ts, event_id, epoch(ts) / 3600.0::DOUBLE AS h, value AS v FROM events),
l AS (SELECT *, lag(h) OVER w AS h0, lag(v) OVER w AS v0 FROM e WINDOW w AS (PARTITION BY g ORDER BY ts, event_id)),
d AS (SELECT *, sqrt((h - h0) * (h - h0) + (v - v0) * (v - v0)) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hi FROM d),
s AS (SELECT *, hi - n AS lo, max(hi) OVER (PARTITION BY g) AS total FROM c WHERE n > 0),
t AS (SELECT s.*, k AS sample, total / 31.0::DOUBLE * k AS target FROM s, range(32) r(k)),
p AS (SELECT g, sample, target, arg_min(struct_pack(h0, h, v0, v, lo, n), (hi, ts, event_id)) AS x FROM t WHERE hi >= target OR (sample = 31 AND hi >= total) GROUP BY ALL)"""


@query("arc_length_resample", f"WITH {ARC} SELECT g, sample::INT AS sample, round(x.h0 + least(1, greatest(0, (target - x.lo) / x.n)) * (x.h - x.h0), 3) AS h, round(x.v0 + least(1, greatest(0, (target - x.lo) / x.n)) * (x.v - x.v0), 3) AS v FROM p")
def arc_length_resample(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("g"), "ts", "event_id", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6 / 3600.0).alias("h"), F.col("value").alias("v"))
    return joins.arc_targets(e, "g", ["ts", "event_id"], ["h", "v"], 32).select("g", "sample", r("h", 3), r("v", 3))


# Calibration (AG23-31, MD4-9).

TAIL = "re AS (SELECT family, s FROM v WHERE NOT y), qq AS (SELECT id, family, s FROM v WHERE y), t AS (SELECT qq.id, qq.family, count(*) FILTER (re.s >= qq.s) AS ge, count(*) FILTER (re.s < qq.s) AS lt, count(*) AS n FROM qq JOIN re ON qq.family = re.family GROUP BY ALL)"


@query("tail_probability", f"WITH {V}, {TAIL} SELECT id, round((ge + 1)::DOUBLE / (n + 1), 9) AS tail FROM t")
def tail_probability(spark, d):
    df = scored(spark, d)
    return calibration.tail_probability(df.filter("not y"), df.filter("y"), ["family"], "s", "id").select("id", r("tail", 9))


@query("strict_ecdf", f"WITH {V}, {TAIL} SELECT id, round(lt::DOUBLE / (n + 1), 9) AS ecdf FROM t")
def strict_ecdf(spark, d):
    df = scored(spark, d)
    return calibration.strict_ecdf(df.filter("not y"), df.filter("y"), ["family"], "s", "id").select("id", r("ecdf", 9))


@query("difference_tail", f"WITH {V}, {TAIL} SELECT qq.id, round((count(*) FILTER (x.s >= qq.s) + 1)::DOUBLE / (count(*) + 1), 9) AS tail FROM qq JOIN (SELECT family, s FROM v WHERE NOT y AND ok) x ON qq.family = x.family GROUP BY qq.id")
def difference_tail(spark, d):
    df = scored(spark, d)
    return calibration.difference_tail(df.filter("not y"), df.filter("not y and not ok"), df.filter("y"), ["family"], "s", "id").select("id", r("tail", 9))


@query("tail_shrinkage_modes", f"""WITH {V}, re AS (SELECT g, family, s FROM v WHERE NOT y AND g % 9 <> 0 AND family <> 3), qq AS (SELECT id, g, family, s FROM v WHERE y),
t AS (SELECT qq.id, qq.g, qq.family, count(*) FILTER (re.g = qq.g) AS n, count(*) FILTER (re.g = qq.g AND re.s >= qq.s) AS ge, count(*) FILTER (re.family = qq.family) AS bn, count(*) FILTER (re.family = qq.family AND re.s >= qq.s) AS bg, count(*) AS tn, count(*) FILTER (re.s >= qq.s) AS tg FROM qq, re GROUP BY ALL),
m AS (SELECT *, bn - n AS onn, tn - bn AS en, CASE WHEN n > 0 AND bn > n THEN 1 WHEN n > 0 AND tn > bn THEN 2 WHEN n > 0 THEN 3 WHEN bn > n THEN 4 WHEN tn > bn THEN 5 ELSE 0 END AS mode, (ge + 1)::DOUBLE / (n + 1) AS l, (bg - ge + 1)::DOUBLE / (bn - n + 1) AS near, (tg - bg + 1)::DOUBLE / (tn - bn + 1) AS far, n / (n + 64.0::DOUBLE) AS w FROM t)
SELECT id, mode, round(CASE mode WHEN 1 THEN w * l + (1 - w) * near WHEN 2 THEN w * l + (1 - w) * far WHEN 3 THEN l WHEN 4 THEN near WHEN 5 THEN far END, 9) AS tail FROM m""")
def tail_shrinkage_modes(spark, d):
    df = scored(spark, d)
    return calibration.shrunk_tail(df.filter("not y and g % 9 <> 0 and family <> 3"), df.filter("y"), "g", "family", "s", "id").select("id", "mode", r("tail", 9))


RANKED = "rr AS (SELECT id, family, g, y, (rank() OVER (PARTITION BY family ORDER BY s) + (count(*) OVER (PARTITION BY family, s) - 1) * 0.5::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY family) AS rk FROM v), bb AS (SELECT *, least(floor(rk * 8), 7)::INT AS bin FROM rr)"
HIST = "hh AS (SELECT n.family, n.y, bin, (coalesce(c, 0) + 0.5::DOUBLE) / (n + 4.0::DOUBLE) AS mass FROM (SELECT family, y, count(*) AS n, unnest(range(8))::INT AS bin FROM bb GROUP BY family, y) n LEFT JOIN (SELECT family, y, bin, count(*) AS c FROM bb GROUP BY ALL) c USING (family, y, bin))"


def _ranked(spark, d):
    return ranks.with_midrank(scored(spark, d), ["family"], "s", "rk")


@query("class_histogram", f"WITH {V}, {RANKED}, {HIST} SELECT family, y, bin, round(mass, 9) AS mass FROM hh")
def class_histogram(spark, d):
    return calibration.histogram(_ranked(spark, d), ["family", "y"], "rk", 8, 0.5).select("family", "y", "bin", r("mass", 9))


LLR = "aa AS (SELECT y, bin, avg(mass) AS m FROM hh GROUP BY ALL), ll AS (SELECT p.bin, ln(p.m / n.m) AS llr FROM aa p JOIN aa n ON p.bin = n.bin AND p.y AND NOT n.y)"


@query("rank_likelihood_fit", f"WITH {V}, {RANKED}, {HIST}, {LLR} SELECT bin, round(llr, 9) AS llr FROM ll")
def rank_likelihood_fit(spark, d):
    return calibration.likelihood_ratio(_ranked(spark, d), "family", "y", "rk", 8, 0.5).select("bin", r("llr", 9))


# Rows of equal llr have equal scores, so the ECDF runs over distinct values.
@query("rank_likelihood_query", f"WITH {V}, {RANKED}, {HIST}, {LLR}, sx AS (SELECT id, family, round(llr, 12) AS llr FROM bb JOIN ll USING (bin)), fv AS (SELECT f.family, l.llr, count(sx.id) AS c FROM (SELECT DISTINCT family FROM sx) f CROSS JOIN (SELECT DISTINCT llr FROM sx) l LEFT JOIN sx ON sx.family = f.family AND sx.llr = l.llr GROUP BY ALL), ec AS (SELECT llr, (sum(c) OVER (PARTITION BY family ORDER BY llr) - c)::DOUBLE / (sum(c) OVER (PARTITION BY family) + 1) AS e FROM fv), sc AS (SELECT llr, avg(e) AS score FROM ec GROUP BY llr) SELECT id, round(sx.llr, 6) AS llr, round(score, 6) AS score FROM sx JOIN sc USING (llr)")
def rank_likelihood_query(spark, d):
    df = _ranked(spark, d)
    return experiments.rank_likelihood(df, df, "family", "y", "rk", 8, 0.5, "id").select("id", r("llr"), r("score"))


@query("leave_source_out_counts", f"WITH {V}, {RANKED}, o AS (SELECT family, g, y, bin, count(*) AS c FROM bb GROUP BY ALL), t AS (SELECT family, y, bin, sum(c) AS t FROM o GROUP BY ALL) SELECT s.family, s.g, t.y, t.bin, (t - coalesce(c, 0))::BIGINT AS c FROM (SELECT DISTINCT family, g FROM v) s JOIN t USING (family) LEFT JOIN o USING (family, g, y, bin)")
def leave_source_out_counts(spark, d):
    return calibration.left_out_counts(_ranked(spark, d), "family", "g", "y", "rk", 8)


@query("family_conformity", f"WITH {V}, u AS (SELECT family % 3 AS fam, id % 500 AS row, min(s) AS a, max(s) AS b, bool_and(ok) AS sup FROM v GROUP BY ALL), c AS (SELECT row, count(*) FILTER (sup) AS support, avg(1 / (1 + a)) FILTER (sup) AS pos, avg(1 / (1 + b)) FILTER (sup) AS neg FROM u GROUP BY row) SELECT row, support, support >= 2 AS supported, round(CASE WHEN support >= 2 THEN (1 + pos - neg) / 2 ELSE 0 END, 9) AS score FROM c")
def family_conformity(spark, d):
    u = scored(spark, d).groupBy((F.col("family") % 3).alias("fam"), (F.col("id") % 500).alias("row")).agg((1 / (1 + F.min("s"))).alias("pos"), (1 / (1 + F.max("s"))).alias("neg"), F.bool_and("ok").alias("supported"))
    return calibration.combine_families(u, ["row"], 3).select("row", "support", "supported", r("score", 9))


KTH = "SELECT q.id, q.scale, q.block, " + DIST + " AS d, row_number() OVER (PARTITION BY q.id ORDER BY " + DIST + ", b.id) AS k FROM"


@query("tail_calibrator", f"""WITH {E}, ng AS (SELECT * FROM e WHERE lib AND NOT y), rf AS (SELECT * FROM ({KTH} ng q JOIN ng b ON q.scale = b.scale AND q.id <> b.id) WHERE k IN (1, 3)), qk AS (SELECT * FROM ({KTH} e q JOIN ng b ON q.scale = b.scale WHERE NOT q.lib) WHERE k IN (1, 3)),
t AS (SELECT q.id, q.k, count(*) FILTER (r.scale = q.scale AND r.block = q.block) AS n, count(*) FILTER (r.scale = q.scale AND r.block = q.block AND r.d >= q.d) AS ge, count(*) FILTER (r.block = q.block) AS bn, count(*) FILTER (r.block = q.block AND r.d >= q.d) AS bg, count(*) AS tn, count(*) FILTER (r.d >= q.d) AS tg FROM qk q JOIN rf r ON r.k = q.k GROUP BY q.id, q.k),
m AS (SELECT *, CASE WHEN n > 0 AND bn > n THEN 1 WHEN n > 0 AND tn > bn THEN 2 WHEN n > 0 THEN 3 WHEN bn > n THEN 4 WHEN tn > bn THEN 5 ELSE 0 END AS mode, (ge + 1)::DOUBLE / (n + 1) AS l, (bg - ge + 1)::DOUBLE / (bn - n + 1) AS near, (tg - bg + 1)::DOUBLE / (tn - bn + 1) AS far, n / (n + 64.0::DOUBLE) AS w FROM t)
SELECT id AS query_id, k::INT AS k, mode, round(CASE mode WHEN 1 THEN w * l + (1 - w) * near WHEN 2 THEN w * l + (1 - w) * far WHEN 3 THEN l WHEN 4 THEN near WHEN 5 THEN far END, 6) AS tail, mode > 0 AS supported FROM m""")
def tail_calibrator(spark, d):
    df = vectors(spark, d)
    return experiments.TailCalibrator(df.filter("lib"), "scale", "block", [1, 3]).query(df.filter("not lib").select("id", "scale", "block", "f")).select("query_id", "k", "mode", r("tail"), "supported")


@query("class_conditional_score", f"""WITH {E}, tn AS (SELECT id, scale, id % 3 AS fam, y AS cls, f FROM e WHERE lib), ow AS (SELECT q.id, q.scale, q.fam, q.cls, min({DIST}) AS d FROM tn q JOIN tn b ON q.scale = b.scale AND q.fam = b.fam AND q.cls = b.cls AND q.id <> b.id GROUP BY ALL),
fo AS (SELECT q.id, q.scale, b.fam, b.cls, min({DIST}) AS d FROM e q JOIN tn b ON q.scale = b.scale WHERE NOT q.lib GROUP BY ALL),
ta AS (SELECT fo.id, fo.fam, fo.cls, CASE WHEN count(ow.d) > 0 THEN (count(*) FILTER (ow.d >= fo.d) + 1)::DOUBLE / (count(ow.d) + 1) END AS tail FROM fo LEFT JOIN ow ON ow.scale = fo.scale AND ow.fam = fo.fam AND ow.cls = fo.cls GROUP BY fo.id, fo.fam, fo.cls),
wd AS (SELECT id, fam, max(tail) FILTER (cls) AS pos, max(tail) FILTER (NOT cls) AS neg FROM ta GROUP BY id, fam), ok AS (SELECT * FROM wd WHERE pos IS NOT NULL AND neg IS NOT NULL)
SELECT e.id AS query_id, count(ok.id) AS support, count(ok.id) >= 2 AS supported, round(CASE WHEN count(ok.id) >= 2 THEN (1 + avg(pos) - avg(neg)) / 2 ELSE 0 END, 6) AS score FROM e LEFT JOIN ok ON ok.id = e.id WHERE NOT e.lib GROUP BY e.id""")
def class_conditional_score(spark, d):
    df = vectors(spark, d).withColumn("family", F.col("id") % 3)
    return experiments.class_conditional(df.filter("lib"), df.filter("not lib"), [0, 1, 2], "scale", 1).select("query_id", "support", "supported", r("score"))


FOLD = MARGIN.replace("WHERE lib) GROUP BY i)", "WHERE family <> 2) GROUP BY i)").replace("WHERE NOT q.lib AND b.lib)", "WHERE q.family = 2 AND b.family <> 2)").replace("SELECT id, y, lib, list_transform", "SELECT id, y, family, list_transform")


def _fold(k):
    return FOLD.replace("family <> 2", f"family <> {k}").replace("family = 2", f"family = {k}")


@query("leave_one_family_out", " UNION ALL ".join(f"SELECT * FROM (WITH {_fold(k)} SELECT query_id, {k} AS fold, y, p, matched_id, round(s, 4) AS s FROM m)" for k in range(7)))
def leave_one_family_out(spark, d):
    return experiments.family_folds(vectors(spark, d), list(range(7))).select("query_id", "fold", "y", "p", "matched_id", r("s", 4))


# Fields and sources (GR, SC).


@query("scale_table", "SELECT (row_number() OVER (ORDER BY b, dx, ds, arc) - 1)::INT AS scale_id, b AS block, dx, ds, arc FROM (SELECT 0 AS b, x * 0.5::DOUBLE AS dx, s * 0.25::DOUBLE AS ds, a::DOUBLE AS arc FROM range(1, 5) r(x), range(1, 4) q(s), range(1, 6) t(a) UNION ALL SELECT 1, x * 2.5::DOUBLE, s * 0.25::DOUBLE, a::DOUBLE FROM range(1, 5) r(x), range(1, 4) q(s), range(1, 6) t(a))")
def scale_table(spark, d):
    axes = lambda h: [[h * x for x in range(1, 5)], [0.25 * s for s in range(1, 4)], list(range(1, 6))]
    return fields.scale_table(spark, [axes(0.5), axes(2.5)])


@query("seed_grid", "SELECT x + 5 * y + 20 * z AS seed_id, round(0.1 + x * 0.2::DOUBLE, 9) AS x, round(0.2 + y * 1.6 / 3.0::DOUBLE, 9) AS y, round(0.3 + z * 2.4 / 2.0::DOUBLE, 9) AS z FROM range(5) a(x), range(4) b(y), range(3) c(z)")
def seed_grid(spark, d):
    return fields.seed_grid(spark, [0, 0, 0], [1, 2, 3], [5, 4, 3], 0.1, 0.0).select("seed_id", r("x", 9), r("y", 9), r("z", 9))


VOL = "vol AS (SELECT (l_quantity - 1)::INT AS ix, (l_linenumber - 1)::INT AS iy, (year(l_shipdate) - 1995)::INT AS iz, avg(l_extendedprice) AS u, avg(l_discount) AS v, avg(l_tax) AS w FROM lineitem GROUP BY ALL)"


def _volume(spark, d):
    """The whole table as a grid of 50, 7 and 7 places: quantity, line, and year from 1995 to 2001."""
    return table(spark, d, "lineitem").groupBy((F.col("l_quantity") - 1).cast("int").alias("ix"), (F.col("l_linenumber") - 1).cast("int").alias("iy"), (F.year("l_shipdate") - 1995).cast("int").alias("iz")).agg(F.avg("l_extendedprice").alias("u"), F.avg("l_discount").alias("v"), F.avg("l_tax").alias("w"))


def _grad(c, axis, h, rest):
    w = f"(PARTITION BY {rest} ORDER BY {axis})"
    return f"CASE WHEN lag({c}) OVER {w} IS NULL THEN (lead({c}) OVER {w} - {c}) / {h} WHEN lead({c}) OVER {w} IS NULL THEN ({c} - lag({c}) OVER {w}) / {h} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / (2 * {h}) END"


X, Y, Z = ("ix", "0.5::DOUBLE", "iy, iz"), ("iy", "0.25::DOUBLE", "ix, iz"), ("iz", "2.0::DOUBLE", "ix, iy")
CURL = f"cu AS (SELECT ix, iy, iz, {_grad('w', *Y)} - ({_grad('v', *Z)}) AS cx, {_grad('u', *Z)} - ({_grad('w', *X)}) AS cy, {_grad('v', *X)} - ({_grad('u', *Y)}) AS cz FROM vol)"


@query("grid_curl", f"WITH {VOL}, {CURL} SELECT ix, iy, iz, round(cx, 8) AS cx, round(cy, 7) AS cy, round(cz, 7) AS cz FROM cu")
def grid_curl(spark, d):
    return fields.curl(_volume(spark, d), [], [0.5, 0.25, 2.0]).select("ix", "iy", "iz", r("cx", 8), r("cy", 7), r("cz", 7))


DEV = "dv AS (SELECT ix, iy, iz, sqrt((cx - avg(cx) OVER ()) * (cx - avg(cx) OVER ()) + (cy - avg(cy) OVER ()) * (cy - avg(cy) OVER ()) + (cz - avg(cz) OVER ()) * (cz - avg(cz) OVER ())) AS deviation FROM cu)"


@query("vorticity_deviation_mask", f"WITH {VOL}, {CURL}, {DEV}, q AS (SELECT quantile_cont(deviation, 0.95) AS c FROM dv) SELECT ix, iy, iz, round(deviation, 3) AS deviation, deviation >= c AS mask FROM dv, q")
def vorticity_deviation_mask(spark, d):
    dv = fields.group_centred_norm(fields.curl(_volume(spark, d), [], [0.5, 0.25, 2.0]), [], ["cx", "cy", "cz"])
    return predicates.percentile_mask(dv, [], "deviation").select("ix", "iy", "iz", r("deviation", 3), "mask")


@query("group_centred", "WITH v AS (SELECT l_orderkey, l_linenumber, l_discount - avg(l_discount) OVER (PARTITION BY l_returnflag) AS a, l_tax - avg(l_tax) OVER (PARTITION BY l_returnflag) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(sqrt(a * a + b * b), 9) AS deviation FROM v")
def group_centred(spark, d):
    return fields.group_centred_norm(table(spark, d, "lineitem"), ["l_returnflag"], ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", r("deviation", 9))


@query("trilinear_sample", f"""WITH {VOL}, p AS (SELECT c_custkey AS id, (c_custkey * 37 % 4900) / 100.0::DOUBLE AS x, (c_custkey * 53 % 600) / 100.0::DOUBLE AS y, (c_custkey * 71 % 600) / 100.0::DOUBLE AS z FROM customer),
c AS (SELECT *, least(floor(x), 48)::INT AS cx, least(floor(y), 5)::INT AS cy, least(floor(z), 5)::INT AS cz FROM p),
k AS (SELECT id, cx + i AS ix, cy + j AS iy, cz + k AS iz, CASE i WHEN 1 THEN x - cx ELSE 1 - (x - cx) END * CASE j WHEN 1 THEN y - cy ELSE 1 - (y - cy) END * CASE k WHEN 1 THEN z - cz ELSE 1 - (z - cz) END AS w FROM c, range(2) a(i), range(2) b(j), range(2) e(k))
SELECT id, round(sum(k.w * vol.u), 4) AS u FROM k JOIN vol USING (ix, iy, iz) GROUP BY id""")
def trilinear_sample(spark, d):
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select(c.alias("id"), (c * 37 % 4900 / 100.0).alias("x"), (c * 53 % 600 / 100.0).alias("y"), (c * 71 % 600 / 100.0).alias("z"))
    return fields.trilinear(points, _volume(spark, d), "id", [0, 0, 0], [1, 1, 1], [50, 7, 7], "u").select("id", r("u", 4))


@query("uniform_axis", "WITH d AS (SELECT o_custkey % 5 AS k, o_orderkey AS x, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS s FROM orders), f AS (SELECT k, arg_min(s, x) AS f, min(s) AS lo, max(s) AS hi, count(s) AS n FROM d WHERE s IS NOT NULL GROUP BY k) SELECT k, lo > 0 AS increasing, lo > 0 AND greatest(hi - f, f - lo) <= 1e-8::DOUBLE + 1e-4::DOUBLE * abs(f) AS uniform, n AS steps FROM f")
def uniform_axis(spark, d):
    df = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("k"), F.col("o_orderkey").alias("x"))
    return tables.uniform_axis(df, ["k"], "x")


@query("window_starts", "SELECT k::INT AS k, floor(k * (40 - 12 - 1) / 3)::BIGINT AS start FROM range(4) r(k)")
def window_starts(spark, d):
    return tables.window_starts(spark, 40)


@query("registry_report", "WITH e AS (SELECT unnest(range(30)) AS k), o AS (SELECT n_nationkey::BIGINT AS k, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey > 2 GROUP BY ALL) SELECT coalesce(e.k, o.k) AS k, coalesce(n, 0) AS rows, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN o.k IS NULL THEN 'absent' ELSE 'present' END AS state FROM (SELECT * FROM e WHERE k <> 7) e FULL JOIN o ON e.k = o.k")
def registry_report(spark, d):
    expected = spark.range(30).select(F.col("id").alias("k")).filter("k <> 7")
    observed = table(spark, d, "customer").filter("c_nationkey > 2").select(F.col("c_nationkey").cast("long").alias("k"))
    return tables.registry_report(expected, observed, ["k"])


@query("expected_counts", f"WITH {V}, c AS (SELECT g, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS b FROM v GROUP BY g) SELECT g FROM c WHERE a <> 14 OR b <> 52")
def expected_counts(spark, d):
    return tables.expect_counts(scored(spark, d), ["g"], {True: 14, False: 52}, "y")


@query("fourier_sums", "WITH e AS (SELECT user_id AS g, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT g, round(sum(v * cos(2 * pi() * 3 * t / n)), 4) AS re, round(-sum(v * sin(2 * pi() * 3 * t / n)), 4) AS im FROM e GROUP BY g")
def fourier_sums(spark, d):
    from pyspark.sql.window import Window

    from plumbline.functions.descriptors import sql_spectrum

    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("g"), F.col("value").alias("v"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("t"), F.count(F.lit(1)).over(w).alias("n"))
    re, im = sql_spectrum("v", "t", F.col("n"), 3)
    return e.groupBy("g").agg(F.round(re, 4).alias("re"), F.round(im, 4).alias("im"))


@query("pca_projection")
def pca_projection(spark, d):
    df = vectors(spark, d)
    mean, rows, _ = scaling.fit_pca(df.filter("lib"), 4)
    return scaling.apply_pca(df, mean, rows).select("id", F.transform("projected", lambda x: F.round(x, 5)).alias("projected"))


PLACES = "[1, 256, 65536, 16777216, 4294967296, 1099511627776, 281474976710656, 72057594037927936]::HUGEINT[]"
SQUARE = "(pts[i].px - pts[nxt].px) * (pts[i].px - pts[nxt].px) + (pts[i].pz - pts[nxt].pz) * (pts[i].pz - pts[nxt].pz)"


@query("farthest_sample", f"""WITH RECURSIVE {GRID}, p AS (SELECT x % 2 AS k, list({{'id': x * 10 + z, 'px': x::DOUBLE, 'pz': z::DOUBLE}} ORDER BY x * 10 + z) AS pts FROM cells GROUP BY x % 2),
h AS (SELECT *, sha256('0|' || k) AS h FROM p), s AS (SELECT k, pts, (list_sum(list_transform(range(1, 9), lambda i: ('0x' || h[2 * i - 1:2 * i])::HUGEINT * ({PLACES})[i])) % len(pts))::INT + 1 AS nxt FROM h),
r(k, pts, nth, nxt, chosen, dist) AS (SELECT k, pts, 0, nxt, [nxt], list_transform(range(1, len(pts) + 1), lambda i: {SQUARE}) FROM s
UNION ALL SELECT k, pts, nth + 1, nxt, list_append(chosen, nxt), list_transform(range(1, len(pts) + 1), lambda i: CASE WHEN list_contains(list_append(chosen, nxt), i::INT) THEN -1 ELSE least(dist[i], {SQUARE}) END)
FROM (SELECT k, pts, nth, chosen, dist, list_position(dist, list_max(dist))::INT AS nxt FROM r) WHERE nth + 1 < least(12, len(pts))) SELECT k, pts[nxt].id AS id, nth::BIGINT AS nth FROM r""")
def farthest_sample(spark, d):
    df = _cells(spark, d).select((F.col("x") * 10 + F.col("z")).alias("id"), (F.col("x") % 2).alias("k"), F.col("x").cast("double").alias("px"), F.col("z").cast("double").alias("pz"))
    return selection.farthest_sample(df, ["k"], "id", ["px", "pz"], 12)


def _bundles(spark, d):
    """Bundles of seven paths from vectors: deterministic, one a row."""
    place = F.sequence(F.lit(0), F.lit(671))
    flat = F.transform(place, lambda i: (F.get("f", (i % 64).cast("int")) * F.sin(i.cast("double") * 0.37) + i.cast("double") * 0.01).cast("float"))
    return vectors(spark, d).select("id", "scale", flat.alias("flat"))


@query("path_descriptor")
def path_descriptor(spark, d):
    from plumbline.functions import descriptors
    from plumbline.plans.scratch import ship

    ship(spark)
    return _bundles(spark, d).select("id", descriptors.column(descriptors.path_descriptor)(F.col("flat")).alias("features"))


@query("gradient_descriptor")
def gradient_descriptor(spark, d):
    from plumbline.functions import descriptors
    from plumbline.plans.scratch import ship

    ship(spark)
    return descriptors.grouped_gradient_features(_bundles(spark, d), ["scale"], "id", "flat")


@query("integrated_crosses")
def integrated_crosses(spark, d):
    import numpy as np

    from plumbline.plans.scratch import ship

    ship(spark)
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, 9)] * 3, indexing="ij")
    swirl = np.stack([-y, x, np.full_like(x, 0.1)], -1)
    field = fields.Field(np.stack([swirl, swirl]), [-1, -1, -1], [0.25] * 3, 0.0, 10.0)
    seeds = fields.seed_grid(spark, [-1, -1, -1], [1, 1, 1], [8, 8, 4], 0.3, 0.0).select("*", F.lit(0.05).alias("dx"), F.lit(0.05).alias("dt"), F.lit(0.4).alias("arc"))
    return fields.integrate_crosses(seeds, field, "seed_id", 0.0, 8.0)
