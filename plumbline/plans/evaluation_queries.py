"""Registered queries of the evaluation runs, with the SQL that must give the same rows; on the stand-ins of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import fields, ranks
from plumbline.plans import evaluation
from plumbline.plans.catalog import query
from plumbline.plans.queries import COUNTS, CURL, DEV, E, METRICS, MIX, PAIRS, RATES, SHRUNK, V, VOL, _pairs, _volume, r, ranking_sql, scored, vectors
from plumbline.plans.scratch import Scratch, table

CHOSEN = "t AS (SELECT * FROM e WHERE lib), c AS (SELECT family, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM t GROUP BY family), n AS (SELECT t.*, row_number() OVER (PARTITION BY family, y ORDER BY md5('0:' || id), id) AS k FROM t), s AS (SELECT n.* FROM n JOIN c USING (family) WHERE k <= least(20, p, q))"


@query("library_selection", f"WITH {E}, {CHOSEN} SELECT id, family, y, (SELECT round(avg(y::INT::DOUBLE), 8) FROM t) AS prior_score FROM s")
def library_selection(spark, d):
    chosen, prior = evaluation.select_library(vectors(spark, d).filter("lib"), ["family"], "y", "id", 20)
    return chosen.join(prior, F.lit(True)).select("id", "family", "y", r("prior_score", 8))


@query("library_fit", f"WITH {E}, {CHOSEN} SELECT i - 1 AS i, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS scale FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM s) GROUP BY i")
def library_fit(spark, d):
    _, _, scaler, (mean, rows, _) = evaluation.select_and_fit(vectors(spark, d).filter("lib"), ["family"], "y", "id", "f", 20, 4)
    assert len(mean) == rows.shape[1]
    return scaler.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("i", "p")).select(F.col("i").cast("long").alias("i"), F.round("p.mean", 8).alias("mean"), F.round("p.scale", 8).alias("scale"))


def _matched(n: str, f: str) -> str:
    """The nearest rows by features f, as view m<n>."""
    return f"""mo{n} AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT unnest({f}) AS x, generate_subscripts({f}, 1) AS i FROM e WHERE lib) GROUP BY i),
sc{n} AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN sd < 1e-12 THEN 1 ELSE sd END ORDER BY i) AS sd FROM mo{n}),
z{n} AS (SELECT id, y, lib, list_transform(list_zip({f}, m, sd), lambda t: ((t[1] - t[2]) / t[3])::FLOAT::DOUBLE) AS f FROM e, sc{n}),
d{n} AS (SELECT q.id, b.y AS cls, b.id AS bid, sqrt(list_sum(list_transform(list_zip(q.f, b.f), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM z{n} q, z{n} b WHERE NOT q.lib AND b.lib),
k{n} AS (SELECT id, min(d) FILTER (cls) AS d_pos, min(d) FILTER (NOT cls) AS d_neg, arg_min(bid, (d, bid)) FILTER (cls) AS id_pos, arg_min(bid, (d, bid)) FILTER (NOT cls) AS id_neg FROM d{n} GROUP BY id),
m{n} AS (SELECT e.id, e.id % 3 AS source, e.scale, e.block, e.family, e.y, d_pos, d_neg, d_neg - d_pos AS s, d_neg - d_pos > 0 AS p, CASE WHEN d_neg - d_pos > 0 THEN id_pos ELSE id_neg END AS matched FROM k{n} JOIN e USING (id))"""


METHODS = {"raw": "f", "half": "h"}
BOTH = f"WITH {E}, {_matched('raw', 'f')}, {_matched('half', 'f[1:32]')}"
LEVELS = {"source": ["source", "family"], "family": ["family"], "tuple": ["scale"], "block": ["block"], "pooled": []}
KEYS = ("source", "family", "scale", "block")


def _evaluated(spark, d):
    df = vectors(spark, d).withColumns({"source": F.col("id") % 3, "h": F.slice("f", 1, 32)})
    return evaluation.evaluate_split(df, F.col("lib"), METHODS, LEVELS, about=("family", "scale"))


def _sink_sql(m: str) -> str:
    return f"{m}.p AS {m}_prediction, round({m}.s, 4) AS {m}_score, round({m}.d_pos, 5) AS {m}_d_pos, round({m}.d_neg, 5) AS {m}_d_neg, round(least({m}.d_pos, {m}.d_neg), 5) AS {m}_distance, {m}.matched AS {m}_matched, w{m}.y AS {m}_matched_label, w{m}.family AS {m}_matched_family, w{m}.scale AS {m}_matched_scale"


@query("evaluation_sink", f"{BOTH} SELECT raw.id, raw.source, raw.scale, raw.block, raw.family, raw.y, (SELECT round(avg(y::INT::DOUBLE), 8) FROM e WHERE lib) AS prior_score, (SELECT avg(y::INT::DOUBLE) > 0.5 FROM e WHERE lib) AS prior_prediction, {_sink_sql('raw')}, {_sink_sql('half')} FROM mraw raw JOIN mhalf half USING (id) JOIN e wraw ON wraw.id = raw.matched JOIN e whalf ON whalf.id = half.matched")
def evaluation_sink(spark, d):
    sink, _ = _evaluated(spark, d)
    parts = [c for m in METHODS for c in (f"{m}_prediction", r(f"{m}_score", 4), *[r(f"{m}_{x}", 5) for x in ("d_pos", "d_neg", "distance")], f"{m}_matched", f"{m}_matched_label", f"{m}_matched_family", f"{m}_matched_scale")]
    return sink.select("id", "source", "scale", "block", "family", "y", r("prior_score", 8), "prior_prediction", *parts)


def _level_sql(method: str, level: str, own: list[str]) -> str:
    keys = ", ".join(own)
    names = ", ".join(k if k in own else f"NULL AS {k}" for k in KEYS)
    join = f"JOIN rk USING ({keys})" if own else ", rk"
    counts = f"c AS (SELECT {keys + ', ' if own else ''}{COUNTS} FROM m{method} {'GROUP BY ' + keys if own else ''})"
    return f"SELECT * FROM (WITH {counts}, {ranking_sql('m' + method, keys)} SELECT '{method}' AS method, '{level}' AS level, {names}, n, positives, tp, fp, tn, fn, {METRICS}, average_precision, auroc FROM c {join})"


@query("evaluation_levels", BOTH + " " + " UNION ALL ".join(_level_sql(m, n, own) for m in METHODS for n, own in LEVELS.items()))
def evaluation_levels(spark, d):
    _, rows = _evaluated(spark, d)
    return rows.select("method", "level", *KEYS, "n", "positives", "tp", "fp", "tn", "fn", *[r(c) for c in (*RATES, "average_precision", "auroc")])


F1 = "CASE WHEN 2 * count(*) FILTER (y AND p) + count(*) FILTER (y <> p) > 0 THEN 2.0::DOUBLE * count(*) FILTER (y AND p) / (2 * count(*) FILTER (y AND p) + count(*) FILTER (y <> p)) ELSE 0 END"


@query("evaluation_bootstrap", f"""{BOTH}, a AS (SELECT family, scale, {F1} AS a FROM mraw GROUP BY ALL), b AS (SELECT family, scale, {F1} AS b FROM mhalf GROUP BY ALL),
u AS (SELECT family, row_number() OVER (PARTITION BY family ORDER BY scale) - 1 AS pos, a - b AS d, count(*) OVER (PARTITION BY family) AS n FROM a JOIN b USING (family, scale)), n AS (SELECT family, any_value(n) AS n FROM u GROUP BY family),
dr AS (SELECT replicate, family, {MIX} % n AS pos FROM n, range(100) r(replicate), LATERAL (SELECT unnest(range(n)) AS slot)), bf AS (SELECT replicate, family, avg(d) AS d FROM dr JOIN u USING (family, pos) GROUP BY ALL), rp AS (SELECT replicate, avg(d) AS d FROM bf GROUP BY replicate),
pt AS (SELECT avg(d) AS point FROM (SELECT family, avg(d) AS d FROM u GROUP BY family)) SELECT round(any_value(point), 6) AS point, round(quantile_cont(d, 0.025), 6) AS ci_lower, round(quantile_cont(d, 0.975), 6) AS ci_upper, count(d) AS replicates FROM rp, pt""")
def evaluation_bootstrap(spark, d):
    sink, _ = _evaluated(spark, d)
    return evaluation.bootstrap_methods(sink, "raw", "half", "family", "scale", 100, F.expr(f"{MIX} % n")).select(r("point"), r("ci_lower"), r("ci_upper"), "replicates")


# Nested selection: three families; i = -1 is the refit without the outer family alone.

FOLDS = "rr AS (SELECT id, g % 3 AS fam, id % 4 AS key, y, s, (rank() OVER (PARTITION BY g % 3 ORDER BY s) + (count(*) OVER (PARTITION BY g % 3, s) - 1) * 0.5::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY g % 3) AS rk FROM v), bb AS (SELECT *, least(floor(rk * 8), 7)::INT AS bin FROM rr), op AS (SELECT o, i FROM range(3) a(o), range(-1, 3) b(i) WHERE o <> i), tr AS (SELECT op.o, op.i, bb.* FROM op JOIN bb ON fam <> o AND fam <> i)"
RANK_SCORES = """n0 AS (SELECT o, i, fam, y, count(*) AS n FROM tr GROUP BY ALL), c0 AS (SELECT o, i, fam, y, bin, count(*) AS c FROM tr GROUP BY ALL),
hh AS (SELECT x.o, x.i, x.fam, x.y, x.bin, (coalesce(c, 0) + 0.5::DOUBLE) / (n + 4.0::DOUBLE) AS mass FROM (SELECT n0.*, unnest(range(8))::INT AS bin FROM n0) x LEFT JOIN c0 ON c0.o = x.o AND c0.i = x.i AND c0.fam = x.fam AND c0.y = x.y AND c0.bin = x.bin),
aa AS (SELECT o, i, y, bin, avg(mass) AS m FROM hh GROUP BY ALL), ll AS (SELECT p.o, p.i, p.bin, ln(p.m / n.m) AS llr FROM aa p JOIN aa n ON p.o = n.o AND p.i = n.i AND p.bin = n.bin AND p.y AND NOT n.y), fb AS (SELECT o, i, fam, bin, count(*) AS c FROM tr GROUP BY ALL),
ec AS (SELECT q.o, q.i, q.bin, fb.fam, sum(CASE WHEN l.llr < q.llr THEN fb.c ELSE 0 END)::DOUBLE / (sum(fb.c) + 1) AS e FROM ll q JOIN fb ON fb.o = q.o AND fb.i = q.i JOIN ll l ON l.o = fb.o AND l.i = fb.i AND l.bin = fb.bin GROUP BY ALL),
sc AS (SELECT o, i, bin, avg(e) AS score FROM ec GROUP BY ALL), qs AS (SELECT sc.o, sc.i, bb.id, bb.y, score FROM bb JOIN sc ON bb.bin = sc.bin AND bb.fam = CASE WHEN sc.i < 0 THEN sc.o ELSE sc.i END)"""
TAIL_SCORES = """ng AS (SELECT o, i, key, s, count(*) AS c FROM tr WHERE NOT y GROUP BY ALL), qr AS (SELECT op.o, op.i, bb.* FROM op JOIN bb ON bb.fam = CASE WHEN op.i < 0 THEN op.o ELSE op.i END), uq AS (SELECT DISTINCT o, i, key, s FROM qr),
tt AS (SELECT uq.o, uq.i, uq.key, uq.s, 1 - (coalesce(sum(c) FILTER (ng.s >= uq.s), 0) + 1)::DOUBLE / (coalesce(sum(c), 0) + 1) AS score FROM uq LEFT JOIN ng ON ng.o = uq.o AND ng.i = uq.i AND ng.key = uq.key GROUP BY ALL), qs AS (SELECT qr.o, qr.i, qr.id, qr.y, score FROM qr JOIN tt USING (o, i, key, s))"""
NESTED = """cd AS (SELECT * FROM (VALUES (0, 'top', 0.1::DOUBLE), (1, 'top', 0.3::DOUBLE), (2, 'at_least', 0.5::DOUBLE), (3, 'above', 0.8::DOUBLE)) t(candidate, rule, value)),
dc AS (SELECT o, i, id, y, score, candidate, CASE rule WHEN 'top' THEN score > 0 AND k <= ceil(value * n) WHEN 'at_least' THEN score >= value ELSE score > value END AS p FROM (SELECT *, row_number() OVER (PARTITION BY o, i ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY o, i) AS n FROM qs), cd),
cc AS (SELECT o, i, candidate, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn FROM dc GROUP BY ALL),
rs AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS rec, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END AS bal FROM cc),
st AS (SELECT o, i, score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM qs GROUP BY ALL), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY o, i) AS pp FROM st WINDOW w AS (PARTITION BY o, i ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT o, i, CASE WHEN any_value(pp) > 0 THEN sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(pp) END AS ap FROM cu GROUP BY ALL),
mm AS (SELECT rs.o, candidate, avg(f1) AS f1, avg(ap) AS ap, avg(bal) AS bal, avg(prec) AS prec, avg(rec) AS rec FROM rs JOIN ap ON ap.o = rs.o AND ap.i = rs.i WHERE rs.i >= 0 GROUP BY ALL),
ch AS (SELECT o, candidate FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY f1 DESC, coalesce(ap, -1) DESC, coalesce(bal, -1) DESC, prec DESC, rec DESC, candidate) AS k FROM mm) WHERE k = 1)
SELECT rs.o AS outer_family, rs.candidate, tp, fp, tn, fn, round(f1, 6) AS f1, round(ap, 6) AS average_precision FROM rs JOIN ch USING (o, candidate) JOIN ap ON ap.o = rs.o AND ap.i = rs.i WHERE rs.i = -1"""


def _nested(spark, d, fit):
    df = ranks.with_midrank(scored(spark, d).select("id", (F.col("g") % 3).alias("fam"), (F.col("id") % 4).alias("key"), "y", "s"), ["fam"], "s", "rk")
    candidates = spark.createDataFrame([(0, "top", 0.1), (1, "top", 0.3), (2, "at_least", 0.5), (3, "above", 0.8)], "candidate int, rule string, value double")
    _, rows = evaluation.nested_run(df, "fam", [0, 1, 2], candidates, fit, Scratch(spark, "sealed").path("predictions"))
    return rows.select(F.col("outer").cast("long").alias("outer_family"), "candidate", "tp", "fp", "tn", "fn", r("f1"), r("average_precision"))


@query("nested_rank_selection", f"WITH {V}, {FOLDS}, {RANK_SCORES}, {NESTED}")
def nested_rank_selection(spark, d):
    return _nested(spark, d, evaluation.rank_fit("fam", "y", "rk", 8, 0.5, "id"))


@query("nested_tail_selection", f"WITH {V}, {FOLDS}, {TAIL_SCORES}, {NESTED}")
def nested_tail_selection(spark, d):
    return _nested(spark, d, evaluation.tail_fit(["key"], "y", "s", "id"))


@query("scale_tail", f"WITH {V}, ng AS (SELECT * FROM v WHERE NOT y), {SHRUNK.replace('FROM v', 'FROM ng')}, w AS (SELECT g, s / n AS mean, sqrt(n / (n + 64.0::DOUBLE) * lv + (1 - n / (n + 64.0::DOUBLE)) * pv) AS sd FROM k), tq AS (SELECT q.id, (count(*) FILTER (ng.s >= q.s) + 1)::DOUBLE / (count(ng.s) + 1) AS tail FROM v q JOIN ng USING (g) WHERE q.y GROUP BY q.id) SELECT q.id, q.g, round((q.s - mean) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 5) AS z, round(tail, 9) AS tail, tail IS NOT NULL AS supported FROM v q LEFT JOIN w ON w.g = q.g LEFT JOIN tq ON tq.id = q.id WHERE q.y")
def scale_tail(spark, d):
    df = scored(spark, d)
    return evaluation.scale_tail(df.filter("not y"), df.filter("y"), "g", F.col("family"), "s", "id").select("id", "g", r("z", 5), r("tail", 9), "supported")


def _arm(n: str) -> str:
    return f"(coalesce({n}_valid AND {n} > 0, false) AND row_number() OVER (PARTITION BY g, coalesce({n}_valid AND {n} > 0, false) ORDER BY {n} DESC, centre) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY g))) AS {n}_selected"


@query("block_arms", f"WITH {V}, {PAIRS} SELECT g, centre, {_arm('first')}, {_arm('second')} FROM w")
def block_arms(spark, d):
    return evaluation.block_arms(_pairs(spark, d), ["g"], 0.2)


CENTRES = "ce AS (SELECT c_custkey // 2 % 4 AS k, c_custkey // 2 AS centre, c_custkey % 2 AS block, c_nationkey % 5 AS level, c_custkey * 7 % 5 AS dx, c_acctbal::DOUBLE AS s FROM customer), rk AS (SELECT *, (rank() OVER (PARTITION BY k, block, level ORDER BY s) + (count(*) OVER (PARTITION BY k, block, level, s) - 1) * 0.5::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY k, block, level) AS rnk FROM ce), wi AS (SELECT k, centre, CASE WHEN max(dx) FILTER (block = 0) <= max(dx) FILTER (block = 1) THEN max(s) FILTER (block = 0) ELSE max(s) FILTER (block = 1) END AS least_step, avg(rnk) AS rank_mean FROM rk GROUP BY ALL)"


@query("direct_diagnostics", f"WITH {CENTRES} SELECT k, centre, round(least_step, 4) AS least_step, round(rank_mean, 9) AS rank_mean, row_number() OVER (PARTITION BY k ORDER BY least_step DESC, centre) <= ceil(0.05::DOUBLE * count(*) OVER (PARTITION BY k)) AS least_step_selected, row_number() OVER (PARTITION BY k ORDER BY rank_mean DESC, centre) <= ceil(0.05::DOUBLE * count(*) OVER (PARTITION BY k)) AS rank_mean_selected FROM wi")
def direct_diagnostics(spark, d):
    i = F.col("c_custkey").cast("long")
    rows = table(spark, d, "customer").select(F.floor(i / 2).alias("centre"), (i % 2).alias("block"), (F.col("c_nationkey") % 5).alias("level"), (i * 7 % 5).alias("dx"), F.col("c_acctbal").cast("double").alias("s"))
    out = evaluation.direct_diagnostics(rows.withColumn("k", F.col("centre") % 4), ["k"])
    return out.select("k", "centre", r("least_step", 4), r("rank_mean", 9), "least_step_selected", "rank_mean_selected")


AT = "(c_custkey * 37 % 4900) / 100.0::DOUBLE AS x, (c_custkey * 53 % 600) / 100.0::DOUBLE AS y, (c_custkey * 71 % 600) / 100.0::DOUBLE AS z"


@query("label_at_points", f"""WITH {VOL}, {CURL}, {DEV}, q AS (SELECT quantile_cont(deviation, 0.95) AS cut FROM dv), p AS (SELECT c_custkey AS id, {AT} FROM customer),
c AS (SELECT *, least(floor(x), 48)::INT AS cx, least(floor(y), 5)::INT AS cy, least(floor(z), 5)::INT AS cz FROM p),
k AS (SELECT id, cx + i AS ix, cy + j AS iy, cz + k AS iz, CASE i WHEN 1 THEN x - cx ELSE 1 - (x - cx) END * CASE j WHEN 1 THEN y - cy ELSE 1 - (y - cy) END * CASE k WHEN 1 THEN z - cz ELSE 1 - (z - cz) END AS w FROM c, range(2) a(i), range(2) b(j), range(2) e(k)),
s AS (SELECT id, sum(k.w * dv.deviation) AS deviation FROM k JOIN dv USING (ix, iy, iz) GROUP BY id) SELECT id, round(deviation, 3) AS deviation, deviation >= cut AS label FROM s, q""")
def label_at_points(spark, d):
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select(c.alias("id"), (c * 37 % 4900 / 100.0).alias("x"), (c * 53 % 600 / 100.0).alias("y"), (c * 71 % 600 / 100.0).alias("z"))
    return fields.label_at_points(_volume(spark, d), points, "id", [0, 0, 0], [1, 1, 1], [50, 7, 7], [0.5, 0.25, 2.0]).select("id", r("deviation", 3), "label")


@query("physical_scales", "SELECT (row_number() OVER (ORDER BY x, s, a) - 1)::INT AS scale_id, x * 0.5::DOUBLE * 0.25::DOUBLE AS dx, s * 0.25::DOUBLE * 1.5::DOUBLE AS dt, a * 0.25::DOUBLE AS arc FROM range(1, 5) r(x), range(1, 4) q(s), range(1, 6) t(a)")
def physical_scales(spark, d):
    scales = fields.scale_table(spark, [[[0.5 * x for x in range(1, 5)], [0.25 * s for s in range(1, 4)], list(range(1, 6))]])
    return fields.physical_scales(scales, [0.5, 0.25, 2.0], 1.5).select("scale_id", "dx", "dt", "arc")
