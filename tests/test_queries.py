"""Every registered query of the library against DuckDB on the small tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from plumbline.plans import catalog
from plumbline.plans import evaluation_queries, queries as _  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    def one(v):
        if hasattr(v, "as_tuple"):
            v = float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v + 0.0, 9)
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_bootstrap_draws_reach_every_unit(spark):
    from plumbline.plans.queries import bootstrap_draws

    units, draws = bootstrap_draws(spark, DATA)
    have = {r.family: r["count"] for r in units.groupBy("family").count().collect()}
    assert {(r.replicate, r.family): r["count"] for r in draws.groupBy("replicate", "family").count().collect()} == {(k, f): n for k in range(200) for f, n in have.items()}
    assert {(r.family, r.pos) for r in draws.select("family", "pos").distinct().collect()} == {(f, p) for f, n in have.items() for p in range(n)}
    row = catalog.QUERIES["paired_bootstrap"](spark, DATA).first()
    assert row.ci_lower < row.ci_upper


def test_bootstrap_draws_are_never_broadcast(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import metrics

    units = spark.range(1 << 21).selectExpr("id % 8 AS family", "id div 8 AS pos", "1.0D AS a", "0.0D AS b")
    draws = spark.range(200).selectExpr("id AS replicate").crossJoin(spark.range(8).selectExpr("id AS family"))
    draws = draws.withColumn("pos", F.explode(F.expr("sequence(0L, (1L << 18) - 1)")))  # 400 million rows, by estimate a few
    lines = metrics.paired_bootstrap(units, draws, "a", "b")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:+-]*", x).group()) for x in lines]
    made = [i for i, x in enumerate(lines) if "Generate explode" in x]
    assert made
    for i in made:  # what stands above: the last shallower line, and so on
        above, at = [], depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                above, at = [*above, lines[j]], depth[j]
        assert not any("BroadcastExchange" in x for x in above)


def test_every_family_is_left_out(spark):
    rows = catalog.QUERIES["leave_one_family_out"](spark, DATA).select("query_id", "fold").distinct().collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()]
    assert {(r.query_id, r.fold) for r in rows} == {(i, i % 7) for i in ids}


def test_every_row_gets_a_rank_likelihood(spark):
    ids = [r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect()]
    assert sorted(r.id for r in catalog.QUERIES["rank_likelihood_query"](spark, DATA).collect()) == sorted(ids)


def test_fields_hold_every_year(spark):
    years = [r.y - 1995 for r in spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("year(l_shipdate) AS y").distinct().collect()]
    for name in ("grid_curl", "vorticity_deviation_mask"):
        assert {r.iz for r in catalog.QUERIES[name](spark, DATA).select("iz").distinct().collect()} == set(years) == set(range(7))
    assert catalog.QUERIES["trilinear_sample"](spark, DATA).count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
