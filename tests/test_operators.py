"""Golden cases, analytic checks and invariances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import descriptors
from plumbline.operators import calibration, fields, joins, metrics, neighbours, predicates, ranks, scaling, selection
from plumbline.plans import experiments
from plumbline.sources import grids, tables


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_margin_and_tie(spark):
    lib = frame(spark, "id long, f array<float>, y boolean", (0, [0.0, 0.0], False), (1, [0.0, 1.0], False), (2, [10.0, 10.0], True), (3, [10.0, 11.0], True))
    q = frame(spark, "id long, f array<float>", (0, [0.1, 0.2]), (1, [9.9, 10.2]))
    got = {r.query_id: r for r in neighbours.class_margin(q, lib).collect()}
    assert (got[0].p, got[0].matched_id, got[1].p, got[1].matched_id) == (False, 0, True, 2) and got[0].s < 0 < got[1].s
    tie = neighbours.class_margin(frame(spark, "id long, f array<float>", (0, [0.0])), frame(spark, "id long, f array<float>, y boolean", (0, [1.0], True), (1, [-1.0], False))).first()
    assert tie.s == 0 and not tie.p and tie.matched_id == 1


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)], bool(i % 3 == 0), i % 2) for i in range(60)]
    df = frame(spark, "id long, f array<double>, y boolean, k int", *rows)

    def run():
        return sorted(map(tuple, neighbours.nearest(df, df, 3, ["k"], exclude_self=True).select("query_id", "y", "library_id", "nth").collect()))

    whole = run()
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "ROWS", 5)
    assert run() == whole


def test_strict_support_names_the_key(spark):
    lib = frame(spark, "id long, f array<double>, k int", (0, [0.0], 10))
    with pytest.raises(ValueError, match="30"):
        neighbours.kth_distances(frame(spark, "id long, f array<double>, k int", (0, [0.0], 30)), lib, [1, 2], ["k"], strict=True)


def test_ranking_ties(spark):
    df = frame(spark, "y boolean, s double, p boolean", (False, 0.1, False), (False, 0.4, True), (True, 0.35, False), (True, 0.8, True))
    row = metrics.metric_rows(df, []).first()
    assert row.average_precision == pytest.approx(5 / 6) and row.auroc == 0.75 and row.precision == row.recall == row.f1 == row.balanced_accuracy == 0.5
    flat = metrics.ranking(df.withColumn("s", F.lit(1.0)), []).first()
    assert flat.average_precision == 0.5 and flat.auroc == 0.5
    one = metrics.ranking(df.filter("not y"), []).first()
    assert one.average_precision is None and one.auroc is None


@pytest.mark.parametrize(("ref", "ask", "want"), [([1, 2, 2, 4], [0, 2, 3, 5], [1, 0.8, 0.4, 0.2]), ([0, 1, 1, 3], [1, 2, 4], [0.8, 0.4, 0.2])])
def test_tail(spark, ref, ask, want):
    r = frame(spark, "k int, v double", *[(0, float(x)) for x in ref])
    q = frame(spark, "k int, id long, v double", *[(0, i, float(x)) for i, x in enumerate(ask)])
    assert [x.tail for x in calibration.tail_probability(r, q, ["k"], "v", "id").orderBy("id").collect()] == pytest.approx(want)


def test_ranks(spark):
    df = frame(spark, "g int, id int, s double, c int", (0, 0, 3.0, 8), (0, 1, 1.0, 4), (0, 2, 1.0, 2), (0, 3, 2.0, 9))
    out = df.select("id", ranks.percentile_rank(["g"], "s", "c").alias("p"), ranks.midrank(["g"], "s").alias("m")).orderBy("id").collect()
    assert [x.p for x in out] == [1, 0.5, 0.25, 0.75] and [x.m for x in out] == [0.875, 0.25, 0.25, 0.625]


def test_supported_rank(spark):
    df = frame(spark, "id int, d double, c int, ok boolean", (0, 2.0, 10, True), (1, 2.0, 5, True), (2, None, 9, False), (3, 1.0, 7, True))
    out = df.select("id", ranks.supported_rank([], "d", "c", F.col("ok")).alias("p")).orderBy("id").collect()
    assert [x.p for x in out] == pytest.approx([1, 2 / 3, 0, 1 / 3])


@pytest.mark.parametrize(("share", "want"), [(0.25, [False, True, False, False]), (0.26, [True, True, False, False])])
def test_top_fraction(spark, share, want):
    df = frame(spark, "id int, s double, c int", (0, 0.5, 10), (1, 0.5, 5), (2, 0.2, 7), (3, 0.0, 8))
    assert [r.selected for r in selection.top_fraction(df, [], "s", "c", share).orderBy("id").collect()] == want


@pytest.mark.parametrize(("values", "want"), [([10, 0.2, 9, 0], [True, False, True, False]), ([0, 1, 1], [False, True, True]), ([1e12, 1e12 + 1, 1e12 + 1], [False, True, True]), ([3, 3], [False, False])])
def test_two_means(spark, values, want):
    df = frame(spark, "id int, s double", *[(i, float(v)) for i, v in enumerate(values)])
    assert [r.high for r in selection.two_means(df, [], "s").orderBy("id").collect()] == want


def test_masked_gaussian(spark):
    df = frame(spark, "x int, s double, ok boolean", (0, 0.0, True), (2, 10.0, True))
    out = {r.x: r.smooth for r in ranks.masked_gaussian(df, [], {"x": 3}, "s", F.col("ok"), 1.0, 2.0).collect()}
    w = np.exp(-2)
    assert out[0] == pytest.approx(10 * w / (1 + w)) and out[2] == pytest.approx(10 / (1 + w)) and out[1] == pytest.approx(5)


def test_best_f1(spark):
    df = frame(spark, "y boolean, s double", (True, 0.9), (False, 0.8), (True, 0.7), (False, 0.6))
    assert selection.best_f1_threshold(df, [], "y", "s").first().threshold == 0.7


def test_fusion(spark):
    rows = [(0, 0, 0.8, True), (1, 0, 0.6, True), (2, 1, 0.7, True), (3, 0, 0.8, True), (3, 1, 0.8, True)]
    df = frame(spark, "centre int, block int, s double, valid boolean", *rows).withColumn("g", F.lit(0))
    out = experiments.fuse_centres(df, ["g"], 0.75, 0.5).orderBy("centre").collect()
    assert [r.fused for r in out] == pytest.approx([0.8, 0.6, 0.7, 0.8]) and [r.selected for r in out] == [True, False, False, True]


def test_shrunk_scaler_modes(spark):
    df = frame(spark, "k int, v double", (0, 1.0), (0, 3.0), (1, 5.0), (1000, 2.0), (1000, 4.0), (2000, 9.0))
    rows = {r.k: r for r in scaling.fit_shrunk_scaler(df, "k", F.floor(F.col("k") / 1000), "v").collect()}
    assert [rows[k].mode for k in (0, 1, 1000, 2000)] == [1, 1, 2, 2]
    assert rows[0].variance == pytest.approx(2 / 66 * 1.0 + 64 / 66 * 0.0)
    assert scaling.apply_keyed_scaler(frame(spark, "k int, v double", (7, 5.0)), scaling.fit_shrunk_scaler(df, "k", F.lit(0), "v"), "k", "v").first().z == 0


def test_pca_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(200, 5)) * [5, 4, 3, 2, 1]
    mean, rows, var = scaling.fit_pca(frame(spark, "f array<double>", *[(list(map(float, v)),) for v in x]).repartition(5), 3)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(var, want[1][:3] ** 2 / len(x)) and np.allclose(np.abs(rows), np.abs(want[2][:3]))
    assert (rows[np.arange(3), np.abs(rows).argmax(1)] > 0).all()


def test_arc_targets(spark):
    path = frame(spark, "k int, t int, x double, y double", (0, 0, 0.0, 0.0), (0, 1, 3.0, 0.0), (0, 2, 3.0, 1.0), (1, 0, 5.0, 5.0))
    out = joins.arc_targets(path, "k", ["t"], ["x", "y"], 5).orderBy("sample").collect()
    assert [(r.x, r.y) for r in out] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)]


def test_exact_join_rejects(spark):
    a, b = frame(spark, "k int, v int", (1, 1), (2, 2)), frame(spark, "k int, w int", (1, 1))
    with pytest.raises(ValueError, match="differ"):
        joins.exact_join(a, b, ["k"])


def test_checked_fails_closed(spark):
    df = frame(spark, "f array<float>", ([1.0, float("nan")],))
    with pytest.raises(Exception, match="finite"):
        predicates.checked(df, predicates.finite_features("f", 2), "not finite").collect()


def swirl(n=9):
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, n)] * 3, indexing="ij")
    return np.stack([-y, x, np.zeros_like(x)], -1)


def test_rigid_rotation_has_no_deviation(spark):
    v = swirl(5)
    rows = [(int(i), int(j), int(k), *map(float, v[k, j, i])) for k in range(5) for j in range(5) for i in range(5)]
    df = frame(spark, "ix int, iy int, iz int, u double, v double, w double", *rows)
    out = fields.group_centred_norm(fields.curl(df, [], [0.5] * 3), [], ["cx", "cy", "cz"])
    assert out.agg(F.max("deviation")).first()[0] < 1e-9


def test_trilinear_is_exact_on_linear_fields(spark):
    grid = frame(spark, "ix int, iy int, iz int, v double", *[(i, j, k, 2.0 * i - 3 * j + 0.5 * k) for i in range(3) for j in range(4) for k in range(5)])
    points = frame(spark, "id int, x double, y double, z double", (0, 0.3, 1.7, 2.2), (1, 2.0, 3.0, 4.0), (2, 9.0, 0.0, 0.0))
    out = {r.id: r.v for r in fields.trilinear(points, grid, "id", [0, 0, 0], [1, 1, 1], [3, 4, 5]).collect()}
    assert out == pytest.approx({0: 0.6 - 5.1 + 1.1, 1: 4 - 9 + 2})


def test_rk4_follows_the_exponential():
    x = np.linspace(0, 4, 41)
    v = np.zeros((2, 2, 2, 41, 3))
    v[..., 0] = x
    p, n = fields.Field(v, [0, 0, 0], [0.1, 1, 1], 0, 10).paths(np.array([[1.0, 0.5, 0.5]]), 0, 0.1, 5)
    assert n[0] == 6 and np.allclose(p[0, :, 0], np.exp(p[0, :, 3]), atol=1e-5)


def test_arc_paths_have_even_spacing():
    f = fields.Field(np.stack([swirl(21)] * 2), [-1] * 3, [0.1] * 3, 0, 50)
    p, ok = f.arc_paths(np.array([[0.5, 0, 0], [0.99, 0.9, 0]]), 0, 40, np.array(0.02), np.array([0.6, 5.0]), 32)
    steps = np.sqrt((np.diff(p[0, :, :3], axis=0) ** 2).sum(1))
    assert ok.tolist() == [True, False] and np.allclose(steps, 0.6 / 31, rtol=1e-3)


def test_observer_displacement_is_the_trapezoid():
    r, d = fields.observer_frames(np.tile([2.0, 0, 0, 0, 0, 0], (5, 1)), 0.25)
    assert np.allclose(d[:, 0], [0, 0.5, 1, 1.5, 2]) and np.allclose(r, np.eye(3))


def bundles(n=8):
    rng = np.random.default_rng(1)
    return np.cumsum(rng.normal(size=(n, 7, 32, 3)), axis=2)


def test_descriptor_ignores_rigid_motion_and_batches():
    p = bundles()
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    a = descriptors.path_descriptor(p)
    assert a.shape == (8, 161) and np.allclose(a, descriptors.path_descriptor(p @ q.T + [1, 2, 3]), atol=2e-5)
    assert np.array_equal(a[3:5], descriptors.path_descriptor(p[3:5]))
    assert descriptors.gram_features(p).shape == (8, 231) and descriptors.anchored_features(p).shape == (8, 4 * 11 + 28)
    assert predicates.feature_indices("real_neighbor") == [23 * k + 3 * f for k in range(1, 7) for f in range(6)]
    assert len(predicates.feature_indices("chirality_all")) == 35


def test_reflection_turns_chirality():
    p = bundles(2)
    a, b = (descriptors.rotation_invariants(np.diff(x[:, 0], axis=1)) for x in (p, p * [1, 1, -1]))
    assert np.allclose(a[:, :18], b[:, :18]) and np.allclose(a[:, 18:], -b[:, 18:])


def test_farthest_points():
    assert selection.farthest_points(np.array([[0.0], [1.0], [10.0], [6.0]]), 3, 0) == [0, 2, 3]


def test_sequential_draws_skip_without_drawing(spark):
    some = frame(spark, "k int, n0 long, n1 long", (0, 5, 4), (2, 6, 3))
    more = frame(spark, "k int, n0 long, n1 long", (0, 5, 4), (1, 0, 9), (2, 6, 3))
    a, b = (sorted(map(tuple, selection.sequential_draws(x, ["k"], 2, 5).collect())) for x in (some, more))
    assert a == b and len(a) == 8


def test_window_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.npz")
    v = np.arange(2 * 3 * 4 * 5 * 3, dtype=np.float32).reshape(2, 3, 4, 5, 3)
    digests = grids.write_window(path, v, range(5), range(4), range(3), [0.0, 1.0])
    assert digests["velocity"] == tables.array_digest(v)
    with pytest.raises(FileExistsError):
        grids.write_window(path, v, range(5), range(4), range(3), [0.0, 1.0])
    spark.dataSource.register(grids.GridWindow)
    df = spark.read.format("grid_window").option("start", 1).load(path)
    rows = df.collect()
    assert len(rows) == 60 and {r.t for r in rows} == {1.0} and all(r.u == v[1, r.iz, r.iy, r.ix, 0] for r in rows)
    assert grids.inspect(spark, path).first().nx == 5


def test_tables(spark, tmp_path):
    df = frame(spark, "id long, f array<float>, y boolean, metadata string", (1, [1.0], True, "{}"))
    tables.save_library(df, frame(spark, "mean array<double>, scale array<double>, descriptor_id string, schema_version short", ([0.0], [1.0], "d", 1)), str(tmp_path / "lib"))
    lib, _ = tables.load_library(spark, str(tmp_path / "lib"), "d")
    assert lib.collect() == df.collect()
    with pytest.raises(ValueError, match="another"):
        tables.load_library(spark, str(tmp_path / "lib"), "e")
    with pytest.raises(Exception):  # noqa: B017
        tables.write_once(df, str(tmp_path / "lib/library"))
    m = tables.file_manifest(spark, str(tmp_path / "lib"), "*.parquet")
    assert tables.verify_manifest(m, m).count() == 0
    assert tables.row_digest(df, df.columns, ["id"]).first() == tables.row_digest(df.repartition(3), df.columns, ["id"]).first()
    assert tables.source_starts(40) == [0, 9, 18, 27]


def test_sealed_predictions(spark, tmp_path):
    p, y = frame(spark, "id int, p boolean", (1, True)), frame(spark, "id int, y boolean", (1, False))
    assert experiments.sealed(p, y, str(tmp_path / "p"), ["id"]).first().y is False
    with pytest.raises(ValueError):
        experiments.sealed(y, y, str(tmp_path / "q"), ["id"])


def test_stream_counts_match_batch(spark, tmp_path):
    from plumbline.streaming import scoring

    df = spark.range(100).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 2 == 0).alias("y"), (F.col("id") % 3 == 0).alias("p"))
    df.write.parquet(str(tmp_path / "in"))
    q = scoring.windowed_confusion(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).first()[0] == 100


def test_nearest_meets_keys_of_different_types(spark):
    """A key that is an int on one side and a long on the other is one key, however many partitions there are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        q = frame(spark, "id long, f array<double>, key int", *[(i, [float(i)], i) for i in range(20)])
        lib = frame(spark, "id long, f array<double>, key long", *[(i, [i + 0.5], i) for i in range(20)])
        got = neighbours.kth_distances(q, lib, [1], ["key"]).collect()
        assert [(r.query_id, r.distance) for r in sorted(got, key=lambda r: r.query_id)] == [(i, 0.5) for i in range(20)]
    finally:
        spark.conf.unset(name)
