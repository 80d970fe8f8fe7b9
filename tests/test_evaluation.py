"""Two-level sums, shortlisted neighbours, sources by frame, manifests and the parts of evaluation runs, on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import descriptors
from plumbline.operators import fields, metrics, neighbours, prefix, ranks, scaling, selection
from plumbline.plans import evaluation, experiments, slices
from plumbline.sources import grids, steady, tables


def rows_of(n=500, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "a", "a", "a", "b"]), rng.choice([0.0, 1.0, 2.5, -3.0]), rng.randrange(5)) for i in range(n)]


def test_running_sums_of_groups_that_span_partitions(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, k string, v double, c long").repartition(5)
    for keys in ([], ["k"]):
        got = {r.id: r for r in prefix.running(df, keys, [F.desc("v"), F.col("id")], {"t": "c", "nth": F.lit(1).cast("long")}).collect()}
        assert len(got) == len(rows)
        for key in {None, "a", "b"} if keys else {0}:
            own = sorted((r for r in rows if not keys or r[1] == key), key=lambda r: (-r[2], r[0]))
            total = 0
            for n, r in enumerate(own, 1):
                total += r[3]
                x = got[r[0]]
                assert (x.t, x.nth, x.t_all, x.nth_all) == (total, n, sum(y[3] for y in own), len(own))
    assert prefix.running(df.limit(0), ["k"], [F.col("v")], {"t": "c"}).count() == 0


def test_quantiles_and_ranks_against_numpy(spark):
    rows = rows_of(400, 5) + [(1000, "c", None, 1)]
    df = spark.createDataFrame(rows, "id long, k string, v double, c long")
    got = {r.k: r for r in prefix.quantiles(df, ["k"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95}).collect()}
    for k in {None, "a", "b"}:
        own = [r[2] for r in rows if r[1] == k and r[2] is not None]
        assert [got[k].low, got[k].mid, got[k].high] == pytest.approx([np.quantile(own, p) for p in (0.05, 0.5, 0.95)])
    assert got["c"].mid is None
    assert prefix.quantiles(df, [], "v", {"q": 0.3}).first().q == pytest.approx(np.quantile([r[2] for r in rows if r[2] is not None], 0.3))
    a = {r.id: r.rank for r in ranks.with_midrank(df, ["k"], "v").collect()}
    b = {r.id: r.rank for r in df.withColumn("rank", ranks.midrank(["k"], "v")).collect()}
    assert a == b
    a = {r.id: r.rank for r in ranks.with_percentile_rank(df, ["k"], "v", "id", supported=F.col("c") > 1).collect()}
    b = {r.id: r.rank for r in df.withColumn("rank", ranks.supported_rank(["k"], "v", "id", F.col("c") > 1)).collect()}
    assert a == b


def test_shortlist_is_exact_on_near_ties():
    rng = np.random.default_rng(2)
    b = np.concatenate([rng.integers(-2, 3, (300, 8)).astype(float), 1e6 + rng.normal(0, 1e-7, (100, 8))])
    a = np.concatenate([b[::7], rng.normal(size=(20, 8)), 1e6 + rng.normal(0, 1e-7, (20, 8))])
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for k in (1, 3, 500):
        x, y, got = neighbours.least(a, b, k)
        want = [(i, j) for i in range(len(a)) for j in np.lexsort((np.arange(len(b)), d[i]))[:k]]
        assert list(zip(x.tolist(), y.tolist())) == want and np.array_equal(got, d[x, y])
    x, y, _ = neighbours.least(b[:5], b[:5], 2, np.eye(5, dtype=bool))
    assert (x != y).all() and len(x) == 10
    assert len(neighbours.least(a[:0], b, 1)[0]) == 0


class Variable:
    def __init__(self, dimensions, values, **attributes):
        self.dimensions, self.values, self.attributes, self.asked = dimensions, np.ma.asarray(values), attributes, []

    def __getitem__(self, cut):
        self.asked.append(cut)
        return self.values[cut]

    def ncattrs(self):
        return list(self.attributes)

    def getncattr(self, name):
        return self.attributes[name]


class Dataset:
    def __init__(self, names=("Component1", "Component2", "Component3"), order=("xdim", "tdim", "zdim", "ydim"), sizes=(5, 2, 3, 4)):
        self.dimensions = {d: range(n) for d, n in zip(order, sizes)}
        self.variables = {n: Variable(order, np.random.default_rng(i).random(sizes, np.float32)) for i, n in enumerate(names)}
        self.variables |= {"x": Variable(("xdim",), np.arange(5.0), units="m"), "ydim": Variable(("ydim",), np.arange(4) * 0.5), "z": Variable(("zdim",), np.arange(3.0)), "time": Variable(("tdim",), [0.0, 2.0])}


def test_netcdf_axes_components_and_single_frames():
    data = Dataset()
    w = grids.Netcdf(data)
    assert w.components == ("Component1", "Component2", "Component3") and w.units["x"] == "m" and w.units["y"] == "attribute_absent"
    assert not any(data.variables[c].asked for c in w.components)
    v = w.frame(1, (1, 2, 3))
    assert v.shape == (3, 2, 2, 3) and np.array_equal(v[2, 1, 1], [data.variables[c].values[3, 1, 2, 2] for c in w.components])
    assert all(data.variables[c].asked == [(slice(None, None, 3), slice(1, 2), slice(None, None, 1), slice(None, None, 2))] for c in w.components)
    del data.variables["time"]
    with pytest.raises(ValueError, match="no coordinate"):
        grids.Netcdf(data)
    w = grids.Netcdf(data, "t")
    assert w.sources["t"] == "explicit_index_fallback" and w.axes["t"].tolist() == [0.0, 1.0] and w.units["t"] == "index_coordinate_dimensionless"
    data.variables["x"].values = np.ma.masked_equal(np.arange(5.0), 2)
    with pytest.raises(ValueError, match="masked"):
        grids.Netcdf(data, "t")
    for names in (("u", "v", "w"), ("velocity_x", "velocity_y", "velocity_z"), ("a", "b", "c")):
        assert grids.Netcdf(Dataset(names)).components == names
    for bad in (Dataset(("u", "v", "q")), Dataset(order=("xdim", "frame", "zdim", "ydim"))):
        with pytest.raises(ValueError):
            grids.Netcdf(bad)
    uneven = Dataset()
    uneven.variables["z"].values = np.ma.asarray([0.0, 1.0, 5.0])
    with pytest.raises(ValueError, match="even"):
        grids.Netcdf(uneven)


def test_window_files_vouch_for_their_arrays(spark, tmp_path):
    path, v = str(tmp_path / "w.npz"), np.random.default_rng(0).random((2, 3, 4, 5, 3), np.float32)
    grids.write_window(path, v, range(5), range(4), range(3), [0.0, 1.0], {"dataset": "d"})
    got, axes, about = grids.read_window(path)
    assert np.array_equal(got, v) and axes["time"].tolist() == [0, 1] and about == {"dataset": "d"}
    row = grids.inspect(spark, path).first()
    assert (row.frames, row.nz, row.ny, row.nx) == (2, 3, 4, 5) and row.sources["t"] == "coordinate"
    told = json.loads((tmp_path / "w.npz.json").read_text())
    told["arrays"]["x"] = "0" * 64
    (tmp_path / "w.npz.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="'x'"):
        grids.read_window(path)
    with pytest.raises(ValueError):
        grids.write_window(str(tmp_path / "n.npz"), v * np.nan, range(5), range(4), range(3), [0.0, 1.0])


def test_registry_slices_and_resume(spark, tmp_path):
    reg = tables.load_registry(spark, [{"dataset": "a", "family": "f", "path": "p", "more": 3}, {"dataset": "b", "family": "f", "path": "q"}])
    assert [r.more for r in reg.orderBy("dataset").collect()] == ["3", None]
    for bad in ([{"dataset": "a", "family": "f", "path": "p"}] * 2, [{"dataset": "a", "family": "", "path": "p"}]):
        with pytest.raises(ValueError):
            tables.load_registry(spark, bad)
    row = lambda n: ("a", "f", "development", n % 2, n, n, True, [0.0, 1.0, 2.0], [1.0], [2.0])
    df = spark.createDataFrame([row(n) for n in range(6)], tables.CACHE_SLICE)
    out, manifest = str(tmp_path / "slices"), str(tmp_path / "manifest")
    tables.write_slices(df, out, manifest)
    assert sorted(r.row for r in tables.read_slices(spark, out, manifest, "development", range(6)).collect()) == list(range(6))
    assert tables.read_slices(spark, out, manifest, columns=["row"]).columns == ["row"]
    for wrong in ({"phase": "confirmation"}, {"scales": [0, 1]}):
        with pytest.raises(Exception, match="another phase or scale"):
            tables.read_slices(spark, out, manifest, **wrong).collect()
    calls = []

    def build():
        calls.append(1)
        return df.select("row")

    for _ in range(2):
        assert experiments.resume(spark, str(tmp_path / "fold"), build).count() == 6
    assert len(calls) == 1
    victim = next((tmp_path / "fold/table").glob("*.parquet"))
    victim.unlink()
    assert experiments.resume(spark, str(tmp_path / "fold"), build).count() == 6 and len(calls) == 2
    next((tmp_path / "slices").rglob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="manifest"):
        tables.read_slices(spark, out, manifest)
    tables.write_csv(df.select("row", "family"), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "row long, family string", ["row"]).count() == 6
    tables.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "json"))
    assert '"b":null' in "".join(f.read_text() for f in (tmp_path / "json").glob("*.json"))
    roles = tables.file_manifest(spark, str(tmp_path / "csv"), "*.csv", {"table": r"\.csv$"}).select("role").distinct().collect()
    assert [r.role for r in roles] == ["table"]


def test_row_digest_sees_every_row(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    a = tables.row_digest(df, ["id", "v"], ["id"]).first()
    assert a == tables.row_digest(df.repartition(9), ["id", "v"], ["id"]).first() and a.rows == 5000
    swapped = df.withColumn("v", F.when(F.col("id") == 3, 9).otherwise(F.col("v")))
    assert a.sha256 != tables.row_digest(swapped, ["id", "v"], ["id"]).first().sha256
    assert tables.row_digest(df.limit(0), ["id"], ["id"]).first().rows == 0


def test_scale_tables_are_checked():
    ok = {"name": "a", "offset_grid_scale": 0.5, "dt_scale": 0.25, "integration_steps": 31}
    assert fields.parse_scales([ok, {**ok, "name": "b", "dt_scale": 0.5}], 32) == [("a", 0.5, 0.25, 31), ("b", 0.5, 0.5, 31)]
    for bad in ([], [ok, ok], [ok, {**ok, "name": "b"}], [{**ok, "integration_steps": 30}], [{**ok, "dt_scale": 0}], [{**ok, "offset_grid_scale": float("nan")}]):
        with pytest.raises(ValueError):
            fields.parse_scales(bad, 32)


def still(v):
    return fields.Field(np.broadcast_to(np.asarray(v, np.float32), (3, 5, 5, 5, 3)).copy(), [-2] * 3, [1] * 3, 0.0, 1.0)


def test_paths_run_both_ways():
    out, n = still([0.5, 0, 0]).both_paths(np.array([[0, 0, 0, 1.0], [9, 0, 0, 1.0], [1.9, 0, 0, 1.0]]), 0.0, 2.0, 0.3, 10)
    assert n[1] == 0 and n[0] == 9 and np.allclose(out[0, :9, 0], 0.5 * (out[0, :9, 3] - 1)) and (np.diff(out[0, :9, 3]) > 0).all()
    assert np.allclose(out[0, [0, 8], 3], [0, 2]) and n[2] == 5 and out[2, :5, 0].max() < 2


def test_arc_paths_take_as_many_steps_as_time_has():
    p, ok = still([1e-4, 0, 0]).arc_paths(np.zeros((1, 3)), 0.0, 2.0, np.array([2 / 9000]), np.array([1.9e-4]), 4)
    assert ok.tolist() == [True] and np.allclose(p[0, :, 0], 1.9e-4 * np.arange(4) / 3)
    with pytest.raises(ValueError):
        still([1, 0, 0]).arc_paths(np.zeros((1, 3)), 0.0, 2.0, np.array([0.0]), np.array([1.0]))


def test_maximin_ties_are_drawn_and_repeatable(spark):
    points = np.array([[0.0, 0], [1, 0], [-1, 0], [0, 1], [0, -1]])
    seen = {tuple(selection.farthest_points(points, 2, 0, np.random.default_rng(s))) for s in range(40)}
    assert seen == {(0, i) for i in range(1, 5)} and selection.farthest_points(points, 2, 0) == [0, 1]
    df = spark.range(200).select("id", (F.col("id") % 2 == 0).alias("y"), (F.col("id") % 3).alias("k"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    show = lambda: sorted(map(tuple, evaluation.display_rows(df, ["k"], "y", "id", ["a", "b"], [0, 0], [10, 7], 12).collect()))
    assert len(show()) == 72 and show() == show()


def test_level_metrics_equal_each_level_alone(spark):
    rows = [(i, i % 3, i % 5, i % 7 < 3, i % 4 < 2, float(i % 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a long, b long, y boolean, p boolean, s double")
    got = evaluation.level_rows(df, {"ab": ["a", "b"], "b": ["b"], "all": []}).collect()
    assert len(got) == 15 + 5 + 1
    for level, keys in (("ab", ["a", "b"]), ("b", ["b"]), ("all", [])):
        alone = {tuple(r[k] for k in keys): r for r in metrics.metric_rows(df, keys).collect()}
        for r in (r for r in got if r.level == level):
            x = alone[tuple(r[k] for k in keys)]
            assert all(r[k] is None for k in {"a", "b"} - set(keys)) and (r.tp, r.fn) == (x.tp, x.fn) and r.auroc == pytest.approx(x.auroc) and r.average_precision == pytest.approx(x.average_precision)


def test_scenes_merge_only_if_they_agree(spark):
    a = spark.createDataFrame([(1, "d", 0.5), (2, "d", 0.7)], "centre int, dataset string, score double")
    b = a.withColumn("score", F.col("score") * 2)
    assert sorted(map(tuple, evaluation.merge_scenes(a, b, ["centre"], ["dataset"], ["score"]).collect())) == [(1, "d", 0.5, 1.0), (2, "d", 0.7, 1.4)]
    for wrong in (b.withColumn("dataset", F.lit("e")), b.filter("centre = 1")):
        with pytest.raises(ValueError):
            evaluation.merge_scenes(a, wrong, ["centre"], ["dataset"], ["score"])


def test_direct_diagnostics_want_whole_pairs(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 3.0), (1, 1, 0, 1.0, 4.0), (2, 0, 0, 2.0, 5.0)], "centre int, block int, level int, dx double, s double")
    with pytest.raises(ValueError):
        evaluation.direct_diagnostics(df, [])
    whole = df.unionByName(spark.createDataFrame([(2, 1, 0, 1.0, 9.0)], df.schema))
    got = {r.centre: r for r in evaluation.direct_diagnostics(whole, [], 0.5).collect()}
    assert (got[1].least_step, got[2].least_step) == (3.0, 9.0) and got[2].least_step_selected and not got[1].rank_mean_selected


def test_projections_by_both_routes_and_their_files(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, f array<double>")
    one, two = scaling.svd_pca(x, 3), scaling.fit_pca(df, 3)
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(one, two)) and (one[1][np.arange(3), np.abs(one[1]).argmax(1)] > 0).all()
    with pytest.raises(ValueError):
        scaling.svd_pca(x, 7)
    tables.save_arrays(spark, {"mean": one[0], "rows": one[1].astype(np.float32)}, str(tmp_path / "pca"))
    got = tables.load_arrays(spark, str(tmp_path / "pca"))
    assert np.array_equal(got["mean"], one[0]) and got["rows"].dtype == np.float32
    bad = spark.read.parquet(str(tmp_path / "pca")).withColumn("sha256", F.lit("0"))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="changed"):
        tables.load_arrays(spark, str(tmp_path / "bad"))


def test_frozen_scalers_are_of_one_descriptor(spark):
    df = spark.createDataFrame([(1, [3.0, 5.0])], "id long, f array<double>")
    scaler = spark.createDataFrame([([1.0, 1.0], [2.0, 4.0], "d")], "mean array<double>, scale array<double>, descriptor_id string")
    assert scaling.transform_queries(df, scaler, "d").first().f == [1.0, 1.0]
    with pytest.raises(Exception, match="another descriptor"):
        scaling.transform_queries(df, scaler, "e").collect()


def test_a_slice_from_seeds_to_features(spark, tmp_path):
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, 9)] * 3, indexing="ij")
    swirl = np.stack([-y * (1 + x * x), x, np.full_like(x, 0.1)], -1)
    field = fields.Field(np.stack([swirl] * 15), [-1] * 3, [0.25] * 3, 0.0, 0.5)
    seeds = fields.seed_grid(spark, [-1] * 3, [1] * 3, [6, 6, 3], 0.3, 0.0)
    scales = fields.scale_table(spark, [[[0.1, 0.2], [0.05, 0.1], [1.0, 2.0]]])
    about = {"dataset": "d", "family": "f", "phase": "development", "source_ordinal": 2}
    got = slices.build_slice(spark, field, seeds, scales, 1, 12, about, share=0.5)
    tables.write_slices(got, str(tmp_path / "s"), str(tmp_path / "m"))
    rows = tables.read_slices(spark, str(tmp_path / "s"), str(tmp_path / "m"), "development", range(8)).toPandas()
    assert 80 < len(rows) <= 108 and rows["row"].is_unique and set(rows["scale_id"]) == set(range(8)) and rows["reference"].any() and not rows["reference"].all()
    paths = np.stack(rows["raw_features"]).reshape(-1, 7, 32, 3).astype(np.float32)
    assert np.allclose(np.stack(rows["features"]), descriptors.path_descriptor(paths), atol=1e-3) and (paths[:, 0, 0] == 0).all()
    assert np.stack(rows["features"]).shape[1] == 161 and descriptors.dimensionless_descriptor(paths[:3]).shape == (3, 161)
    with pytest.raises(ValueError, match="frames"):
        slices.build_slice(spark, field, seeds, scales, 5, 12, about)


def test_numpy_assignment_by_rows(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("id")).repartition(4)
    got = [r.scale for r in slices.numpy_assigned(df, "id", 7, 11).orderBy("id").collect()]
    assert got == fields.numpy_assignment(50, 7, 11).tolist()


def steady_file(path, binary, kind="float", field=False, shift=0.0):
    x, y, z = np.array([0.0, 1, 3, 4]), np.array([0.0, 2, 4]), np.array([0.0, 1, 2])
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    points = np.stack([xx + shift * yy, yy, zz], -1)
    velocity = np.stack([xx + yy, 2 * yy - zz, zz * xx], -1)
    dtype = ">f4" if kind == "float" else ">f8"
    body = lambda a: a.astype(dtype).tobytes() + b"\n" if binary else (" ".join(map(repr, a.ravel().tolist())) + "\n").encode()
    n = xx.size
    head = f"# vtk DataFile Version 3.0\nt\n{'BINARY' if binary else 'ASCII'}\nDATASET STRUCTURED_GRID\nDIMENSIONS 4 3 3\nPOINTS {n} {kind}\n".encode()
    name = f"FIELD FieldData 1\nvelocity 3 {n} {kind}\n" if field else f"SCALARS p {kind} 1\nLOOKUP_TABLE default\n"
    data = name.encode() + (b"" if field else body(np.arange(n)) + f"VECTORS velocity {kind}\n".encode())
    path.write_bytes(head + body(points) + f"POINT_DATA {n}\n".encode() + data + body(velocity))
    return str(path), points, velocity


@pytest.mark.parametrize("binary,kind,field", [(True, "float", False), (False, "double", False), (True, "double", True)])
def test_structured_grids_are_read_and_interpolated(tmp_path, binary, kind, field):
    path, points, velocity = steady_file(tmp_path / "g.vtk", binary, kind, field)
    p, v = steady.read_structured(path)
    assert np.allclose(p, points) and np.allclose(v, velocity)
    g = steady.load_steady(path, 96, 0.25)
    at = np.array([[2.0, 1.0, 0.5], [3.5, 3.0, 1.5], [0.0, 0.0, 0.0], [4.0, 4.0, 2.0]])
    assert np.allclose(g(at), np.stack([at[:, 0] + at[:, 1], 2 * at[:, 1] - at[:, 2], at[:, 2] * at[:, 0]], -1), atol=1e-5)
    assert [len(a) for a in g.output] == [4, 3, 3] and g.output[0].tolist() == [1.0, 1 + 2 / 3, 1 + 4 / 3, 3.0]
    assert [len(a) for a in steady.load_steady(path, 2, 0.25).output] == [2, 2, 2]


def test_structured_grids_fail_closed(tmp_path):
    path, points, velocity = steady_file(tmp_path / "s.vtk", True, shift=0.5)
    with pytest.raises(ValueError, match="separable"):
        steady.load_steady(path)
    straight = points.copy()
    straight[..., 0] -= 0.5 * straight[..., 1]
    for p, v, about in ((straight[:, ::-1], velocity, "separable|increase"), (straight, velocity * np.nan, "finite")):
        with pytest.raises(ValueError, match=about):
            steady.SteadyGrid(p, v)
    (tmp_path / "x.vtk").write_bytes(b"# vtk DataFile Version 3.0\nt\nASCII\nDATASET POLYDATA\n")
    with pytest.raises(ValueError, match="structured"):
        steady.read_structured(str(tmp_path / "x.vtk"))


def test_unsteady_frames_are_what_the_observer_sees(spark, tmp_path):
    path, *_ = steady_file(tmp_path / "g.vtk", True)
    g = steady.load_steady(path, 96, 0.2)
    rows = steady.unsteady_frames(spark, g, 3, 4, 20).orderBy("t", "iz", "iy", "ix").collect()
    times = np.linspace(0, 1, 20)
    q = fields.observer_schedule(times, g.low, g.high)
    turn, moved = fields.observer_frames(q, times[1])
    want = fields.moving_view(g.points, g, q[3:7], turn[3:7], moved[3:7])
    assert len(rows) == 4 * len(g.points) and np.allclose([[r.u, r.v, r.w] for r in rows], want.reshape(-1, 3), atol=1e-6)
    with pytest.raises(ValueError, match="frames"):
        steady.unsteady_frames(spark, g, 18, 4, 20)
    with pytest.raises(ValueError, match="outside"):
        fields.moving_view(g.points + 10, g, q[:1], turn[:1], moved[:1], (g.low, g.high))


def test_one_generator_draws_a_bounded_number(spark):
    counts = spark.createDataFrame([(0, 50, 40), (1, 0, 9)], "k int, n0 long, n1 long")
    with pytest.raises(ValueError, match="80 rows"):
        selection.sequential_draws(counts, ["k"], 100, 5, limit=79)
    assert selection.sequential_draws(counts, ["k"], 100, 5, limit=80).count() == 80


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from plumbline.plans.scratch import shared_folder

    conf = lambda v: SimpleNamespace(get=lambda key, default=None: v)
    session = lambda master, v: SimpleNamespace(conf=conf(v), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(v)))
    assert shared_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session("local[4]", None)).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master, None))
