"""A data source for gridded velocity windows: one partition a frame, long rows (t, iz, iy, ix, u, v, w).

``spark.dataSource.register(GridWindow)``, then ``spark.read.format("grid_window").option("start", 3).option("frames", 8).option("max_dim", 64).load(path)``.
Files are ``.npz`` windows (a member a frame, x, y, z, time), or netCDF where that library is installed. Start, frames, stride and the axes that may
be counted (``index``) are options of the reader: planning reads the axes, a task its own frame. Paths must be visible to the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names under which files hold their axes and components.
AXES = {"x": ("x", "xdim"), "y": ("y", "ydim"), "z": ("z", "zdim"), "t": ("t", "time", "tdim")}
COMPONENTS = (("u", "v", "w"), ("velocity_x", "velocity_y", "velocity_z"), ("Component1", "Component2", "Component3"), ("a", "b", "c"))


def resolve(names, kind: str) -> str:
    """The file's own name of an axis; none or several are an error."""
    found = [n for n in names if n.lower() in AXES[kind]]
    if len(found) != 1:
        raise ValueError(f"axis {kind}: {found or 'absent'}")
    return found[0]


def checked_axis(values: np.ndarray, name: str) -> np.ndarray:
    v = np.asarray(np.ma.filled(np.ma.asarray(values, float), np.nan))
    d = np.diff(v)
    if v.ndim != 1 or len(v) < 2 or not np.isfinite(v).all() or (d <= 0).any() or not np.allclose(d, d[0], rtol=1e-4, atol=1e-8):
        raise ValueError(f"axis {name} must be finite, increasing and even, with two values at least")
    return v


class NpzWindow:
    """A window file: one member a frame, so that a frame is read without the others, and the axes. Whole ``velocity`` members are read too."""

    def __init__(self, path: str):
        self.file = np.load(path, allow_pickle=False)
        self.whole = "velocity" in self.file.files
        axes = {k: self.file["time" if k == "t" else k] for k in "tzyx"}
        self.axes, self.units = {k: checked_axis(v, k) for k, v in axes.items()}, dict.fromkeys("tzyx", "attribute_absent")
        self.sources, self.components = dict.fromkeys("tzyx", "coordinate"), ("u", "v", "w")

    def frame(self, i: int, step: tuple[int, int, int]) -> np.ndarray:
        v = self.file["velocity"][i] if self.whole else self.file[f"frame{i:06d}"]
        return v[:: step[0], :: step[1], :: step[2]]

    def close(self):
        self.file.close()


class Netcdf:
    """A file of the netCDF library; only axes are read until a frame is asked for. index: axes that may be counted where they have no coordinate."""

    def __init__(self, dataset, index: str = ""):
        if len(set(index)) != len(index) or any(a not in "xyzt" for a in index):
            raise ValueError("index must be unique axes of x, y, z, t")
        self.data = dataset
        self.names = {k: resolve(dataset.dimensions, k) for k in "tzyx"}
        self.axes, self.sources, self.units = {}, {}, {}
        for k, dimension in self.names.items():
            owner = next((n for n in dict.fromkeys([dimension, *[v for v in dataset.variables if v.lower() in AXES[k]]]) if n in dataset.variables and dataset.variables[n].dimensions == (dimension,)), None)
            try:
                if owner is None:
                    raise ValueError(f"dimension {dimension} has no coordinate variable")
                values = np.ma.asarray(dataset.variables[owner][:])
                if values.count() < values.size or not np.isfinite(values).all():
                    raise ValueError(f"coordinate {owner} holds values that are masked or not finite")
                self.axes[k], self.sources[k] = np.asarray(values, float), "coordinate"
                self.units[k] = str(dataset.variables[owner].getncattr("units")) if "units" in dataset.variables[owner].ncattrs() else "attribute_absent"
            except ValueError:
                if k not in index:
                    raise
                self.axes[k], self.sources[k], self.units[k] = np.arange(len(dataset.dimensions[dimension]), dtype=float), "explicit_index_fallback", "index_coordinate_dimensionless"
            checked_axis(self.axes[k], k)
        self.components = next((c for c in COMPONENTS if all(n in dataset.variables for n in c)), None)
        if self.components is None:
            raise ValueError(f"no velocity components; any of {COMPONENTS}")

    def frame(self, i: int, step: tuple[int, int, int]) -> np.ndarray:
        cut = {self.names["t"]: slice(i, i + 1), **{self.names[k]: slice(None, None, s) for k, s in zip("zyx", step)}}
        parts = []
        for n in self.components:
            v = self.data.variables[n]
            if sorted(v.dimensions) != sorted(self.names.values()):
                raise ValueError(f"component {n} must have the dimensions {list(self.names.values())}")
            got = np.ma.asarray(v[tuple(cut[d] for d in v.dimensions)])
            if got.count() < got.size:
                raise ValueError(f"component {n} holds masked values")
            parts.append(np.transpose(np.asarray(got, np.float32), [v.dimensions.index(self.names[k]) for k in "tzyx"])[0])
        return np.stack(parts, -1)

    def close(self):
        self.data.close()


def open_window(path: str, index: str = ""):
    """The file's axes, checked, and a reader of single frames."""
    if path.endswith(".npz"):
        return NpzWindow(path)
    try:
        import netCDF4
    except ImportError as error:
        raise RuntimeError("netCDF files need the netCDF4 library; stage them as .npz or Parquet") from error
    return Netcdf(netCDF4.Dataset(path), index)


def strides(shape, max_dim: int) -> list[int]:
    return [math.ceil(n / max_dim) if max_dim else 1 for n in shape]


class Frame(InputPartition):
    def __init__(self, path: str, frame: int):
        self.path, self.frame = path, frame


class GridReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.index = options["path"], options.get("index", "")
        self.start, self.frames, self.max_dim = int(options.get("start", 0)), int(options.get("frames", 0)), int(options.get("max_dim", 0))

    def partitions(self):
        w = open_window(self.path, self.index)  # axes only
        n = len(w.axes["t"])
        w.close()
        count = self.frames or n - self.start
        if self.start < 0 or count < 1 or self.start + count > n:
            raise ValueError(f"frames {self.start} to {self.start + count} of {n}")
        return [Frame(self.path, i) for i in range(self.start, self.start + count)]

    def read(self, partition):
        import pyarrow as pa

        w = open_window(partition.path, self.index)
        v = np.asarray(w.frame(partition.frame, strides([len(w.axes[k]) for k in "zyx"], self.max_dim)), np.float32)
        t = float(w.axes["t"][partition.frame])
        w.close()
        if not np.isfinite(v).all():
            raise ValueError("the field holds values that are not finite")
        iz, iy, ix = (a.ravel().astype(np.int32) for a in np.indices(v.shape[:3]))
        columns = [pa.array(np.full(len(ix), t)), *map(pa.array, (iz, iy, ix)), *[pa.array(np.ascontiguousarray(v[..., k]).ravel()) for k in range(3)]]
        yield pa.RecordBatch.from_arrays(columns, names=["t", "iz", "iy", "ix", "u", "v", "w"])


class GridWindow(DataSource):
    @classmethod
    def name(cls):
        return "grid_window"

    def schema(self):
        return "t double, iz int, iy int, ix int, u float, v float, w float"

    def reader(self, schema):
        return GridReader(self.options)


def inspect(spark, path: str, index: str = ""):
    """One row: the file's sizes, time range, components, and where each axis and its unit come from. No field is read."""
    w = open_window(path, index)
    t, z, y, x = (len(w.axes[k]) for k in "tzyx")
    row = (path, t, z, y, x, float(w.axes["t"][0]), float(w.axes["t"][-1]), list(w.components), dict(w.sources), dict(w.units))
    w.close()
    return spark.createDataFrame([row], "path string, frames int, nz int, ny int, nx int, first double, last double, components array<string>, sources map<string,string>, units map<string,string>")


def write_window(path: str, velocity: np.ndarray, x, y, z, time, about: dict | None = None) -> dict[str, str]:
    """Writes a window file, a member a frame, that must not exist yet, and beside it ``<path>.json`` with the arrays' digests and ``about``.

    Both are written under other names first, so that a file with its own name is whole.
    """
    import json
    import os

    from plumbline.sources.tables import array_digest

    axes = {"x": np.asarray(x, float), "y": np.asarray(y, float), "z": np.asarray(z, float), "time": np.asarray(time, float)}
    for name, axis in axes.items():
        checked_axis(axis, name)
    v = np.asarray(velocity, np.float32)
    if v.shape != (*(len(axes[k]) for k in ("time", "z", "y", "x")), 3) or not np.isfinite(v).all():
        raise ValueError("velocity must be finite, of shape (time, z, y, x, 3)")
    digests = {"velocity": array_digest(v), **{k: array_digest(a) for k, a in axes.items()}}
    if os.path.exists(path) or os.path.exists(f"{path}.json"):
        raise FileExistsError(path)
    with open(f"{path}.part", "xb") as f:
        np.savez_compressed(f, **{f"frame{i:06d}": frame for i, frame in enumerate(v)}, **axes)
    with open(f"{path}.json.part", "x", encoding="utf-8") as f:
        json.dump({"arrays": digests, "about": about or {}}, f, sort_keys=True, separators=(",", ":"))
    for name in (f"{path}.json", path):
        os.link(f"{name}.part", name)  # fails where the name is taken
        os.unlink(f"{name}.part")
    return digests


def read_window(path: str) -> tuple[np.ndarray, dict[str, np.ndarray], dict]:
    """velocity, axes and about of a window, after a check of every digest in its JSON file."""
    import json

    from plumbline.sources.tables import array_digest

    with open(f"{path}.json", encoding="utf-8") as f:
        told = json.load(f)
    w = NpzWindow(path)
    v = np.stack([w.frame(i, (1, 1, 1)) for i in range(len(w.axes["t"]))])
    found = {"velocity": array_digest(v), **{("time" if k == "t" else k): array_digest(a) for k, a in w.axes.items()}}
    w.close()
    wrong = [k for k, d in found.items() if told["arrays"].get(k) != d]
    if wrong:
        raise ValueError(f"arrays changed: {wrong}")
    return v, {("time" if k == "t" else k): a for k, a in w.axes.items()}, told["about"]
