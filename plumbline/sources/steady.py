"""Steady structured grids from legacy VTK files, and the unsteady series that a moving rigid observer sees of them.

The file format is the legacy one: a header of four lines, ``DATASET STRUCTURED_GRID``, ``DIMENSIONS``, ``POINTS`` and point data with three-component
``velocity`` (``VECTORS``, or a field array), as text or big-endian binary. No library for it is needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.fields import FIELD_LIMIT, moving_view, observer_frames, observer_schedule
from plumbline.plans.scratch import ship

# Type names of the format.
KINDS = {"float": ">f4", "double": ">f8", "int": ">i4", "long": ">i8", "short": ">i2", "char": ">i1", "unsigned_char": ">u1", "unsigned_int": ">u4"}


class _Cursor:
    """Reads lines and arrays of a legacy file."""

    def __init__(self, data: bytes):
        self.data, self.at, self.binary = data, 0, False

    def line(self) -> str | None:
        while self.at < len(self.data):
            end = self.data.find(b"\n", self.at)
            end = len(self.data) if end < 0 else end
            text, self.at = self.data[self.at : end].decode("latin-1").strip(), end + 1
            if text:
                return text
        return None

    def array(self, count: int, kind: str) -> np.ndarray:
        if kind not in KINDS:
            raise ValueError(f"unknown type {kind}")
        if self.binary:
            size = count * np.dtype(KINDS[kind]).itemsize
            out = np.frombuffer(self.data, KINDS[kind], count, self.at)
            self.at += size
            return out.astype(float)
        words: list[str] = []
        while len(words) < count:
            text = self.line()
            if text is None:
                raise ValueError("the file ends within an array")
            words += text.split()
        return np.array(words, float)


def read_structured(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Points and velocity, (z, y, x, 3) each, of a legacy structured grid file."""
    with open(path, "rb") as f:
        c = _Cursor(f.read())
    if not (c.line() or "").startswith("# vtk DataFile"):
        raise ValueError("not a legacy file")
    c.line()  # the title
    c.binary = (c.line() or "").upper() == "BINARY"
    shape = points = velocity = None
    count = 0
    while (text := c.line()) is not None:
        words = text.split()
        key = words[0].upper()
        if key == "DATASET" and words[1].upper() != "STRUCTURED_GRID":
            raise ValueError(f"a structured grid is needed, not {words[1]}")
        elif key == "DIMENSIONS":
            shape = tuple(int(n) for n in words[3:0:-1])
        elif key == "POINTS":
            points = c.array(3 * int(words[1]), words[2].lower())
        elif key == "POINT_DATA":
            count = int(words[1])
        elif key == "VECTORS":
            got = c.array(3 * count, words[2].lower())
            velocity = got if words[1] == "velocity" else velocity
        elif key == "SCALARS":
            parts = int(words[3]) if len(words) > 3 else 1
            c.line()  # the lookup table's name
            c.array(parts * count, words[2].lower())
        elif key == "FIELD":
            for _ in range(int(words[2])):
                name, parts, rows, kind = (c.line() or "").split()
                got = c.array(int(parts) * int(rows), kind.lower())
                velocity = got if name == "velocity" and int(parts) == 3 else velocity
    if shape is None or len(shape) != 3 or min(shape) < 2 or points is None:
        raise ValueError("no three-dimensional point grid")
    if velocity is None or velocity.size != 3 * np.prod(shape) or points.size != velocity.size:
        raise ValueError("no point array velocity with three components")
    return points.reshape(*shape, 3), velocity.reshape(*shape, 3)


class SteadyGrid:
    """A field on separable axes, which may be uneven, linear between them; and the cropped regular grid that series are made on."""

    def __init__(self, points: np.ndarray, velocity: np.ndarray, max_dim: int = 96, crop: float = 0.10):
        if max_dim < 2 or not 0 < crop < 0.5:
            raise ValueError("max_dim must be 2 at least, crop between 0 and 0.5")
        if not (np.isfinite(points).all() and np.isfinite(velocity).all()):
            raise ValueError("the grid holds values that are not finite")
        self.axes = [points[0, 0, :, 0], points[0, :, 0, 1], points[:, 0, 0, 2]]
        even = np.stack(np.meshgrid(*self.axes[::-1], indexing="ij")[::-1], -1)
        if not np.allclose(points, even, rtol=0, atol=1e-6):
            raise ValueError("the grid isn't separable into three axes")
        if any((np.diff(a) <= 0).any() for a in self.axes):
            raise ValueError("coordinates must increase")
        self.velocity = np.asarray(velocity, np.float32)
        if self.velocity.nbytes > FIELD_LIMIT:
            raise ValueError(f"a grid of {self.velocity.nbytes} bytes is beyond the {FIELD_LIMIT} that may be broadcast")
        self.low, self.high = (np.array([a[i] for a in self.axes], float) for i in (0, -1))
        stride = [max(1, -(-len(a) // max_dim)) for a in self.axes]
        count = [-(-len(a) // s) for a, s in zip(self.axes, stride)]
        margin = crop * (self.high - self.low)
        self.output = [np.linspace(a, b, n) for a, b, n in zip(self.low + margin, self.high - margin, count)]

    def __call__(self, p: np.ndarray) -> np.ndarray:
        cell, share = [], []
        for k, a in enumerate(self.axes):
            i = np.clip(np.searchsorted(a, p[:, k], "right") - 1, 0, len(a) - 2)
            cell.append(i)
            share.append((p[:, k] - a[i]) / (a[i + 1] - a[i]))
        out = np.zeros((len(p), 3))
        for corner in range(8):
            at = [c + (corner >> k & 1) for k, c in enumerate(cell)]
            weight = np.prod([s if corner >> k & 1 else 1 - s for k, s in enumerate(share)], axis=0)
            out += weight[:, None] * self.velocity[at[2], at[1], at[0]]
        return out

    @property
    def points(self) -> np.ndarray:
        """The output grid's points, x fastest."""
        z, y, x = np.meshgrid(*self.output[::-1], indexing="ij")
        return np.stack([x.ravel(), y.ravel(), z.ravel()], -1)


def load_steady(path: str, max_dim: int = 96, crop: float = 0.10) -> SteadyGrid:
    return SteadyGrid(*read_structured(path), max_dim, crop)


def unsteady_frames(spark: SparkSession, grid: SteadyGrid, start: int, count: int, frames: int = 159, duration: float = 1.0) -> DataFrame:
    """t, iz, iy, ix, u, v, w of frames of the series: a task a frame, the grid broadcast, whose size is checked.

    A frame in which the observer would look outside the grid is an error.
    """
    if frames < 2 or count < 2 or start < 0 or start + count > frames or not (np.isfinite(duration) and duration > 0):
        raise ValueError(f"frames {start} to {start + count} of {frames}, over {duration}")
    ship(spark)
    times = np.linspace(0.0, duration, frames)
    parameters = observer_schedule(times / duration, grid.low, grid.high) / duration
    turn, moved = observer_frames(parameters, float(times[1] - times[0]))
    shared = spark.sparkContext.broadcast((grid, times, parameters, turn, moved))

    def run(batches):
        import pandas as pd

        grid, times, parameters, turn, moved = shared.value
        points = grid.points
        iz, iy, ix = (a.ravel().astype(np.int32) for a in np.indices([len(a) for a in grid.output[::-1]]))
        for batch in batches:
            for i in batch["id"]:
                v = moving_view(points, grid, parameters[i : i + 1], turn[i : i + 1], moved[i : i + 1], (grid.low, grid.high))[0]
                yield pd.DataFrame({"t": times[i], "iz": iz, "iy": iy, "ix": ix, "u": v[:, 0], "v": v[:, 1], "w": v[:, 2]})

    return spark.range(start, start + count, 1, count).mapInPandas(run, "t double, iz int, iy int, ix int, u float, v float, w float")
