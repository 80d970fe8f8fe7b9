"""Fields on regular grids: seeds, samples, curl, paths, rigid observers.

Long tables (one row a grid point) serve stencils and sampling by joins; integration, which is sequential in time, runs vectorised over
seeds inside Arrow batches, with the field as a broadcast whose size is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELD_LIMIT = 1 << 30


def seed_grid(spark: SparkSession, low: Sequence[float], high: Sequence[float], shape: Sequence[int], fraction: float, offset: float, phase: Sequence[float] | None = None) -> DataFrame:
    """A grid of seeds inside the domain by a margin: seed_id (x fastest), x, y, z. With a phase, cell centres moved by it; else ends included."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    margin = np.maximum(fraction * (high - low), offset * 1.01)
    if (2 * margin >= high - low).any():
        raise ValueError("the margin leaves no room")
    a, b = low + margin, high - margin
    nx, ny, nz = shape
    place = [F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))]
    cols = []
    for k, n in enumerate(shape):
        at = (place[k] + F.lit(0.5 + phase[k])) * F.lit((b[k] - a[k]) / n) if phase else place[k] * F.lit((b[k] - a[k]) / (n - 1))
        cols.append((F.lit(float(a[k])) + at).alias("xyz"[k]))
    return spark.range(nx * ny * nz).select(F.col("id").alias("seed_id"), *cols)


def scale_table(spark: SparkSession, blocks: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """scale_id, block, dx, ds, arc: the product of three axes for each block, ids running on. Repeated tuples are an error."""
    rows = [(b, float(x), float(s), float(a)) for b, (dx, ds, arc) in enumerate(blocks) for x in dx for s in ds for a in arc]
    if len({r[1:] for r in rows}) < len(rows):
        raise ValueError("scale tuples repeat")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "scale_id int, block int, dx double, ds double, arc double")


def balanced_assignment(df: DataFrame, identity: str, count: int, seed: int, keys: Sequence[str] = (), name: str = "scale") -> DataFrame:
    """Each of count values as often as any other, give or take one, in a hash order of ids."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")))
    return df.withColumn(name, ((F.row_number().over(Window.partitionBy(*keys).orderBy(order, identity)) - 1) % count).cast("int"))


def numpy_assignment(n: int, count: int, seed: int) -> np.ndarray:
    """The same law with NumPy's generator: a permutation, dealt round."""
    out = np.empty(n, np.int32)
    out[np.random.default_rng(seed).permutation(n)] = np.arange(n) % count
    return out


def trilinear(points: DataFrame, grid: DataFrame, identity: str, low: Sequence[float], spacing: Sequence[float], shape: Sequence[int], value: str = "v", tolerance: float = 1e-5) -> DataFrame:
    """Values at points from a long grid (ix, iy, iz, value): eight corners a point meet the grid in one equi-join. Points outside are dropped."""
    out = points
    for k, c in enumerate("xyz"):
        at = (F.col(c) - F.lit(float(low[k]))) / F.lit(float(spacing[k]))
        out = out.withColumn(f"__g{c}", at).filter((at >= -tolerance) & (at <= shape[k] - 1 + tolerance))
        cell = F.greatest(F.lit(0), F.least(F.floor(F.col(f"__g{c}")), F.lit(shape[k] - 2))).cast("int")
        out = out.withColumn(f"__c{c}", cell).withColumn(f"__w{c}", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"__g{c}") - cell)))
    corners = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for k in (0, 1) for j in (0, 1) for i in (0, 1)])
    spread = out.withColumn("__k", F.explode(corners))
    weight = F.lit(1.0)
    for c in "xyz":
        weight = weight * F.when(F.col(f"__k.{c}") == 1, F.col(f"__w{c}")).otherwise(1 - F.col(f"__w{c}"))
    spread = spread.select(identity, *[(F.col(f"__c{c}") + F.col(f"__k.{c}")).alias(f"i{c}") for c in "xyz"], weight.alias("__w"))
    return spread.join(grid.select("ix", "iy", "iz", value), ["ix", "iy", "iz"]).groupBy(identity).agg(F.sum(F.col("__w") * F.col(value)).alias(value))


def derivative(value: str, keys: Sequence[str], axis: str, spacing: float) -> Column:
    """Central difference along an axis, one-sided at its ends."""
    w = Window.partitionBy(*keys).orderBy(axis)
    back, on = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(back.isNull(), (on - F.col(value)) / spacing).when(on.isNull(), (F.col(value) - back) / spacing).otherwise((on - back) / (2 * spacing))


def curl(df: DataFrame, keys: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """cx, cy, cz of u, v, w on (ix, iy, iz); lines of the grid are the windows' partitions."""
    dx, dy, dz = spacing

    def d(c: str, axis: str, h: float) -> Column:
        return derivative(c, [*keys, *[a for a in ("ix", "iy", "iz") if a != axis]], axis, h)

    return df.withColumn("cx", d("w", "iy", dy) - d("v", "iz", dz)).withColumn("cy", d("u", "iz", dz) - d("w", "ix", dx)).withColumn("cz", d("v", "ix", dx) - d("u", "iy", dy))


def group_centred_norm(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "deviation") -> DataFrame:
    """The length of a vector less its group's mean. The mean is aggregated first and joined back: no group meets in a window."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    j = df.join(means, list(keys)) if keys else df.join(F.broadcast(means), F.lit(True))
    square = sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in columns), F.lit(0.0))
    return j.withColumn(name, F.sqrt(square)).drop(*[f"__{c}" for c in columns])


def label_at_points(volume: DataFrame, points: DataFrame, identity: str, low: Sequence[float], step: Sequence[float], shape: Sequence[int], spacing: Sequence[float], share: float = 0.95) -> DataFrame:
    """deviation and label of points: the curl's deviation from its mean, sampled at each, against the grid's own percentile.

    low, step and shape place the grid for the points; spacing is that of its derivatives.
    """
    from plumbline.operators.prefix import quantiles

    grid = group_centred_norm(curl(volume, [], spacing), [], ["cx", "cy", "cz"])
    cut = quantiles(grid, [], "deviation", {"__cut": share})  # one row
    found = trilinear(points, grid, identity, low, step, shape, "deviation").join(F.broadcast(cut), F.lit(True))
    return found.select(identity, "deviation", (F.col("deviation") >= F.col("__cut")).alias("label"))


def parse_scales(rows: Sequence[dict], samples: int) -> list[tuple[str, float, float, int]]:
    """(name, offset, time step, steps) of a scale table: names and tuples unique, sizes positive and finite, steps enough for the samples."""
    out = [(str(r["name"]), float(r["offset_grid_scale"]), float(r["dt_scale"]), int(r["integration_steps"])) for r in rows]
    if not out or samples < 2:
        raise ValueError("a table needs a scale, and paths two samples")
    for name, *sizes, steps in out:
        if not all(np.isfinite(x) and x > 0 for x in sizes):
            raise ValueError(f"{name}: sizes must be positive and finite")
        if steps < samples - 1:
            raise ValueError(f"{name}: {steps} steps can't give {samples} samples")
    if len({r[0] for r in out}) < len(out) or len({r[1:] for r in out}) < len(out):
        raise ValueError("names or scale tuples repeat")
    return out


def physical_scales(scales: DataFrame, spacing: Sequence[float], interval: float) -> DataFrame:
    """dx, dt and arc of scales in grid units: lengths times the grid's least spacing, times by the interval between frames."""
    h = float(min(np.asarray(spacing, np.float32).astype(float)))
    if not (h > 0 and interval > 0):
        raise ValueError("spacing and interval must be positive")
    return scales.withColumns({"dx": F.col("dx") * h, "dt": F.col("ds") * float(interval), "arc": F.col("arc") * h})


def kinematics(velocity: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """|curl|, |strain|, divergence and Q of (rows, 7, 3) velocities at a cross of half-width dx, as float32."""
    v = np.asarray(velocity, float)
    g = np.stack([v[:, 1] - v[:, 2], v[:, 3] - v[:, 4], v[:, 5] - v[:, 6]], axis=2) / (2 * np.asarray(dx, float))[:, None, None]
    s, r = (g + g.transpose(0, 2, 1)) / 2, (g - g.transpose(0, 2, 1)) / 2
    s2, r2 = (s * s).sum((1, 2)), (r * r).sum((1, 2))
    return np.stack([np.sqrt(2 * r2), np.sqrt(s2), np.trace(g, axis1=1, axis2=2), (r2 - s2) / 2], axis=1).astype(np.float32)


class Field:
    """A velocity window (time, z, y, x, 3) with its origin and steps."""

    def __init__(self, velocity: np.ndarray, low: Sequence[float], spacing: Sequence[float], start: float, interval: float):
        self.velocity = np.ascontiguousarray(velocity, np.float32)
        if self.velocity.nbytes > FIELD_LIMIT:
            raise ValueError(f"a window of {self.velocity.nbytes} bytes is beyond the {FIELD_LIMIT} that may be broadcast; cut it in time or space")
        self.low, self.spacing, self.start, self.interval = np.asarray(low, float), np.asarray(spacing, float), start, interval
        self.shape = np.array(velocity.shape[3:0:-1])
        self.high = self.low + self.spacing * (self.shape - 1)

    def inside(self, p: np.ndarray) -> np.ndarray:
        return ((p >= self.low) & (p <= self.high)).all(1)

    def sample(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Linear in space and time, held at the ends."""
        at = (p - self.low) / self.spacing
        cell = np.clip(np.floor(at).astype(int), 0, self.shape - 2)
        w = np.clip(at - cell, 0, 1)
        f = np.clip((np.broadcast_to(t, len(p)) - self.start) / self.interval, 0, len(self.velocity) - 1)
        frame = np.minimum(f.astype(int), max(0, len(self.velocity) - 2))
        wt = f - frame
        out = np.zeros((len(p), 3))
        for q in range(16):
            i, j, k, n = q & 1, q >> 1 & 1, q >> 2 & 1, q >> 3
            if n and len(self.velocity) == 1:
                continue
            weight = np.where(i, w[:, 0], 1 - w[:, 0]) * np.where(j, w[:, 1], 1 - w[:, 1]) * np.where(k, w[:, 2], 1 - w[:, 2]) * np.where(n, wt, 1 - wt)
            out += weight[:, None] * self.velocity[frame + n, cell[:, 2] + k, cell[:, 1] + j, cell[:, 0] + i]
        return out

    def step(self, p: np.ndarray, t: np.ndarray, h: np.ndarray, method: str = "rk4") -> tuple[np.ndarray, np.ndarray]:
        """One step of all points; and which steps had every stage inside the domain."""
        h = np.broadcast_to(h, len(p))[:, None]
        a = self.sample(p, t)
        ok = self.inside(p)
        if method == "euler":
            return p + h * a, ok
        total = a.copy()
        for share, weight in ((0.5, 2), (0.5, 2), (1.0, 1)):
            q = p + share * h * a
            ok &= self.inside(q)
            a = self.sample(q, t + share * h[:, 0])
            total += weight * a
        return p + h * total / 6, ok & np.isfinite(total).all(1)

    def paths(self, seeds: np.ndarray, t0: float, h: float, steps: int, method: str = "rk4") -> tuple[np.ndarray, np.ndarray]:
        """(rows, steps + 1, 4) points and how many of them hold; a path ends before it leaves."""
        out = np.zeros((len(seeds), steps + 1, 4))
        p, t, alive = np.array(seeds, float), np.full(len(seeds), float(t0)), self.inside(np.asarray(seeds, float))
        out[:, 0, :3], out[:, 0, 3], n = p, t, alive.astype(int)
        for k in range(steps):
            q, ok = self.step(p, t, h, method)
            alive = alive & ok & self.inside(q)
            p, t = np.where(alive[:, None], q, p), np.where(alive, t + h, t)
            out[:, k + 1, :3], out[:, k + 1, 3] = p, t
            n += alive
        return out, n

    def both_paths(self, seeds: np.ndarray, first: float, last: float, h: float, steps: int, method: str = "rk4") -> tuple[np.ndarray, np.ndarray]:
        """Paths through (rows, 4) seeds back to the time first and on to last, in order of time: (rows, 2 * steps + 1, 4) points, and how many
        hold. Each direction has up to steps steps, the last one cut to the end of time; a path ends before it leaves the domain."""
        seeds = np.asarray(seeds, float)
        out, count = np.zeros((len(seeds), 2 * steps + 1, 4)), np.zeros(len(seeds), np.int64)
        sides = []
        for sign, end in ((-1.0, first), (1.0, last)):
            p, t = seeds[:, :3].copy(), seeds[:, 3].copy()
            alive, side = self.inside(p) & (t >= first) & (t <= last), [[] for _ in seeds]
            for _ in range(steps):
                alive = alive & (sign * (end - t) > 1e-12)
                if not alive.any():
                    break
                dt = sign * np.minimum(h, sign * (end - t))
                q, ok = self.step(p, t, dt, method)
                alive = alive & ok & self.inside(q)
                p, t = np.where(alive[:, None], q, p), np.where(alive, t + dt, t)
                for i in np.flatnonzero(alive):
                    side[i].append((*p[i], t[i]))
            sides.append(side)
        inside = self.inside(seeds[:, :3]) & (seeds[:, 3] >= first) & (seeds[:, 3] <= last)
        for i, (back, on) in enumerate(zip(*sides)):
            path = [*back[::-1], *([tuple(seeds[i])] if inside[i] else []), *on]
            out[i, : len(path)], count[i] = np.array(path).reshape(-1, 4), len(path)
        return out, count

    def arc_paths(self, seeds: np.ndarray, t0: float, horizon: float, h: np.ndarray, target: np.ndarray, samples: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(rows, samples, 4) points at equal arc lengths up to each target; and which paths reached it before they left or time ran out.

        The last step of a path is cut to the horizon; no path can need more steps than the time takes at the smallest step.
        """
        p, t = np.array(seeds, float), np.full(len(seeds), float(t0))
        out = np.full((len(p), samples, 4), np.nan)
        out[:, 0, :3], out[:, 0, 3] = p, t
        marks = np.asarray(target, float)[:, None] * np.arange(samples) / (samples - 1)
        gone, alive, reached = np.zeros(len(p)), self.inside(p), np.zeros(len(p), bool)
        steps = np.broadcast_to(np.asarray(h, float), len(p))
        if len(p) and not steps.min() > 0:
            raise ValueError("steps must be positive")
        for _ in range(int(np.ceil((horizon - t0) / steps.min())) + 1 if len(p) else 0):
            alive &= t < horizon - 1e-12
            if not alive.any():
                break
            i = np.flatnonzero(alive)
            dt = np.minimum(np.broadcast_to(h, len(p))[i], horizon - t[i])
            q, ok = self.step(p[i], t[i], dt)
            alive[i[~ok]] = False
            i, q, dt = i[ok], q[ok], dt[ok]
            seg = np.sqrt(((q - p[i]) ** 2).sum(1))
            after = gone[i] + seg
            due = (marks[i] > gone[i][:, None]) & (marks[i] <= after[:, None] * (1 + 1e-12)) & (seg > 0)[:, None]
            r, c = np.nonzero(due)
            share = np.clip((marks[i][r, c] - gone[i][r]) / seg[r], 0, 1)
            out[i[r], c, :3] = p[i][r] + share[:, None] * (q[r] - p[i][r])
            out[i[r], c, 3] = t[i][r] + share * dt[r]
            p[i], t[i], gone[i] = q, t[i] + dt, after
            done = i[np.isfinite(out[i, -1, 0])]
            reached[done], alive[done] = True, False
        return out, reached


CROSS = np.array([[0, 0, 0], [1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], float)


def integrate_crosses(seeds: DataFrame, field: Field, identity: str, t0: float, horizon: float, samples: int = 32) -> DataFrame:
    """Seven-path bundles: identity, valid (all seven reached their arc length), paths (flat x, y, z). seeds: x, y, z, dx, dt, arc (physical)."""
    shared = seeds.sparkSession.sparkContext.broadcast(field)  # its size is checked
    kind = dict(seeds.dtypes)[identity]

    def run(batches):
        for b in batches:
            centre = b[["x", "y", "z"]].to_numpy(float)
            start = (centre[:, None] + CROSS[None] * b["dx"].to_numpy(float)[:, None, None]).reshape(-1, 3)
            rep = lambda c: np.repeat(b[c].to_numpy(float), 7)
            got, ok = shared.value.arc_paths(start, t0, horizon, rep("dt"), rep("arc"), samples)
            paths = got[..., :3].reshape(len(b), 7, samples, 3) - centre[:, None, None]
            yield pd.DataFrame({identity: b[identity], "valid": ok.reshape(-1, 7).all(1), "paths": list(paths.reshape(len(b), -1).astype(np.float32))})

    return seeds.select(identity, "x", "y", "z", "dx", "dt", "arc").mapInPandas(run, f"`{identity}` {kind}, valid boolean, paths array<float>")


def rotation(angular: np.ndarray, h: float) -> np.ndarray:
    """The rotation of a constant angular velocity over a time, by Rodrigues' formula."""
    w = np.asarray(angular, float) * h
    angle = float(np.sqrt((w * w).sum()))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    a, b = (np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2) if angle > 1e-12 else (1.0, 0.5)
    return np.eye(3) + a * k + b * k @ k


def observer_frames(parameters: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and displacements of a moving rigid observer from (time, 6) translations and angular velocities; trapezoid rule."""
    q = np.asarray(parameters, float)
    turn = [np.eye(3)]
    for a, b in zip(q[:-1, 3:], q[1:, 3:]):
        turn.append(rotation((a + b) / 2, h) @ turn[-1])
    turn = np.stack(turn)
    flow = (turn.transpose(0, 2, 1) @ q[:, :3, None])[..., 0]
    moved = np.concatenate([np.zeros((1, 3)), np.cumsum((flow[1:] + flow[:-1]) * h / 2, axis=0)])
    return turn, moved


def observer_schedule(times: np.ndarray, low: Sequence[float], high: Sequence[float]) -> np.ndarray:
    """(time, 6) parameters of a small smooth wobble about the domain's middle."""
    # Axis, amplitudes and phases of the wobble.
    axis, swing, travel, shift = np.array([0.35, 0.55, 0.76]), 0.035, np.array([0.012, 0.018, 0.012]), np.array([0, 1.1, 2.0])
    low, high = np.asarray(low, float), np.asarray(high, float)
    turn = 2 * np.pi * np.asarray(times, float)
    rate = swing * 2 * np.pi * (np.cos(turn) + 0.35 * 2 * np.cos(2 * turn))
    angular = rate[:, None] * axis / np.sqrt((axis * axis).sum())
    reach = travel * (high - low)
    middle = (low + high) / 2 + reach * np.sin(turn[:, None] + shift)
    return np.concatenate([2 * np.pi * reach * np.cos(turn[:, None] + shift) - np.cross(angular, middle), angular], axis=1)


def moving_view(points: np.ndarray, steady, parameters: np.ndarray, turn: np.ndarray, moved: np.ndarray, bounds: tuple | None = None) -> np.ndarray:
    """(time, points, 3) velocities that a moving observer sees of a steady field, given as a function of positions.

    bounds: the field's least and largest coordinates; a position outside them, or a velocity that isn't finite, is an error.
    """
    out = []
    for k, (p, r, d) in enumerate(zip(parameters, turn, moved)):
        at = points @ r - d
        if bounds is not None and ((at < bounds[0]) | (at > bounds[1])).any():
            raise ValueError(f"the observer looks outside the field in frame {k}")
        seen = np.asarray(steady(at), float)
        if seen.shape != points.shape or not np.isfinite(seen).all():
            raise ValueError("the field gave no finite velocities")
        out.append(seen @ r.T + p[:3] + np.cross(p[3:], points))
    return np.stack(out).astype(np.float32)


def rounding_envelope(values: Sequence[str], centre: str, name: str = "common") -> list[Column]:
    """Whether one step explains all rounded float32 offsets from a centre: the intervals' intersection, and whether it holds anything."""
    ulp = lambda c: F.abs(F.col(c)) * F.lit(2.0**-24) + F.abs(F.col(centre)) * F.lit(2.0**-24)
    low = F.greatest(*[F.abs(F.col(c) - F.col(centre)) - ulp(c) for c in values])
    high = F.least(*[F.abs(F.col(c) - F.col(centre)) + ulp(c) for c in values])
    return [low.alias(f"{name}_low"), high.alias(f"{name}_high"), (low <= high).alias(f"{name}_ok")]
