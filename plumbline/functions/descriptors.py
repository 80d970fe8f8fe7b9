"""Spectral descriptors of bundles of seven paths (centre, then x+, x-, y+, y-, z+, z-), as array functions and as Arrow column functions.

Paths come as (rows, 7, samples, 3). All but the velocity-gradient series are local to a row, so they don't depend on batches. The
gradient series take the mean vorticity of their group off; they run on whole groups only (``grouped_gradient_features``).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES, SAMPLES = 7, 32
RECIPE = {"num_freq": 6, "neighbor_weight": 0.5, "neighbor_scale": 100.0, "neighbor_pool": "sort", "mode": "gram", "include_chirality": True}


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(-1))


def rotation_invariants(series: np.ndarray, frequencies: int = 6, mode: str = "gram", chirality: bool = True, tiny: float = 1e-8) -> np.ndarray:
    """Of (rows, time, 3) vector series: what a rotation leaves of the first Fourier coefficients.

    Each frequency gives the lengths of its real and imaginary vectors and their cosine (or its magnitude alone); each pair of neighbouring
    frequencies gives the handedness of (real, imaginary, next real), which a reflection turns around.
    """
    if not 1 <= frequencies <= series.shape[1] // 2 + 1 or (chirality and frequencies < 2):
        raise ValueError("the series is too short for so many frequencies")
    f = np.fft.rfft(series, axis=1)[:, :frequencies]
    re, im = f.real, f.imag
    a, b = _length(re), _length(im)
    if mode == "magnitude":
        parts = [np.sqrt(a * a + b * b)]
    elif mode == "gram":
        parts = [np.stack([a, b, (re * im).sum(-1) / np.maximum(a * b, tiny)], axis=-1).reshape(len(series), -1)]
    else:
        raise ValueError(f"unknown mode: {mode}")
    if chirality:
        volume = (np.cross(re[:, :-1], im[:, :-1]) * re[:, 1:]).sum(-1)
        parts.append(volume / np.maximum(a[:, :-1] * b[:, :-1] * a[:, 1:], tiny))
    return np.concatenate(parts, axis=1)


def path_descriptor(paths: np.ndarray, num_freq: int = 6, neighbor_weight: float = 0.5, neighbor_scale: float = 100.0, neighbor_pool: str = "sort", mode: str = "gram", include_chirality: bool = True) -> np.ndarray:
    """Invariants of the centre's steps, then weighted invariants of each neighbour's steps relative to the centre, pooled over neighbours."""
    xyz = np.asarray(paths, np.float32 if np.asarray(paths).dtype == np.float32 else float)[..., :3]
    rows, lines = xyz.shape[:2]
    own = rotation_invariants(np.diff(xyz[:, 0], axis=1), num_freq, mode, include_chirality)
    steps = np.diff(xyz[:, 1:] - xyz[:, :1], axis=2) * neighbor_scale
    around = rotation_invariants(steps.reshape(rows * (lines - 1), -1, 3), num_freq, mode, include_chirality).reshape(rows, lines - 1, -1)
    pools = {"none": lambda v: v.reshape(rows, -1), "sort": lambda v: -np.sort(-v, axis=1).reshape(rows, -1), "mean": lambda v: v.mean(1), "max": lambda v: v.max(1)}
    return np.concatenate([own, neighbor_weight * pools[neighbor_pool](around)], axis=1)


def descriptor_id(recipe: dict = RECIPE) -> str:
    """A name that changes with the recipe: the digest of its canonical JSON."""
    text = json.dumps(recipe, sort_keys=True, separators=(",", ":"))
    return f"spectral_3d_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def _spectrum(series: np.ndarray, frequencies: int) -> np.ndarray:
    """Real parts of the first frequencies, then imaginary ones without the first, series by series."""
    f = np.fft.rfft(series, axis=1)[:, :frequencies].transpose(0, 2, 1)
    return np.concatenate([f.real.reshape(len(series), -1), f.imag[:, :, 1:].reshape(len(series), -1)], axis=1)


def gram_features(paths: np.ndarray, frequencies: int = 6, from_start: bool = True, unit: bool = True, tiny: float = 1e-8) -> np.ndarray:
    """Spectra of the 21 scalar products of neighbour offsets: what any moving rigid observer agrees on."""
    offsets = (paths[:, 1:, :, :3] - paths[:, :1, :, :3]).transpose(0, 2, 1, 3)
    gram = offsets @ offsets.transpose(0, 1, 3, 2)
    i, j = np.triu_indices(6)
    series = gram[:, :, i, j]
    if unit:
        series = series / np.maximum(np.trace(gram[:, 0], axis1=1, axis2=2) / 6, tiny)[:, None, None]
    return _spectrum(series - series[:, :1] if from_start else series, frequencies)


def gradient_series(paths: np.ndarray, times: np.ndarray | None = None, log: bool = False, tiny: float = 1e-6) -> np.ndarray:
    """(rows, time, 4): vorticity deviation from the group's mean, strain, |divergence| and a signed balance of the two first."""
    x = paths[..., :3]
    pairs = np.stack([x[:, 1] - x[:, 2], x[:, 3] - x[:, 4], x[:, 5] - x[:, 6]], axis=-1)
    t = np.broadcast_to(np.arange(pairs.shape[1], dtype=float) if times is None else np.asarray(times, float), pairs.shape[:2])
    if (np.diff(t, axis=1) <= 0).any():
        raise ValueError("sample times must increase")
    lo, hi = np.r_[0, 0:pairs.shape[1] - 2, pairs.shape[1] - 2], np.r_[1, 2:pairs.shape[1], pairs.shape[1] - 1]
    rate = (pairs[:, hi] - pairs[:, lo]) / (t[:, hi] - t[:, lo])[..., None, None]
    g = rate @ np.linalg.pinv(pairs, rcond=tiny)
    spin = np.stack([g[..., 2, 1] - g[..., 1, 2], g[..., 0, 2] - g[..., 2, 0], g[..., 1, 0] - g[..., 0, 1]], axis=-1)
    deviation = _length(spin - spin.mean(0, keepdims=True))
    strain = (g + np.swapaxes(g, -1, -2)) / 2
    size = np.sqrt((strain * strain).sum((-1, -2)))
    out = np.stack([deviation, size, np.abs(np.trace(g, axis1=-2, axis2=-1)), deviation**2 / 4 - size**2 / 2], axis=-1)
    return np.sign(out) * np.log1p(np.abs(out)) if log else out


def gradient_features(paths: np.ndarray, frequencies: int = 6, **more) -> np.ndarray:
    return _spectrum(gradient_series(paths, **more), frequencies)


def anchored_features(paths: np.ndarray, frequencies: int = 6, window: int | None = None, channels=(0, 1, 2, 3), **more) -> np.ndarray:
    """Spectra of the gradient series and, for each, its first value, early mean, mean, spread, largest, smallest and last value."""
    s = gradient_series(paths, **more)[:, :window, list(channels)]
    early = max(2, s.shape[1] // 4)
    anchors = np.stack([s[:, 0], s[:, :early].mean(1), s.mean(1), s.std(1), s.max(1), s.min(1), s[:, -1]], axis=-1)
    return np.concatenate([_spectrum(s, frequencies), anchors.reshape(len(s), -1)], axis=1)


def dimensionless(paths: np.ndarray) -> np.ndarray:
    """The centre in units of its own arc length, neighbours' offsets in units of their initial distance, as float32."""
    p = np.asarray(paths, float)
    centre, offset = p[:, 0], p[:, 1:] - p[:, :1]
    arc = _length(np.diff(centre, axis=1)).sum(1)
    start = _length(offset[:, :, 0])
    even = np.allclose(start, start[:, :1], rtol=1e-4, atol=1e-6) and np.allclose(offset[:, 0::2, 0], -offset[:, 1::2, 0], rtol=1e-4, atol=1e-6)
    if (centre[:, 0] != 0).any() or not even or not (np.isfinite(arc).all() and (arc > 0).all() and (start > 0).all()):
        raise ValueError("paths must start at zero, with even neighbours and a centre that moves")
    unit = centre / arc[:, None, None]
    out = np.concatenate([unit[:, None], unit[:, None] + offset / start.mean(1)[:, None, None, None]], axis=1)
    return out.astype(np.float32)


def dimensionless_descriptor(paths: np.ndarray, **recipe) -> np.ndarray:
    """The path descriptor of dimensionless paths."""
    return path_descriptor(dimensionless(paths), **recipe)


def column(function, width: int = LINES * SAMPLES * 3, shape=(LINES, SAMPLES, 3)):
    """A row-local function of paths as a column function of flat float arrays."""

    @F.pandas_udf("array<float>")
    def run(flat: pd.Series) -> pd.Series:
        if not len(flat):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.asarray(function(np.stack(flat).reshape(-1, *shape)), np.float32)))

    def of(c: Column) -> Column:
        return run(c)

    return of


def grouped_gradient_features(df: DataFrame, keys: list[str], identity: str, flat: str, frequencies: int = 6) -> DataFrame:
    """Gradient features of whole groups; they are never split, since each depends on the group's mean."""
    kinds = dict(df.dtypes)

    def run(key, pdf):
        got = gradient_features(np.stack(pdf[flat]).reshape(-1, LINES, SAMPLES, 3).astype(float), frequencies)
        return pd.DataFrame({**{k: v for k, v in zip(keys, key)}, identity: pdf[identity], "features": list(got)})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, identity]) + ", features array<double>"
    return df.select(*keys, identity, flat).groupBy(*keys).applyInPandas(run, schema)


def sql_spectrum(value: str, nth: str, samples: Column, frequency: int) -> tuple[Column, Column]:
    """Real and imaginary Fourier sums as aggregates, for long tables."""
    angle = F.lit(2 * np.pi * frequency) * F.col(nth) / samples
    return F.sum(F.col(value) * F.cos(angle)), -F.sum(F.col(value) * F.sin(angle))
