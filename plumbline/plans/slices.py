"""Cache slices from a velocity window: seeds, scales, labels, paths and features in one table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import descriptors
from plumbline.operators import fields
from plumbline.plans.scratch import Scratch, ship


def frame_table(spark: SparkSession, field: fields.Field, frame: int) -> DataFrame:
    """One frame of a field (whose size is checked) as long rows ix, iy, iz, u, v, w."""
    v = field.velocity[frame]
    iz, iy, ix = (a.ravel().astype(np.int32) for a in np.indices(v.shape[:3]))
    return spark.createDataFrame(pd.DataFrame({"ix": ix, "iy": iy, "iz": iz, **{c: v[..., k].ravel().astype(float) for k, c in enumerate("uvw")}}))


def build_slice(spark: SparkSession, field: fields.Field, seeds: DataFrame, scales: DataFrame, start: int, intervals: int, about: dict, seed: int = 0, share: float = 0.95) -> DataFrame:
    """Rows of ``tables.CACHE_SLICE``: every seed whose seven paths reach their arc length within the window.

    seeds: seed_id, x, y, z; scales: scale_id, dx, ds, arc in grid units; about: dataset, family, phase, source_ordinal. Each seed gets one scale, all
    scales equally often; labels are of the window's first frame; the window must hold all its frames.
    """
    if start < 0 or start + intervals >= len(field.velocity):
        raise ValueError(f"frames {start} to {start + intervals} of {len(field.velocity)}")
    ship(spark)
    scratch, count = Scratch(spark, "slice"), scales.count()
    dealt = fields.balanced_assignment(seeds, "seed_id", count, seed, name="nth")
    numbered = scales.select("scale_id", "dx", "ds", "arc").orderBy("scale_id").collect()  # the scale table is a bounded one
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(numbered)], "nth int, scale_id int, dx double, ds double, arc double")
    dealt = scratch.write(dealt.join(F.broadcast(fields.physical_scales(numbered, field.spacing, field.interval)), "nth"), "dealt")
    labels = fields.label_at_points(frame_table(spark, field, start), dealt.select("seed_id", "x", "y", "z"), "seed_id", field.low, field.spacing, field.shape.tolist(), field.spacing.tolist(), share)
    t0 = field.start + start * field.interval
    paths = fields.integrate_crosses(dealt, field, "seed_id", t0, t0 + intervals * field.interval).filter("valid")
    done = scratch.write(paths.select("seed_id", F.col("paths").alias("raw_features"), descriptors.column(descriptors.path_descriptor)(F.col("paths")).alias("features")), "paths")
    rows = dealt.join(labels.select("seed_id", F.col("label").alias("reference")), "seed_id").join(done, "seed_id")
    return rows.select(
        *[F.lit(about[k]).cast("short" if k == "source_ordinal" else "string").alias(k) for k in ("dataset", "family", "phase", "source_ordinal")], F.col("seed_id").cast("long").alias("row"), F.col("scale_id").cast("short").alias("scale_id"),
        "reference", F.array(*[F.col(c).cast("float") for c in "xyz"]).alias("seeds"), "raw_features", F.col("features").cast("array<float>").alias("features"),
    )


def numpy_assigned(df: DataFrame, identity: str, count: int, seed: int, name: str = "scale") -> DataFrame:
    """``numpy_assignment`` joined to rows in the order of their identity; the draw is one integer a row from the driver, as the law has it."""
    from plumbline.operators.prefix import ranked

    rows = ranked(df, [], [F.col(identity)], "__nth").drop("__nth_all")
    drawn = fields.numpy_assignment(df.count(), count, seed)
    law = df.sparkSession.createDataFrame(pd.DataFrame({"__nth": np.arange(1, len(drawn) + 1), name: drawn}), f"__nth long, `{name}` int")
    return rows.join(law, "__nth").drop("__nth")

