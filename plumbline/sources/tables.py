"""Typed readers and writers, manifests and integrity checks. Schemas are given, never inferred."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CACHE_SLICE = "dataset string, family string, phase string, source_ordinal short, row long, scale_id short, reference boolean, seeds array<float>, raw_features array<float>, features array<float>"
LIBRARY = "id long, f array<float>, y boolean, metadata string"
SCALER = "mean array<double>, scale array<double>, descriptor_id string, schema_version short"


def match_schema(methods: Sequence[str] = ("raw", "pca", "spectral")) -> str:
    """One row a query: identity, scale, label and prior, then a group of columns for each method."""
    base = "dataset string, family string, source_ordinal short, row long, center long, block byte, x double, y double, z double, dx double, ds double, arc double, label boolean, prior_prediction boolean, prior_score double"
    each = "{m}_prediction boolean, {m}_score double, {m}_d_pos double, {m}_d_neg double, {m}_distance double, {m}_matched long, {m}_matched_dataset string, {m}_matched_family string, {m}_matched_scale short, {m}_matched_label boolean"
    return ", ".join([base, *[each.format(m=m) for m in methods]])


def read_parquet(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Only the named columns are read."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a CSV file with a header; a malformed row is an error."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False).select(*columns)


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Writes a table that must not exist yet."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def array_digest(array: np.ndarray) -> str:
    """SHA-256 of an array's type, shape and little-endian row-major bytes."""
    a = np.asarray(array)
    if a.dtype.hasobject:
        raise ValueError("object arrays have no portable bytes")
    a = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<")))
    head = json.dumps({"dtype": a.dtype.str, "shape": list(a.shape)}, sort_keys=True, separators=(",", ":")).encode("ascii")
    return hashlib.sha256(len(head).to_bytes(8, "little") + head + a.tobytes()).hexdigest()


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", roles: dict[str, str] | None = None) -> DataFrame:
    """path, bytes, sha256 and role of every file below a folder; roles: name to a pattern of paths, the first that matches counts."""
    role = F.lit(None).cast("string")
    for name, like in reversed((roles or {}).items()):
        role = F.when(F.col("path").rlike(like), name).otherwise(role)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), role.alias("role"))


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed."""
    j = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed")
    return j.withColumn("state", state).filter("state is not null").select("path", "state")


def row_digest(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows and sha256 of a table, whatever the order of its rows: the digest of the sorted digests of parts, each that of its rows' sorted digests.

    Parts are by the hash of the order's columns and number about a row in 1,000, so that neither a part nor the list of parts grows fast.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = 1 << max(0, (df.count() // 1000).bit_length())
    own = df.select(F.pmod(F.xxhash64(*order), F.lit(parts)).alias("part"), row.alias("d")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda p: p["d"]), ""), 256).alias("sha256"))


def source_starts(frames: int, intervals: int = 12, windows: int = 4) -> list[int]:
    """Evenly spread first frames of windows that need so many intervals; they must differ."""
    last = frames - intervals - 1
    starts = [k * last // (windows - 1) for k in range(windows)]
    if intervals < 1 or last < windows - 1 or len(set(starts)) < windows:
        raise ValueError("too few frames for distinct windows")
    return starts


def window_starts(spark: SparkSession, frames: Column | int, intervals: int = 12) -> DataFrame:
    return spark.range(4).select(F.col("id").cast("int").alias("k"), F.floor(F.col("id") * (F.lit(frames) - intervals - 1) / 3).alias("start"))


def uniform_axis(df: DataFrame, keys: Sequence[str], coordinate: str, rtol: float = 1e-4, atol: float = 1e-8) -> DataFrame:
    """Per axis: whether its coordinates increase strictly, and evenly within tolerances."""
    w = Window.partitionBy(*keys).orderBy(coordinate)
    step = F.col(coordinate) - F.lag(coordinate).over(w)
    steps = df.select(*keys, coordinate).withColumn("d", step).withColumn("nth", F.row_number().over(w)).filter("d is not null")
    first = F.min_by("d", "nth")
    spread = F.greatest(F.max("d") - first, first - F.min("d"))
    return steps.groupBy(*keys).agg((F.min("d") > 0).alias("increasing"), ((F.min("d") > 0) & (spread <= F.lit(atol) + F.lit(rtol) * F.abs(first))).alias("uniform"), F.count("d").alias("steps"))


def registry_report(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected units with the number of observed rows, and whether any was found; units that nobody expected too."""
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    j = expected.select(*keys).withColumn("__e", F.lit(True)).join(seen, list(keys), "full")
    state = F.when(F.col("__e").isNull(), "unexpected").when(F.col("rows").isNull(), "absent").otherwise("present")
    return j.select(*keys, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), state.alias("state"))


def expect_counts(df: DataFrame, keys: Sequence[str], counts: dict, kind: str) -> DataFrame:
    """Units whose number of rows of each kind isn't as told."""
    wrong = [F.sum(F.when(F.col(kind) == k, 1).otherwise(0)) != n for k, n in counts.items()]
    condition = wrong[0]
    for c in wrong[1:]:
        condition = condition | c
    return df.groupBy(*keys).agg(condition.alias("wrong")).filter("wrong").drop("wrong")


SCHEMA_VERSION = 1


def load_registry(spark: SparkSession, rows: Sequence[dict], required: Sequence[str] = ("dataset", "family", "path")) -> DataFrame:
    """A dataset registry as a table, from its parsed entries: every required field must be there, ids must be unique."""
    for r in rows:
        lacking = [k for k in required if r.get(k) in (None, "")]
        if lacking:
            raise ValueError(f"entry {r.get(required[0])!r} lacks {lacking}")
    names = [r[required[0]] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError(f"ids repeat: {sorted({n for n in names if names.count(n) > 1})}")
    fields = list(dict.fromkeys([*required, *[k for r in rows for k in r]]))
    return spark.createDataFrame([[None if r.get(k) is None else str(r[k]) for k in fields] for r in rows], ", ".join(f"`{k}` string" for k in fields))


def write_slices(rows: DataFrame, path: str, manifest: str) -> DataFrame:
    """Cache slices by dataset and source, in ``CACHE_SLICE``'s columns, and the manifest of their files, which readers check."""
    columns = [f.name for f in rows.sparkSession.createDataFrame([], CACHE_SLICE).schema.fields]
    write_once(rows.select(*columns), path, ("dataset", "source_ordinal"))
    write_once(file_manifest(rows.sparkSession, path, "*.parquet"), manifest)
    return rows.sparkSession.read.parquet(manifest)


def read_slices(spark: SparkSession, path: str, manifest: str, phase: str | None = None, scales: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Cache slices after a check of every file's digest; rows of another phase or scale than told are an error when read."""
    wrong = verify_manifest(file_manifest(spark, path, "*.parquet"), spark.read.parquet(manifest)).limit(5).collect()  # for the message
    if wrong:
        raise ValueError(f"files differ from the manifest: {[tuple(r) for r in wrong]}")
    df = spark.read.schema(CACHE_SLICE).parquet(path)
    ok = F.lit(True)
    if phase is not None:
        ok = ok & F.col("phase").eqNullSafe(F.lit(phase))
    if scales is not None:
        ok = ok & F.coalesce(F.col("scale_id").isin(*scales), F.lit(False))
    df = df.filter(F.assert_true(ok, F.lit("a row of another phase or scale")).isNull())
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, in a folder that must not exist yet."""
    df.write.mode("errorifexists").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that keep nulls, in a folder that must not exist yet."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def save_library(library: DataFrame, scaler: DataFrame, path: str) -> None:
    write_once(library, f"{path}/library")
    write_once(scaler.withColumn("schema_version", F.lit(SCHEMA_VERSION).cast("short")), f"{path}/scaler")


def load_library(spark: SparkSession, path: str, descriptor_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The library and its scaler; another descriptor's, or another schema version, is an error."""
    scaler = spark.read.parquet(f"{path}/scaler")
    if descriptor_id is not None and scaler.filter(F.col("descriptor_id") != descriptor_id).limit(1).count():
        raise ValueError("the library was built with another descriptor")
    if "schema_version" not in scaler.columns or scaler.filter(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))).limit(1).count():
        raise ValueError(f"the library is not of schema version {SCHEMA_VERSION}")
    return spark.read.schema(LIBRARY).parquet(f"{path}/library"), scaler


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Named arrays, a row each with type, shape, bytes and digest, in a table that must not exist yet."""
    rows = [(k, np.asarray(a).astype(np.asarray(a).dtype.newbyteorder("<")).dtype.str, list(np.asarray(a).shape), np.ascontiguousarray(np.asarray(a).astype(np.asarray(a).dtype.newbyteorder("<"))).tobytes(), array_digest(a)) for k, a in arrays.items()]
    write_once(spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data binary, sha256 string"), path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays, after a check of each one's digest."""
    out = {}
    for r in spark.read.parquet(path).collect():  # a row an array
        out[r["name"]] = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["shape"])
        if array_digest(out[r["name"]]) != r["sha256"]:
            raise ValueError(f"array {r['name']} changed")
    return out


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model is its tables; each is written once."""
    for name, df in tables.items():
        write_once(df, f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
