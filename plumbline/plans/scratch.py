"""Intermediate tables in the shared folder, and the package on the executors.

Lineage is cut by written Parquet tables, never by local checkpoints: any executor may be lost and
every later stage can still read what was written.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[str] = []
_ROOTS: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests, a laptop)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


@atexit.register
def _sweep() -> None:
    """Deletes the application's tables when its driver ends; results that read them end with it."""
    for spark, root in _ROOTS:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one query below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df, in folders by the columns ``by``, and reads it back; the result has no lineage beyond the files.

        The write's own shuffle files go when it ends, not when the driver happens to collect its garbage.
        """
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no result still reads; without names all of them."""
        jvm = self.spark._jvm
        for path in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="plumbline-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(target := os.path.join(folder, "plumbline.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
