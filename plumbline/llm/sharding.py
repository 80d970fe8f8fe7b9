"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows get a global order (a hash of the text, then the row's id), which puts equal texts next to each other. A range
exchange deals that order out to partitions; each partition's total is summed alone, the few totals are accumulated,
and a row's global start is its partition's start plus the running sum within it. Shards are cut at equal
targets: a unit belongs to the shard in which its middle byte lies.

A unit is a row, or all rows of one text where they together are no larger than a fiftieth of a shard or than the largest
row; such groups stay in one shard. Larger groups are cut like any run of rows, so that a text with a third of
all rows still leaves the shards even: no shard is further from its target than the largest unit.

Defined results: a null text has size 8 and the checksum of no bytes; a null ``doc_id`` sorts first among rows of its text;
repeated rows are rows of their own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.scratch import Scratch, table

SHARDS, ROW_BYTES, GROUP_SHARE = 24, 8, 50


def byte_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + row_bytes).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("key"))
    order = ["key", "text_crc32", "doc_id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    rows = scratch.write(ranged, "rows")  # the range bounds are sampled: what follows must see one outcome
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = Window.partitionBy()
    starts = totals.select("pid", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(whole).alias("total"), F.max("largest").over(whole).alias("largest"))
    local = Window.partitionBy("pid").orderBy(*order)
    placed = (
        rows.withColumn("run", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("nth", F.row_number().over(local))
        .join(F.broadcast(starts), "pid")  # one row for each partition
        .select(*order, "size", "total", "largest", (F.col("byte0") + F.coalesce("run", F.lit(0))).alias("start"), (F.col("row0") + F.col("nth") - 1).alias("idx"))
    )
    placed = scratch.write(placed, "placed")
    units = (
        placed.groupBy("key", "text_crc32").agg(F.min("start").alias("unit_start"), F.sum("size").alias("unit_size"), F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.expr(f"total div {shards * GROUP_SHARE}"), "largest")).alias("whole"))
        .filter("n > 1 and unit_size <= whole").select("key", "text_crc32", "unit_start", "unit_size")
    )
    cut = placed.join(units, ["key", "text_crc32"], "left").withColumn(
        "shard", F.expr(f"cast(least({shards - 1}, ((2 * coalesce(unit_start, start) + coalesce(unit_size, size)) * {shards}) div (2 * total)) as int)")
    )
    firsts = cut.groupBy("shard").agg(F.min("idx").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("idx") - F.col("first")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
