"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive runs of bytes, most significant first, until a group is a singleton or
its members have ended. Equality is the equality of every byte that was read; no digest decides it.

A level's digit is a run of bytes rather than one byte: 32 bytes first, then each level sixteen times wider, so
that even very long texts end within a few levels. Only documents that still share all bytes so far with another
one go to the next level, and only these carry the rest of their text there.

Defined results: a null text is the empty text, and empty texts are equal to each other. A repeated row (equal
``doc_id`` and equal text) is a copy like any other; exactly one row of a group is kept, of tied ones any one.
A null ``doc_id`` sorts after every other. An empty table gives an empty result. Extra columns are ignored.

Hot groups: a group's size and head come from a partially aggregated ``groupBy``, so a group with a third of all
rows reaches its reducer as one row a task; rows get their group's head by a sort-merge join whose skewed
partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch, table

FIRST_WIDTH, GROWTH = 32, 16


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """For each row: uid, doc_id, keep_id, group_size, kept, text_sha256 (an output only); they read tables in scratch."""
    scratch = scratch or Scratch(docs.sparkSession, "radix")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(normalised(F.col(text)), "UTF-8").alias("body"))
    base = scratch.write(rows.withColumn("uid", F.monotonically_increasing_id()), "base")
    own = scratch.write(base.select("uid", "doc_id", F.unhex(F.sha2("body", 256)).alias("sha")), "rows")
    active, done, width, level = base.withColumn("gid", F.lit(-1).cast("long")), [], FIRST_WIDTH, 0
    while True:
        split = active.select("uid", "doc_id", "gid", F.substring("body", 1, width).alias("digit"), (F.length("body") > width).alias("more"))
        head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid")))
        groups = split.groupBy("gid", "digit", "more").agg(F.count(F.lit(1)).alias("size"), head.alias("head")).filter("size > 1")
        carried = active.select("uid", "doc_id", "gid", F.substring("body", 1, width).alias("digit"), (F.length("body") > width).alias("more"), F.expr(f"substring(body, {width + 1})").alias("rest"))
        out = carried.join(groups, ["gid", "digit", "more"]).select(
            "uid", "doc_id", F.col("head.uid").alias("gid"), F.when(F.col("more"), F.col("rest")).alias("body"), "more", F.col("head.doc_id").alias("keep_id"), "size"
        )
        # Ended rows stay; the text of the others is needed by the next level alone.
        out = scratch.write(out, f"level{level}", by=("more",))
        scratch.drop(f"level{level - 1}/more=true" if level else "base")
        done.append(out.filter(~F.col("more")).select("uid", F.col("gid").alias("keep_uid"), "keep_id", "size"))
        active = out.filter("more").select("uid", "doc_id", "gid", "body")
        if active.isEmpty():
            break
        width, level = width * GROWTH, level + 1
    copies = done[0]
    for more in done[1:]:
        copies = copies.unionByName(more)
    single = F.col("keep_uid").isNull()
    return own.join(copies, "uid", "left").select(
        "uid", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("keep_uid") == F.col("uid"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("uid")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256 FROM t JOIN g ON t.body = g.body
"""
