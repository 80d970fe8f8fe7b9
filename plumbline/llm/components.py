"""Connected components of a table of links, by alternating large and small stars.

Each half step sends every neighbour of a node to the least of them; the links end as stars around the least node of each component.
Nodes with very many links are aggregated before the shuffle, and joins against them are split by adaptive execution. Every
step is written to the shared folder, so that lineage stays short; nothing but two numbers of a step reaches the driver.

Defined results: no links give no rows. A link with a null end, or of a node with itself, links nothing and is left out. Repeated links, in either
direction, count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: a, b. Returns node, root (the least node of its component) for all nodes but the roots."""
    now, last, step = links.filter("a <> b"), None, 0  # drops null ends too
    while True:
        now = scratch.write(_star(_star(now, True), False), f"{name}{step}")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if step:
            scratch.drop(f"{name}{step - 1}")
        if last == tuple(state):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, step = tuple(state), step + 1
