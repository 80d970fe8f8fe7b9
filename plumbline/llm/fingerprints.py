"""I-Match fingerprints: sorted distinct terms within an inverse-document-frequency band, hashed over random lexicon subsets.

DataFrame functions only. The lexicon holds the words that between ``LOW`` and ``HIGH`` of all documents contain. A
document has so many distinct words on average, m, and each lexicon word needs a share of at least ``LOW``, so
the lexicon cannot exceed m / LOW words however many documents there are. It reaches the tasks as one literal: a
table of buckets in which a word's hash is looked up in constant time, so that no exploded word is ever joined.

``SUBSETS`` random subsets of the lexicon, disjoint and of three sizes (a 64th, a 512th and an eighth of it, for usual, very long
and short documents), each give one hash of the document's sorted terms in it. The fingerprint is their sequence;
the likeness of two is the share of equal ones among those that are not empty on both sides. A text without any
term in a subset is described by the hash of all its sorted distinct words instead.

The edited text takes its tail from the next document in descending order of id. Ids are cut into ``blocks`` runs at approximate
quantiles; a run is sorted by one task, and the document after its last comes along as a guest, so that texts are shuffled
once. There are as many runs as the texts have times ``RUN`` bytes, ``BLOCKS`` at least, so a task's run doesn't grow with the input. Their bounds,
eight bytes for each run, are a literal in which two steps find a row's run.

Defined results: a null text is the empty text; its fingerprint is that of no words. Repeated rows: ``op8_fingerprints`` (``every``) keeps each row; else a ``doc_id`` counts once,
with its smallest text in the order of (characters, hash). A null ``doc_id`` is the last of all. An empty table gives no rows. One document
alone is its own next. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.scratch import Scratch, table

LOW, HIGH = 0.002, 0.25
#: Of 2048 equal parts of the hash space: where subsets begin, how wide each is, how many there are.
FAMILIES = ((0, 32, 16), (512, 4, 16), (1024, 256, 4))
SUBSETS = sum(n for _, _, n in FAMILIES)
EMPTY = "-" * 8
#: Buckets of the lexicon's table.
BUCKETS = 1 << 14
#: Runs of neighbouring ids that a task takes whole: how many at least, and about how many bytes of texts in each.
BLOCKS, RUN = 256, 1 << 26


def words(text: Column) -> Column:
    """Hashes of a text's distinct lower-case words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _part(h: Column) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(2047))


def _within(low: int, width: int):
    return lambda h: _part(h).between(low, low + width - 1)


def lexicon(docs: DataFrame, text: Column, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row, one column ``table``: buckets of word hashes, a power of two of them."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    counts = docs.select(F.explode(words(text)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= F.greatest(F.lit(2), F.ceil(F.lit(low) * total.scalar()))) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.lit(high) * total.scalar()))))
    slots = band.groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("slot")).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "hs"))), lambda s: F.coalesce(s["hs"], F.array().cast("array<bigint>"))).alias("table"))


def fingerprint(text: Column, lexicon_table: Column) -> Column:
    """The hashes of all subsets, eight characters each, then that of all words if every subset is empty."""
    size = F.size(lexicon_table)

    def known(h):
        return F.array_contains(F.get(lexicon_table, F.pmod(h, size.cast("long")).cast("int")), h)

    def of(state):
        terms, all_ = state["terms"], state["all"]
        parts = []
        for f, (start, width, n) in enumerate(FAMILIES):
            parts += [F.filter(terms[f], _within(start + k * width, width)) for k in range(n)]
        hexed = F.transform(F.array(*parts), lambda p: F.when(F.size(p) > 0, F.lower(F.lpad(F.hex(F.xxhash64(p).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))).otherwise(F.lit(EMPTY)))
        code = F.array_join(hexed, "")
        return F.when(code == EMPTY * SUBSETS, F.concat(code, F.lower(F.lpad(F.hex(F.xxhash64(F.array_sort(all_))), 16, "0")))).otherwise(code)

    all_words = words(text)
    once = F.transform(F.array(all_words), lambda a: F.struct(a.alias("all"), F.array_sort(F.filter(a, known)).alias("known")))
    split = F.transform(once, lambda s: F.struct(s["all"].alias("all"), F.array(*[F.filter(s["known"], _within(lo, w * n)) for lo, w, n in FAMILIES]).alias("terms")))
    return F.element_at(F.transform(split, of), 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes among those that are not empty in both; 0 to 1."""
    piece = lambda c, k: F.substring(c, k * 8 + 1, F.lit(8))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.struct(piece(a, k).alias("a"), piece(b, k).alias("b")))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY)))
    return F.when(used > 0, same / used).otherwise(F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0)))


def _block(bounds: Column, coarse: Column, stride: int) -> Column:
    """How many bounds are at most doc_id: a coarse step over every stride-th bound, a fine one between two of them."""
    first = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id")))
    first = F.when(first > 0, first - 1).otherwise(0) * stride
    return F.when(F.col("doc_id").isNull(), 0).otherwise(first + F.size(F.filter(F.slice(bounds, first + 1, F.lit(stride)), lambda b: b <= F.col("doc_id"))))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", blocks: int = BLOCKS, every: bool = False, run: int = RUN) -> DataFrame:
    """blocks: runs at least; run: about the bytes of each; every: each row counts, also those of a repeated or null doc_id, in the order of (doc_id descending, characters, hash)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "imatch")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = lexicon(rows, F.col("text")).select(F.to_json("table")).first()[0]  # no more than m / LOW words
    lex = F.from_json(F.lit(buckets), "array<array<bigint>>")
    blocks = max(blocks, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // run))
    shares = [i / blocks for i in range(1, blocks)]
    found = (rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * blocks))).first()[0] if shares else None) or []  # no more than the blocks
    found = sorted(set(found))
    stride = max(1, int(len(found) ** 0.5))
    bounds, coarse = (F.from_json(F.lit(str(x)), "array<bigint>") for x in (found, found[::stride]))
    rows = rows.withColumn("block", _block(bounds, coarse, stride))
    # The document after a block's last is the first of the next lower block, or the first of all: it comes along as a guest.
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top"))
    down = Window.orderBy(F.desc("block"))  # one row for each block
    tops = tops.select(F.col("top").alias("guest_id"), F.coalesce(F.lag("block").over(down), F.min("block").over(Window.partitionBy())).alias("host"))
    tops = scratch.write(tops, "tops")
    guests = rows.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("guest_id"))).select("doc_id", "text", F.col("host").alias("block"), F.lit(True).alias("guest"))  # blocks rows
    dealt = rows.select("doc_id", "text", "block", F.lit(False).alias("guest")).unionByName(guests)
    dealt = dealt.select("*", F.length("text").alias("chars"), F.xxhash64("text").alias("hash"), fingerprint(F.col("text"), lex).alias("fingerprint"))
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "chars", "hash")
    again = F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id")) & F.lag("guest").over(order).eqNullSafe(F.col("guest"))
    # Rows that the order doesn't tell apart are equal. Of a guest's rows the first is enough.
    again = again & (F.row_number().over(order) > 1) & (F.col("guest") | F.lit(not every))
    once = dealt.withColumn("again", again).filter(~F.col("again"))
    after = F.lead(F.struct("text", "fingerprint")).over(order)
    pairs = once.withColumn("next", after).filter(~F.col("guest"))
    takes = F.expr("chars div 3")
    pairs = pairs.select("doc_id", F.col("chars").cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), F.concat(F.substring("text", F.lit(1), F.col("chars") - takes), F.substring("next.text", F.lit(1), takes)).alias("edited"))
    pairs = pairs.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), lex).alias("edited_fingerprint"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), every=True)
