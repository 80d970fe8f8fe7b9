"""A corpus from raw documents: five stages, each reading what the one before has kept.

run() writes every stage's rows to the shared folder and reads them back for the next. All stages but the last return the columns
of documents; the last returns pieces with their places in sequences. Extra columns of documents travel along.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, langid, ngram_join, packing, pii
from plumbline.plans.scratch import Scratch, table

TOKENIZER = "word_bpe_49k.json"


#: Columns that stages read by name; all others travel under names that no operator uses.
OWN = ("doc_id", "text", "lang", "n_chars")


def _aside(stage):
    """The stage over docs whose other columns are renamed by their place, and named back in its result (where they still are)."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"travels{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*names.values()), sf_dir)
        back = {v: k for k, v in names.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


def _marked(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """docs with a row number in ``row`` that stays: ids may be null or repeated.

    Rows of files have the place of their file and their place in it; other rows are written with a number.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return Scratch(spark, name).write(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    placed = docs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    files = sorted(r["file"] for r in placed.select("file").distinct().collect())  # a row a file
    if not files:
        return docs.withColumn("row", F.lit(0).cast("long"))
    numbered = spark.createDataFrame(list(enumerate(files)), "number long, file string")
    return placed.join(F.broadcast(numbered), "file").withColumn("row", F.shiftleft("number", 40) + F.col("place")).drop("number", "file", "place")


#: Rows of a bitmap; MB of all bitmaps that are broadcast at the most, a bit for each of 268 million rows.
MARKS, MARKS_MB = 1 << 16, 32


def _bitmaps(keep: DataFrame) -> DataFrame:
    """(block, bits): the numbers in ``row``, as bitmaps of MARKS rows that end with their last one."""

    def marks(pdf):
        row = pdf["row"].to_numpy()
        bits = np.zeros(MARKS, bool)
        bits[row % MARKS] = True
        words = np.packbits(bits, bitorder="little").view("<i8")
        return pd.DataFrame({"block": [row[0] // MARKS], "bits": [words[: row.max() % MARKS // 64 + 1]]})

    return keep.groupBy(F.shiftright("row", MARKS.bit_length() - 1)).applyInPandas(marks, "block long, bits array<long>")


def _only(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows whose number is in keep. Bitmaps of the numbers go to the rows, so that texts aren't dealt anew; more than MARKS_MB of them don't."""
    bitmaps = Scratch(rows.sparkSession, "marks").write(_bitmaps(keep), "bitmaps")
    if (bitmaps.agg(F.sum(F.size("bits") + 4)).first()[0] or 0) * 8 > MARKS_MB << 20:
        return rows.join(keep.hint("merge"), "row", "left_semi")
    place = F.col("row") - F.shiftleft("block", MARKS.bit_length() - 1)
    marked = rows.join(F.broadcast(bitmaps), F.shiftright("row", MARKS.bit_length() - 1) == F.col("block"))
    return marked.filter(F.getbit(F.get("bits", F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1).drop("block", "bits")


def _smallest(rows: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each group the row with the smallest id, of equal ids the first; null ids come last. What groups reads in scratch goes."""
    named = rows.select("row", "doc_id").join(groups, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = Scratch(rows.sparkSession, "keep").write(named.groupBy("group").agg(first.alias("s")).select(F.col("s.row").alias("row")), "rows")
    scratch.drop()
    return _only(rows, keep)


@_aside
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows outside the held-out part; rows whose language can't be told go.

    Those are null and empty texts, texts without a letter, and every text where no row has both a text and a label. A null ``lang`` or
    ``doc_id`` is no reason to go; repeated rows are judged alike and all stay; an empty table stays empty.
    """
    rows = langid.held_out_split(docs)
    model = langid.train(rows.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=tuple(docs.columns)).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


@_aside
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the smallest id.

    Texts are equal when they are identical but for runs of white space; a null text equals the empty one. Of rows with one id and equal
    texts one stays; a row with a null id stays only where its group has no other. An empty table stays empty.
    """
    rows, scratch = _marked(spark, docs, "copies"), Scratch(spark, "radix")
    groups = exact_dedup.exact_groups(rows, doc_id="row", scratch=scratch).select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return _smallest(rows, groups, scratch).select(*docs.columns)


@_aside
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays, that with the smallest id.

    Texts without words (null, empty, white space) are similar to none and all stay. Equal texts are one component, so of repeated rows one
    stays; a row with a null id stays only where its component has no other. An empty table stays empty.
    """
    rows, scratch = _marked(spark, docs, "near"), Scratch(spark, "ngram")
    groups = ngram_join.near_components(rows, doc_id="row", scratch=scratch).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return _smallest(rows, groups, scratch).select(*docs.columns)


@_aside
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data gives way to its kind in brackets; every row stays.

    Of overlapping spans the first holds. Null texts stay null, texts without spans stay as they are; ``n_chars``, where there is one, counts the new
    text. Repeated rows and null ids pass through; an empty table stays empty.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone; repeated rows are documents of their own; a null id stays null; other columns end
    here. Ties between pieces or sequences go to the first. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", pack)]
#: Trained prototypes, tokenizers and packing are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
