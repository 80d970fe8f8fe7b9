"""Language identification by hyperdimensional profiles.

Every letter symbol has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rolled) by the letter's place; a document's vector bundles (adds) those of its n-grams; a language's
prototype bundles its training documents' directions. A document gets the language whose prototype, less the mean of all prototypes,
has the largest cosine with it.

Letters are lower-cased code points: a to z have symbols of their own, other letters share ``OTHERS`` symbols by code point, and every run
of anything else is one gap symbol. Vectors come from a fixed seed, so training is exact integer addition and does
not depend on partitions or order. Prototypes are gathered as one row a language: their size depends on the number of languages alone.

Training uses rows with text and a language whose crc32(doc_id as text) mod 4 is not 2; their vectors are scaled to integers
of equal length so that long documents don't outweigh others. Every row of the training part counts, repeated ones as often as they occur.

Defined results: ``und`` with score 0 where the text is null or has no letter; where nothing could be learned all rows are ``und``. Ties go to the alphabetically
first language. A null ``doc_id`` counts as the empty string in the split. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.scratch import ship, table

DIMENSIONS, GRAM, OTHERS, SEED, UNIT = 1024, 3, 37, 20240607, 4096
GAP, UNKNOWN = 26, "und"
SYMBOLS = 27 + OTHERS
#: Texts go through the vectors in blocks of about so many characters.
BLOCK = 1 << 20


class Space:
    """The letters' vectors, permuted for each place of an n-gram."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.gram, self.dimensions = gram, dimensions
        self.places = [np.roll(letters, gram - 1 - i, axis=1) for i in range(gram)]
        table = np.full(0x110000, GAP, np.uint8)
        points = np.arange(0x110000)
        for p in points[:0x3000]:
            if chr(p).isalpha():
                low = ord(chr(p).lower()[0])
                table[p] = low - 97 if 97 <= low <= 122 else 27 + low % OTHERS
        high = np.array([chr(p).isalpha() for p in range(0x3000, 0x40000)])
        table[0x3000:0x40000][high] = 27 + points[0x3000:0x40000][high] % OTHERS
        self.table = table

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-gram codes."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for place in reversed(self.places):
            out *= place[grams % SYMBOLS]
            grams = grams // SYMBOLS
        return out

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document number, code and count of each distinct n-gram of each text, and which texts have a letter."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        symbol = self.table[points]
        lettered = np.bincount(doc[symbol != GAP], minlength=len(texts)) > 0
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        keep = (symbol != GAP) | new
        keep[1:] |= symbol[:-1] != GAP
        symbol, doc = symbol[keep].astype(np.int64), doc[keep]
        n = len(doc) - self.gram + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, lettered
        code = np.zeros(n, np.int64)
        for i in range(self.gram):
            code = code * SYMBOLS + symbol[i : i + n]
        same = doc[:n] == doc[self.gram - 1 :]
        size = SYMBOLS**self.gram
        key, count = np.unique(doc[:n][same] * size + code[same], return_counts=True)
        return key // size, key % size, count, lettered

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bundled vectors (float32, exact integers below 2**24), and which texts have a letter."""
        doc, code, count, lettered = self.grams(texts)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if len(doc):
            distinct, at = np.unique(code, return_inverse=True)
            bound = self.bind(distinct).astype(np.float32)
            edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for lo, hi in zip(edges, [*edges[1:], len(doc)]):
                out[doc[lo]] = count[lo:hi].astype(np.float32) @ bound[at[lo:hi]]
        return out, lettered


def _blocks(texts: list[str]):
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes: one row each."""
    ship(docs.sparkSession)

    def partial(batches):
        space, sums = Space(), {}
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
            for lo, hi in _blocks(texts):
                v, lettered = space.vectors(texts[lo:hi])
                norm = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
                unit = np.rint(v * (UNIT / np.maximum(norm, 1))).astype(np.int64)
                for name in set(langs[lo:hi]):
                    rows = (langs[lo:hi] == name) & lettered
                    sums[name] = sums.get(name, 0) + unit[rows].sum(0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [s.tolist() for s in sums.values()]})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    parts = rows.mapInPandas(partial, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda s: s["x"]).alias("v")).collect()  # one row a language
    found = sorted((r["lang"], r["v"]) for r in found)
    return [k for k, _ in found], np.array([v for _, v in found], np.float64).reshape(len(found), DIMENSIONS)


def directions(prototypes: np.ndarray) -> np.ndarray:
    """Unit prototypes less their mean (where there are several), as unit rows."""
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    if len(unit) > 1:
        unit = unit - unit.mean(0)
    return unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep (any columns), lang_pred and score: the best cosine, from -1 to 1, as 0 to 1."""
    spark = docs.sparkSession
    ship(spark)
    names, prototypes = model
    shared = spark.sparkContext.broadcast((names, directions(prototypes).astype(np.float32)))  # languages x dimensions

    def of(batches):
        space, (langs, unit) = Space(), shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            null = np.array([t is None for t in texts], bool)
            texts = [t or "" for t in texts]
            best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for lo, hi in _blocks(texts) if langs else ():
                v, lettered = space.vectors(texts[lo:hi])
                cosine = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ unit.T
                ok = lettered & ~null[lo:hi]
                best[lo:hi][ok] = np.array(langs, object)[cosine.argmax(1)][ok]
                score[lo:hi][ok] = np.clip((1 + cosine.max(1)) / 2, 0, 1)[ok]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best.tolist(), pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(of, schema)


def held_out_split(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, lang and held_out."""
    part = F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), "text", "lang", (part == 2).alias("held_out"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out_split(table(spark, sf_dir, "documents"))
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
