"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a Parquet table of (content digest, tokenizer digest, tokens), in a folder for each tokenizer. Documents are digested where they
are read and joined with it, which gives every known count; of the others one text for each digest is encoded, and appended. Their counts come
back to the rows by a join on the digest, so a text with a million copies is encoded once, and one that any run has seen not at all.
``op1_token_counts`` keeps a cache for each folder of tables in the shared folder, where later runs over the same tables find it.

Normalisation is what leaves every count as the tokenizer gives it: null becomes the empty text, and nothing else
changes. The tokenizer digest is that of its file's bytes, so another version never meets these counts.

Recovery: a run appends through Spark's committer; an append that dies leaves no rows, one that is repeated leaves equal rows, which the
join sees once. Two runs at a time may both encode and append a text. Memory: encoding goes in blocks of about a million characters. Hot texts: the rows' side of the joins is split by adaptive
execution where a digest is frequent; the other side has one row for each digest.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; a null ``doc_id`` stays null. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.scratch import Scratch, shared_folder, ship, table

LIMIT, BLOCK = 1024, 1 << 20
CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def blocks(texts: list[str], size: int = BLOCK):
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def encoder(content: str):
    """Counts tokens of texts with the library; special strings inside texts as its default has it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(content)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and n_tokens; cache is the folder of the cache, which need not exist."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one tokenizer file
    version = tokenizer_digest(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(doc_id, F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("__digest"))
    scratch = Scratch(spark, "counts")
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    stored = stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = scratch.write(rows.join(stored.withColumnRenamed("digest", "__digest"), "__digest", "left"), "looked")

    missing = rows.filter("n_tokens is null").groupBy(F.col("__digest").alias("digest")).agg(F.min(doc_id).alias("id"))
    missing = scratch.write(missing, "missing")
    if missing.isEmpty():  # no text needs to be read again
        return rows.select(doc_id, "n_bytes", "n_tokens")
    missing = missing.hint("merge").alias("m")
    # The text travels once, dealt by digest and id, so that copies spread; that of one id for each missing digest is encoded.
    texts = docs.select(F.col(doc_id).alias("id"), body.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256))).alias("d")
    texts = texts.join(missing, (F.col("d.digest") == F.col("m.digest")) & F.col("d.id").eqNullSafe(F.col("m.id")), "left_semi").select("digest", "text")

    def encode(batches):
        count, seen = encoder(content.value), set()  # rows of one id and text are in one task
        for batch in batches:
            batch = batch[~batch["digest"].isin(seen) & ~batch["digest"].duplicated()]
            seen.update(batch["digest"])
            n = [c for run in blocks(batch["text"].tolist()) for c in count(run)]
            yield pd.DataFrame({"digest": batch["digest"], "tokenizer": version, "n_tokens": n})

    fresh = scratch.write(texts.mapInPandas(encode, CACHE), "fresh").dropDuplicates(["digest"])
    if not fresh.isEmpty():
        fresh.write.mode("append").partitionBy("tokenizer").parquet(cache)
    new = fresh.select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("counted"))
    out = rows.join(new, "__digest", "left").withColumn("n_tokens", F.coalesce("n_tokens", "counted"))
    return out.select(doc_id, "n_bytes", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_folder(spark)}/plumbline-token-cache/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
