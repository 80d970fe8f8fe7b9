"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent chunks of the corpus (a word with the white space before it) are compiled, with their ids as output, into a shared-suffix
automaton (``automaton``), which each worker process maps into memory once. Chunks the automaton lacks are merged exactly (``bpe``). The ids
are those of the tokenizers library either way: the lexicon only saves merging.

Which chunks are frequent: each task counts all chunks of all its texts and reports those with at least a ``SHARE`` of them, so any chunk with
that share of the corpus is reported by some task; the ``WORDS`` with the largest sums form the lexicon. Its size, and that of
what reaches the driver, is bounded by ``WORDS`` however large the corpus.

Defined results: null and empty texts have no ids and decode to the empty text. Special strings inside texts become their ids, and decode to themselves.
Repeated rows give repeated results; a null ``doc_id`` stays null; an empty table gives no rows. Extra columns are ignored. Texts go through in
blocks of about ``BLOCK`` bytes; a longer text is a block of its own.
"""

from __future__ import annotations

import hashlib
import mmap

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.automaton import Automaton, compile
from plumbline.llm.bpe import LONG, shared_encoder
from plumbline.llm.hashing import groups
from plumbline.plans.scratch import ship, table

SHARE, WORDS, BLOCK = 1 / (1 << 16), 1 << 16, 1 << 21


def byte_blocks(texts, size: int = BLOCK, rows: int = 1 << 15):
    """(first row, texts as bytes) of runs of about so many bytes, and no more than so many rows."""
    out, n, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8") if isinstance(t, str) else b""
        out.append(b)
        n += len(b)
        if n >= size or len(out) >= rows:
            yield first, out
            out, n, first = [], 0, i + 1
    if out:
        yield first, out


_MAPPED: dict[bytes, Automaton] = {}


def mapped(buffer: bytes) -> Automaton:
    """The compiled lexicon in a memory map of the process, made once for all its tasks; no folder of the machine is used."""
    digest = hashlib.sha256(buffer).digest()
    if digest not in _MAPPED:
        _MAPPED.clear()
        area = mmap.mmap(-1, len(buffer))
        area.write(buffer)
        _MAPPED[digest] = Automaton(area)
    return _MAPPED[digest]


def frequent_chunks(docs: DataFrame, content, text: str = "text", share: float = SHARE, words: int = WORDS) -> list[bytes]:
    """The lexicon's entries, from all texts; content: the broadcast tokenizer."""

    def count(batches):
        encoder, total, tally = shared_encoder(content.value), 0, {}
        for batch in batches:
            for _, texts in byte_blocks(batch["text"]):
                data, starts, lengths, _ = encoder.chunks(texts)
                if not len(starts):
                    continue
                total += len(starts)
                one, which = groups(data, starts, lengths)
                n = np.bincount(which)
                raw = data.tobytes()
                for i in np.flatnonzero(n > 1):
                    s = starts[one[i]]
                    if lengths[one[i]] <= LONG:
                        w = raw[s : s + lengths[one[i]]]
                        tally[w] = tally.get(w, 0) + int(n[i])
                if len(tally) > 8 * words:
                    tally = {w: c for w, c in tally.items() if c >= share * total}
        tally = {w: c for w, c in tally.items() if c >= share * total}
        if tally:
            yield pd.DataFrame({"chunk": list(tally), "n": list(tally.values())})

    found = docs.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(count, "chunk binary, n long")
    top = found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(words)  # the lexicon's size is a parameter
    return [bytes(r["chunk"]) for r in top.select("chunk").collect()]


def codec(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256; with ids also the ids and the decoded text."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one tokenizer file
    words = frequent_chunks(docs, content, text)
    encoder = shared_encoder(content.value)
    got, count = encoder.encode_chunks(words)
    at = np.cumsum(count) - count
    buffer = compile({w: got[a : a + n].tolist() for w, a, n in zip(words, at, count)})
    lexicon = spark.sparkContext.broadcast(buffer)  # no more than WORDS entries
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def run(batches):
        encoder = shared_encoder(content.value)
        encoder.automaton = mapped(lexicon.value)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if ids else {})
            for _, texts in byte_blocks(batch["__text"]):
                flat, counts = encoder.encode(texts)
                for lo, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist()):
                    one = flat[lo : lo + n]
                    decoded = encoder.decode(one).decode("utf-8", "replace")
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if ids:
                        out["ids"].append(one.tolist())
                        out["decoded"].append(decoded)
            yield pd.DataFrame({**{c: batch[c] for c in keep}, **out})

    more = ", ids array<int>, decoded string" if ids else ""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    return rows.mapInPandas(run, ", ".join([*names, "n_tokens long, ids_sha256 string, decoded_sha256 string"]) + more)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
