"""Best-fit packing of token sequences, improved by swap-based local search.

Every document becomes its ids and a closing id; only what exceeds a sequence is cut, into full pieces and a rest. Pieces are dealt
at random into groups of about ``GROUP`` pieces, each packed by one task: best fit by decreasing length first, then a local search
over underfull bins. It moves a piece, exchanges one for one or two for one, always so that the sum of squared fills grows, from the
emptiest bin into fuller ones, until that bin is empty; it ends at the lower bound or when no step helps. A second round
dissolves each group's emptiest bins and packs these pieces together in groups of their own, so that groups don't each keep a rest.

Groups hold about ``GROUP`` pieces however large the input, and a hot text's copies are dealt like any rows.

Defined results: a null or empty text is the closing id alone. Repeated rows are documents of their own; a null ``doc_id`` stays null. An
empty table gives no rows. Ties between equally long pieces or equally full bins go to the first. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import shared_encoder
from plumbline.llm.bpe_codec import byte_blocks
from plumbline.plans.scratch import Scratch, ship, table

LENGTH, CLOSING, GROUP, LOOSE = 4096, 1, 6000, 0.01


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin that it leaves with the least room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - n, len(bins) - 1
        else:
            left, b = room.pop(at)
            left -= n
            bins[b].append(i)
        if left:
            bisect.insort(room, (left, b))
    return bins


def _steps(x: int, items: list[int], own: np.ndarray, lengths: np.ndarray, room: np.ndarray, source: int):
    """The best step that puts x of bin source, alone or with another of that bin, into a fuller bin: (gain of fill, bin, out, with)."""
    n = int(lengths[x])
    fits = np.flatnonzero((room >= n) & (np.arange(len(room)) != source))
    if len(fits):
        b = int(fits[room[fits].argmin()])
        if n + room[source] > room[b]:
            return n, b, -1, -1
    slack = room[own]  # of each item's bin
    best, most = (0, -1, -1, -1), 0  # the step that raises the sum of squares most
    other = own != source
    for extra in [-1, *[i for i in items if i != x]]:
        put = n + (int(lengths[extra]) if extra >= 0 else 0)
        grow = put - lengths
        rise = np.where(other & (grow > 0) & (grow <= slack), grow * (grow + room[source] - slack), 0)
        y = int(rise.argmax())
        if rise[y] > most:
            most, best = int(rise[y]), (int(grow[y]), int(own[y]), y, extra)
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges from emptier bins into fuller ones, each raising the sum of squared fills, until bins empty.

    Sources are the underfull bins from the emptiest on; an emptied bin goes and the search starts over. It ends at the lower
    bound on bins, or when a whole pass finds no step. The sum of squares only grows, so it ends.
    """
    least = -(-int(lengths.sum()) // capacity)
    bins = [list(b) for b in bins]
    own = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        own[b] = k
    room = capacity - np.bincount(own, lengths, len(bins)).astype(np.int64)
    live = len(bins)
    while live > least:
        emptied = changed = False
        for source in np.argsort(-room, kind="stable").tolist():
            if not bins[source] or not room[source]:
                continue
            while bins[source]:
                item, step = -1, (0, -1, -1, -1)
                for x in sorted(bins[source], key=lambda i: -lengths[i]):
                    step = _steps(x, bins[source], own, lengths, room, source)
                    if step[0]:
                        item = x
                        break
                if item < 0:
                    break
                changed = True
                gain, b, out, extra = step
                for i in [item] + ([extra] if extra >= 0 else []):
                    bins[source].remove(i)
                    bins[b].append(i)
                    own[i] = b
                if out >= 0:
                    bins[b].remove(out)
                    bins[source].append(out)
                    own[out] = source
                room[b] -= gain
                room[source] += gain
            if not bins[source]:
                live, emptied = live - 1, True
                room[source] = -1  # gone: nothing fits
                break
        if not (emptied or changed):
            break
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    """The bin of each length, bins by falling fill."""
    lengths = np.asarray(lengths, np.int64)
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    bins.sort(key=lambda b: -int(lengths[b].sum()))
    out = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, closing: int = CLOSING, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; with ids also the ids."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one tokenizer file

    def run(batches):
        encoder = shared_encoder(content.value)
        for batch in batches:
            for first, texts in byte_blocks(batch["text"]):
                flat, counts = encoder.encode(texts)
                out = []
                for k, (lo, n) in enumerate(zip((np.cumsum(counts) - counts).tolist(), counts.tolist())):
                    own = np.append(flat[lo : lo + n], closing).astype("<u4")
                    name = batch["doc_id"].iloc[first + k]
                    for p, at in enumerate(range(0, len(own), length)):
                        part = own[at : at + length]
                        out.append((name, p, at, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if ids else [])))
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def _groups(rows: DataFrame, n: int, round_: int, length: int, loose: float) -> DataFrame:
    """Packs groups; each piece gets its sequence and place, or, in one of its group's emptiest bins, none."""

    def pack(key, pdf):
        bin_ = pack_lengths(pdf["length"].to_numpy(), length)
        fill = np.bincount(bin_, pdf["length"])
        keep = len(fill) - (max(1, int(np.ceil(loose * len(fill)))) if loose else 0)
        keep = max(keep, int((fill == length).sum()))
        order = np.lexsort((np.arange(len(bin_)), bin_))
        size = pdf["length"].to_numpy()[order]
        first = np.r_[True, bin_[order][1:] != bin_[order][:-1]] if len(order) else np.zeros(0, bool)
        before = np.cumsum(size) - size
        place = np.empty(len(bin_), np.int64)
        place[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        done = bin_ < keep
        return pd.DataFrame({"uid": pdf["uid"], "length": pdf["length"], "sequence_id": (key[0] << 24 | round_ << 22) + bin_, "offset": place, "done": done})

    groups = max(1, -(-n // GROUP))
    dealt = rows.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)).cast("long").alias("g"))
    return dealt.groupBy("g").applyInPandas(pack, "uid long, length long, sequence_id long, offset long, done boolean")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, closing: int = CLOSING, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.write(pieces(docs, tokenizer, length, closing, text, doc_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    first = scratch.write(_groups(rows, rows.count(), 0, length, LOOSE), "first")
    rest = first.filter(~F.col("done"))
    second = _groups(rest, rest.count(), 1, length, 0.0)
    placed = first.filter("done").unionByName(second).select("uid", "sequence_id", "offset")
    return rows.join(placed, "uid").drop("uid")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
