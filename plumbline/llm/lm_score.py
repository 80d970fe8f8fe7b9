"""Language-model scores of texts from a causal self-attention model over subword ids, beside a word-unigram base.

Words (A to Z in lower case, runs of anything but ASCII white space) are encoded one by one as `` word`` by a byte-level tokenizer, so a
text's ids are its words' ids and a closing id. The probability of an id is that of its class, which ``attention`` gives from what stands before
it, times that of its type in the class, times that of the id in its type:

* types: the ``TYPES - 2`` most frequent ids are types of their own, the others are one of two types, by whether they begin a word; an id's share
  of its type is its smoothed share of the corpus counts;
* classes: types that stand in like surroundings (k-means over the leading directions of the table of neighbouring types);
* a type's share of its class is its smoothed share after the type before it.

What is learnt, and from what:
* word counts: every word of every training text. One row for each word of the corpus, so they grow with it. The base and the ids' counts follow;
* the table of neighbouring types: every id of every training text, the closing one included;
* the attention weights: windows that tile every training text, so that each of its ids and the closing one is a target once. A round takes the
  texts of one part of ``ROUNDS`` (by a hash of the text); tasks train on theirs by Adam from the same weights, which are then averaged in fixed point.

The training part is fixed by crc32(doc_id as text) mod 10 <> 0; a null id counts as the empty string.

The base's sum needs each word's count at each text. The at most ``2**18`` words with a ``2**-18`` share of all words are broadcast with their counts (no
more words can have that share). The others' occurrences travel once, in blobs, to buckets of words that also get the counts; a bucket
returns one partial sum a text. No bucket holds a word with more than that share. There words are 96 bits of two hashes: among n
different words two meet with a chance of n * n / 2**97. Within a task words are told apart by their bytes.

Defined results: a null or empty text is the closing token alone. Repeated rows count and score as often as they occur; a null ``doc_id`` stays null. Without
any training text, N is 0 and all ids are equally likely within their types. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import attention
from plumbline.llm.bpe import Encoder, ranges, shared_encoder
from plumbline.llm.bpe_codec import byte_blocks
from plumbline.llm.hashing import equal, groups, hashes
from plumbline.plans.scratch import Scratch, ship, table

HEAVY, ADD, FIXED, BUCKET = 1 << 18, 0.1, 1 << 24, 300_000
TYPES, PRIOR, RATES = 2048, 5.0, (0.01, 0.004)
ROUNDS, PART = len(RATES), 32
#: A word with its count in the training texts.
COUNT = np.dtype([("hash", "<u8"), ("more", "<u4"), ("c", "<i8")])
#: A word's occurrences in a text; more than 65,535 are several entries.
ENTRY = np.dtype([("hash", "<u8"), ("more", "<u4"), ("text", "<u2"), ("n", "<u2")])


def split(texts: list[bytes]):
    """Bytes, starts, lengths and text numbers of all words; one of each distinct word, and which each is."""
    data = np.frombuffer(b"".join(texts), np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    sizes = np.array([len(t) for t in texts], np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[np.cumsum(sizes)] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.r_[True, space[:-1]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (edge[1:] | np.r_[space[1:], True])) + 1 if len(data) else starts
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    return data, starts, ends - starts, doc, *groups(data, starts, ends - starts)


def word_ids(encoder: Encoder, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return encoder.encode_chunks([b" " + w for w in words])


def run_ids(encoder: Encoder, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_ids`` of words that are runs of data."""
    spaced = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    at = np.cumsum(lengths + 1) - lengths
    spaced[ranges(at, lengths)] = data[ranges(starts, lengths)]
    return encoder.encode_runs(spaced, lengths + 1)


class Types:
    """The types of ids, and the logarithm of each id's share of its type."""

    def __init__(self, counts: np.ndarray, closing: int, begins: np.ndarray):
        ahead = counts.copy()
        ahead[closing] = counts.sum() + 1
        order = np.argsort(-ahead, kind="stable")
        self.type_of = np.where(begins, TYPES - 2, TYPES - 1)
        self.type_of[order[: TYPES - 2]] = np.arange(TYPES - 2)
        total = np.bincount(self.type_of, counts + 0.5, TYPES)
        self.share = np.log((counts + 0.5) / total[self.type_of])
        self.closing = int(self.type_of[closing])


def classes_of(joint: np.ndarray, closing: int, classes: int = attention.CLASSES, width: int = 32) -> np.ndarray:
    """A class for each type, by what stands before and after it; class 0 is the closing type's alone."""
    n = joint.sum(0)
    row, col, total = joint.sum(1) + 1.0, joint.sum(0) + 1.0, joint.sum() + 1.0
    near = np.maximum(0, np.log((joint + 1e-9) * total / row[:, None] / col)).astype(np.float32)
    both = np.concatenate([near, near.T], axis=1)
    basis = both @ np.random.default_rng(5).standard_normal((both.shape[1], width + 8)).astype(np.float32)
    for _ in range(3):
        basis = both @ (both.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    turn, size, _ = np.linalg.svd(basis.T @ both, full_matrices=False)
    place = (basis @ turn[:, :width]) * size[:width]
    place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-6
    others = np.delete(np.arange(len(joint)), closing)
    order = others[np.argsort(-n[others], kind="stable")]
    centre, weight = place[order[: classes - 1]].copy(), np.sqrt(n[others] + 0.01)
    for _ in range(20):
        near_to = (place[others] @ centre.T).argmax(1)
        for k in range(classes - 1):
            own = near_to == k
            if own.any():
                centre[k] = (place[others[own]] * weight[own, None]).sum(0)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-6
    kind = np.zeros(len(joint), np.int64)
    kind[others] = near_to + 1
    return kind


class Model:
    """Classes of types, the classes' frequencies after each type, and types' shares of their class there. Its size is fixed."""

    def __init__(self, joint: np.ndarray, closing: int):
        classes = attention.CLASSES
        self.kind = classes_of(joint, closing)
        n = joint.sum(0)
        member = (n + 0.5) / np.bincount(self.kind, n + 0.5, classes)[self.kind]
        class_share = np.bincount(self.kind, n + 0.5, classes)
        class_share = np.maximum(class_share, 0.5) / np.maximum(class_share, 0.5).sum()
        by_class = np.zeros((len(joint), classes))
        for k in range(classes):
            by_class[:, k] = joint[:, self.kind == k].sum(1)
        self.prior = ((by_class + PRIOR * class_share) / (by_class.sum(1, keepdims=True) + PRIOR)).astype(np.float32)
        self.within = np.log((joint + PRIOR * member) / (by_class[:, self.kind] + PRIOR)).astype(np.float32)


def count_words(docs: DataFrame, scratch: Scratch, most: int = 1 << 20) -> DataFrame:
    """word, c: all words of the training texts. A task adds up runs of about most words that differ within a block before it sends them."""

    def added(held):
        import pyarrow as pa

        data, lengths, c = (np.concatenate(x) for x in zip(*held))
        starts = np.cumsum(lengths) - lengths
        one, which = groups(data, starts, lengths)
        # The words' bytes go into Arrow's own layout: one run of bytes, and where each word begins.
        place = np.concatenate([[0], np.cumsum(lengths[one])]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(place), pa.py_buffer(data[ranges(starts[one], lengths[one])])])
        return pa.RecordBatch.from_arrays([words, pa.array(np.rint(np.bincount(which, c)).astype(np.int64))], names=["word", "c"])

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for _, texts in byte_blocks(batch.column(0).to_pylist()):
                data, starts, lengths, _, one, which = split(texts)
                if len(starts):
                    held.append((data[ranges(starts[one], lengths[one])], lengths[one], np.bincount(which)))
                    n += len(one)
                if n >= most:
                    yield added(held)
                    held, n = [], 0
        if held:
            yield added(held)

    parts = docs.filter("not held_out and text is not null").select("text").mapInArrow(count, "word binary, c long")
    return scratch.write(parts.groupBy("word").agg(F.sum("c").alias("c")), "words")


def count_ids(words: DataFrame, content, texts: int) -> Types:
    """The types, from the corpus's words; texts: how many closing ids there are."""
    closing = json.loads(content.value)["added_tokens"][0]["id"]
    size = closing + 1

    def ids(batches):
        encoder, total = shared_encoder(content.value), np.zeros(size, np.int64)
        for batch in batches:
            got, n = word_ids(encoder, [bytes(w) for w in batch["word"]])
            total += np.bincount(got, np.repeat(batch["c"].to_numpy(), n), size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "c": total[at]})

    counts = np.zeros(size, np.int64)
    for r in words.mapInPandas(ids, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():  # one row an id
        counts[r["id"]] = r["c"]
    counts[closing] += texts
    encoder = shared_encoder(content.value)
    begins = np.zeros(size, bool)
    full = np.flatnonzero(encoder.text_len[:size])
    begins[full] = encoder.text[encoder.text_at[full]] == 32
    return Types(counts, closing, begins)


def _joint_rows(joint: np.ndarray):
    for k in range(0, TYPES, PART):
        yield k // PART, zlib.compress(joint[k : k + PART].tobytes(), 1)


def _add_joint(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART * TYPES, np.int64)
    for d in pdf["data"]:
        total += np.frombuffer(zlib.decompress(d), np.int64)
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "data": [zlib.compress(total.tobytes(), 1)]})


def count_pairs(scanned: DataFrame) -> np.ndarray:
    """How often each type follows each other one in the training texts; a table of fixed size, added up in two steps."""
    some = scanned.filter("kind = 2").select("bucket", "data", (F.spark_partition_id() % 16).alias("salt")).groupBy("bucket", "salt").applyInPandas(_add_joint, "bucket long, data binary")
    joint = np.zeros((TYPES, TYPES), np.int64)
    for r in some.groupBy("bucket").applyInPandas(_add_joint, "bucket long, data binary").collect():  # TYPES / PART rows
        joint[r["bucket"] * PART : (r["bucket"] + 1) * PART] = np.frombuffer(zlib.decompress(r["data"]), np.int64).reshape(PART, TYPES)
    return joint


def pairs_of(types: np.ndarray, counts: np.ndarray, closing: int) -> np.ndarray:
    """The pairs (before * TYPES + after) of texts of counts types each, from the closing type before to the one after a text."""
    flat = np.full(len(types) + 2 * len(counts), closing, np.int64)
    flat[np.arange(len(types)) + 2 * np.repeat(np.arange(len(counts)), counts) + 1] = types
    pair = flat[:-1] * TYPES + flat[1:]
    return np.delete(pair, np.cumsum(counts + 2)[:-1] - 1)


def _portions(batch: pd.DataFrame, limit: int = 1 << 20):
    """(first row, types, counts) of runs of rows with about limit types."""
    size = batch["data"].map(len).to_numpy(np.int64) // 2
    lo = n = 0
    for i, s in enumerate(size.tolist()):
        n += s
        if n >= limit or i == len(size) - 1:
            yield lo, np.frombuffer(b"".join(batch["data"].iloc[lo : i + 1]), "<u2").astype(np.int64), size[lo : i + 1]
            lo, n = i + 1, 0


def training_windows(batches, closing: int):
    """Inputs and targets of windows that tile all texts of the batches, in portions."""
    for batch in batches:
        for _, types, counts in _portions(batch):
            yield attention.windows(types, counts, closing)[:2]


def fit(scanned: DataFrame, model, closing: int) -> dict[str, np.ndarray]:
    """The attention weights, from the training texts' windows; model is broadcast."""
    spark = scanned.sparkSession
    weights = attention.init()
    names = sorted(weights)
    train = scanned.filter("kind = 0 and not held_out").select("data")
    for part, rate in enumerate(RATES):
        now = spark.sparkContext.broadcast(weights)  # a fixed number of weights

        def learn(batches):
            m, adam = model.value, attention.Adam(now.value, rate)
            for x, y in training_windows(batches, closing):
                order = np.random.default_rng(part).permutation(len(x))
                for lo in range(0, len(order), attention.BATCH):
                    adam.learn(x[order[lo : lo + attention.BATCH]], y[order[lo : lo + attention.BATCH]], m.kind, m.prior)
            if adam.windows:
                yield pd.DataFrame({"i": np.arange(-1, len(adam.flat)), "v": np.r_[adam.windows, np.rint(adam.flat.astype(np.float64) * FIXED).astype(np.int64) * adam.windows]})

        own = train.filter(F.pmod(F.xxhash64("data"), F.lit(ROUNDS)) == part)
        sums = own.mapInPandas(learn, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a row a weight
        sums = {r["i"]: int(r["v"]) for r in sums}
        if not sums.get(-1):
            continue
        flat, at = np.array([sums[i] / sums[-1] / FIXED for i in range(len(sums) - 1)], np.float32), 0
        for k in names:
            weights[k] = flat[at : at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size
    return weights


def text_scores(weights: dict, model: Model, types: np.ndarray, counts: np.ndarray, closing: int) -> np.ndarray:
    """Natural log probability of each text's types and the closing one."""
    x, y, text = attention.windows(types, counts, closing)
    per_class = np.bincount(text, attention.score(weights, x, y, model.kind, model.prior), len(counts))
    pair = pairs_of(types, counts, closing)
    within = model.within.ravel()[pair].astype(np.float64)
    return per_class + np.bincount(np.repeat(np.arange(len(counts)), counts + 1), within, len(counts))


def scan(docs: DataFrame, content, types, heavy, buckets: int) -> DataFrame:
    """Rows: kind 0, a text with its types, base sum over common words and shares of ids; kind 1, a bucket's entries of other words;
    kind 2, a part of the task's table of neighbouring types."""

    def run(batches):
        from pyspark import TaskContext

        encoder, t = shared_encoder(content.value), types.value
        names = sorted(heavy.value)
        packed = np.frombuffer(b"".join(names), np.uint8)
        sizes = np.array([len(w) for w in names], np.int64)
        place = np.cumsum(sizes) - sizes
        keys = hashes(packed, place, sizes) if names else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys, sizes, place = keys[order], sizes[order], place[order]
        logs = np.log10(np.array([heavy.value[w] for w in names], float) + ADD)[order]
        known_ids, known_size = word_ids(encoder, [names[i] for i in order.tolist()])
        known_at = np.cumsum(known_size) - known_size
        block, joint, pairs = TaskContext.get().partitionId() << 32, np.zeros(TYPES * TYPES, np.int64), []

        def add_pairs():
            nonlocal joint, pairs
            if pairs:
                joint, pairs = joint + np.bincount(np.concatenate(pairs), minlength=len(joint)), []

        for batch in batches:
            for first, texts in byte_blocks(batch["text"]):
                block += 1
                rows = batch.iloc[first : first + len(texts)]
                data, starts, lengths, doc, one, which = split(texts)
                raw, count = data.tobytes(), len(texts)
                n = np.bincount(doc, minlength=count)
                h = hashes(data, starts[one], lengths[one])
                slot = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                common = (keys[slot] == h) & (sizes[slot] == lengths[one]) if len(keys) else np.zeros(len(one), bool)
                c = np.flatnonzero(common)
                if not equal(np.concatenate([packed, data]), place[slot[c]], len(packed) + starts[one[c]], lengths[one[c]]):
                    common[c] = [raw[s : s + m] == names[order[k]] for s, m, k in zip(starts[one[c]].tolist(), lengths[one[c]].tolist(), slot[c].tolist())]
                rare = one[~common]
                fresh, fresh_size = run_ids(encoder, data, starts[rare], lengths[rare])
                got, at, size = np.concatenate([known_ids, fresh]), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
                at[common], size[common] = known_at[slot[common]], known_size[slot[common]]
                at[~common], size[~common] = len(known_ids) + np.cumsum(fresh_size) - fresh_size, fresh_size
                ids = got[ranges(at[which], size[which])]
                per_text = np.bincount(doc, size[which], count).astype(np.int64)
                share = np.bincount(np.repeat(np.arange(count), per_text), t.share[ids], count)
                kinds = t.type_of[ids].astype("<u2")
                train = ~rows["held_out"].to_numpy(bool)
                use = np.repeat(train, per_text)
                pairs.append(pairs_of(kinds[use], per_text[train], t.closing))
                if sum(map(len, pairs)) > 1 << 22:
                    add_pairs()
                hit = common[which]
                base = np.bincount(doc[hit], logs[slot[which[hit]]], count) if hit.any() else np.zeros(count)
                known = np.bincount(doc[hit], minlength=count)
                flat, ends = kinds.tobytes(), 2 * np.cumsum(per_text)
                yield pd.DataFrame({"kind": 0, "block": block, "bucket": 0, "text": np.arange(count), "doc_id": rows["doc_id"].astype("Int64").to_numpy(), "held_out": ~train, "n_tokens": n + 1, "known": known, "base": base, "share": share, "data": [flat[b - 2 * m : b] for b, m in zip(ends.tolist(), per_text.tolist())]}).astype({"doc_id": "Int64"})
                # The other words: how often each is in each text, to its bucket.
                pair, times = np.unique(doc[~hit] * np.int64(max(1, len(one))) + which[~hit], return_counts=True)
                if not len(pair):
                    continue
                word = pair % len(one)
                e = np.empty(len(pair), ENTRY)
                more = np.zeros(len(one), np.uint64)
                more[~common] = hashes(data, starts[rare], lengths[rare], 1)
                e["hash"], e["more"], e["text"], e["n"] = h[word], (more >> np.uint64(32))[word], pair // len(one), np.minimum(times, 65535)
                long = [np.repeat(e[i : i + 1], -(-(times[i] - 65535) // 65535)) for i in np.flatnonzero(times > 65535)]
                for part, i in zip(long, np.flatnonzero(times > 65535)):
                    part["n"][-1] = (times[i] - 1) % 65535 + 1
                if long:
                    e = np.concatenate([e, *long])
                    e = e[np.argsort(e["text"], kind="stable")]
                bucket = (e["hash"] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                e, bucket = e[by], bucket[by]
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                yield pd.DataFrame({"kind": 1, "block": block, "bucket": bucket[edges[:-1]], "text": 0, "doc_id": pd.array([None] * (len(edges) - 1), "Int64"), "held_out": False, "n_tokens": 0, "known": 0, "base": 0.0, "share": 0.0, "data": [e[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])]})
        add_pairs()
        if joint.any():
            parts = list(_joint_rows(joint.reshape(TYPES, TYPES)))
            yield pd.DataFrame({"kind": 2, "block": 0, "bucket": [k for k, _ in parts], "text": 0, "doc_id": pd.array([None] * len(parts), "Int64"), "held_out": False, "n_tokens": 0, "known": 0, "base": 0.0, "share": 0.0, "data": [d for _, d in parts]})

    return docs.mapInPandas(run, "kind int, block long, bucket long, text long, doc_id long, held_out boolean, n_tokens long, known long, base double, share double, data binary")


def _hashed(buckets: int, most: int = 1 << 18):
    """Packs words with their counts, by bucket: a row for each bucket of about most words."""

    def packed(held):
        import pyarrow as pa

        e = np.concatenate(held)
        bucket = (e["hash"] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        e, bucket = e[by], bucket[by]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([e[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])], pa.binary())], names=["bucket", "data"])

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words, c = batch.column(0), batch.column(1).to_numpy()
            _, place, raw = words.buffers()
            place = np.frombuffer(place, np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            e = np.empty(len(words), COUNT)
            e["hash"], e["more"], e["c"] = hashes(data, place[:-1], np.diff(place)), hashes(data, place[:-1], np.diff(place), 1) >> np.uint64(32), c
            held.append(e)
            n += len(e)
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _gather(entries: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """A bucket's entries with its words' counts: sums of logarithms and of known words for each text."""
    have = np.concatenate([np.zeros(0, COUNT), *[np.frombuffer(d, COUNT) for d in counts["data"]]])
    have = have[np.lexsort((have["more"], have["hash"]))]
    keys, more, c = (np.ascontiguousarray(have[n]) for n in ("hash", "more", "c"))
    out = []
    for block, data in zip(entries["block"], entries["data"]):
        e = np.frombuffer(data, ENTRY)
        found = np.zeros(len(e))
        slot, open_ = np.searchsorted(keys, e["hash"]), np.arange(len(e))
        while len(open_ := open_[slot[open_] < len(keys)]):  # words of one hash stand side by side
            same = keys[slot[open_]] == e["hash"][open_]
            hit = same & (more[slot[open_]] == e["more"][open_])
            found[open_[hit]] = c[slot[open_[hit]]]
            open_ = open_[same & ~hit]
            slot[open_] += 1
        new = np.r_[True, e["text"][1:] != e["text"][:-1]]  # a blob's entries are in the order of texts
        text, at = e["text"][new], np.cumsum(new) - 1
        base = np.bincount(at, e["n"] * np.log10(found + ADD))
        known = np.bincount(at, e["n"] * (found > 0)).astype(np.int64)
        out.append((block, text.astype("<u4").tobytes(), base.tobytes(), known.tobytes()))
    return pd.DataFrame(out, columns=["block", "texts", "base", "known"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    t = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["texts"]])
    text, at = np.unique(t, return_inverse=True)
    base = np.bincount(at, np.concatenate([np.frombuffer(x, float) for x in pdf["base"]]))
    known = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["known"]]))
    return pd.DataFrame({"block": pdf["block"].iloc[0], "text": text.astype(np.int64), "more_base": base, "more_known": known.astype(np.int64)})


def lm_scores(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one tokenizer file
    part = F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 10
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (part == 0).alias("held_out"))
    words = count_words(docs, scratch)
    texts = docs.filter("not held_out").count()
    n_words, distinct = (int(x or 0) for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    total, vocabulary = n_words + texts, distinct + (1 if texts else 0)
    types = count_ids(words, content, texts)
    common = words.filter(F.col("c") * HEAVY >= total).collect()  # at most HEAVY words can have that share
    heavy = spark.sparkContext.broadcast({bytes(r["word"]): r["c"] for r in common})
    buckets = max(32, total // 4 // BUCKET)
    scanned = scratch.write(scan(docs, content, spark.sparkContext.broadcast(types), heavy, buckets), "scanned")
    model = spark.sparkContext.broadcast(Model(count_pairs(scanned), types.closing))  # TYPES by TYPES numbers
    closing = types.closing
    weights = spark.sparkContext.broadcast(fit(scanned, model, closing))

    rare = words.filter(F.col("c") * HEAVY < total).select("word", "c").mapInArrow(_hashed(buckets), "bucket long, data binary")
    partial = scanned.filter("kind = 1").select("bucket", "block", "data").groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInPandas(_gather, "block long, texts binary, base binary, known binary")
    sums = partial.groupBy("block").applyInPandas(_add, "block long, text long, more_base double, more_known long")
    end_share = float(types.share[np.flatnonzero(types.type_of == closing)[0]])

    def attend(batches):
        m, w = model.value, weights.value
        for batch in batches:
            for lo, kinds, counts in _portions(batch):
                rows = batch.iloc[lo : lo + len(counts)]
                score = (text_scores(w, m, kinds, counts, closing) + rows["share"].to_numpy() + end_share) / np.log(10)
                yield rows.drop(columns=["share", "data"]).assign(score=score).astype({"doc_id": "Int64"})

    kept = "block long, text long, doc_id long, held_out boolean, n_tokens long, known long, base double"
    rows = scanned.filter("kind = 0").select("block", "text", "doc_id", "held_out", "n_tokens", "known", "base", "share", "data").mapInPandas(attend, kept + ", score double")
    rows = rows.join(sums, ["block", "text"], "left")
    closing_log = float(np.log10(texts + ADD))  # the closing token is known if there is a training text
    scale = float(np.log10(total + ADD * (vocabulary + 1)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if texts else 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + closing_log - F.col("n_tokens") * scale).alias("base_score"), "score",
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
