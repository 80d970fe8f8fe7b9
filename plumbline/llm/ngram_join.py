"""N-gram Jaccard join by prefix trees, exact at 0.75 over sets of five-word shingles.

1. Every text's set gets a 128-bit id (equal sets, one id); a sketch of bounded size counts shingles over all texts.
2. All sets follow one global order: rare shingles first by the sketch, ties by hash. An order decides only how much work there is, never the
   result. Two similar sets share a shingle within their first (1 - 0.75) * n + 1 in that order. These prefixes meet by shingle, in
   buckets; a set that occurs often in a task goes there once.
3. The sets of one shingle that three bounds leave similar (sizes, places in the order, parity bitmaps; no similar pair is lost) are joined into
   groups: a task emits one edge a set, to the least set of its group, never pairs. Connected components of these edges are the neighbourhoods,
   so similar sets are always in one neighbourhood. Bitmaps of 512 bits can't tell long sets apart; neighbourhoods that a cell can't hold are therefore
   made once more by bitmaps of at least as many bits as a set has shingles, so that long texts don't link up by chance as their number grows.
4. The whole sets of neighbourhoods travel, each text once, to cells of about ``CHUNK`` sets. A cell stores its sets in a trie in the
   global order and joins all of them with it in one traversal, in which probes share the path's partial overlaps and leave subtrees by remaining-length
   bounds (``prefix_trie``). Small neighbourhoods share a cell; a large one is split into blocks, and each two blocks meet in a cell of
   their own, so every pair of its sets meets exactly once.
5. A cell gives a row a set: how many sets it is similar to, and the least set that it is linked with. Sums of the counts are the numbers of links;
   the components of neighbourhoods that one cell holds are final, those of split ones follow from the cells' edges.

``near_components`` gives a row a document: its number of links (other sets that its own is similar to; equal sets count once) and its
component. Every similar pair is verified and counted, none is written. ``near_links`` writes the pairs, for callers who want them: a
group of n similar texts has up to n * (n - 1) / 2.

Growth: what is broadcast has a bounded size: the sketch (a byte a counter, 4 to 32 MiB by the input) and a filter of ``FILTER`` bits, which lets texts travel that are in
a neighbourhood; both only decide how much is moved. Buckets grow in number with the input. A shingle that the sketch holds for very
frequent is dealt to pairs of blocks of its sets (``HOT``), and so is one that many sets of a bucket share (``WIDE``). The work within a
group of n near copies grows with n * n in compares of trie paths, and its sets travel n / ``CHUNK`` times; rows and files don't grow so.

Shingles are 56-bit hashes, which only matter within a candidate pair (see ``shingles``).

Defined results: null and empty texts and texts of white space have no shingles, link with nothing and have 0 links, their component is their own ``doc_id``. Fewer
than five words are one shingle. Repeated rows are equal sets. Rows with a null ``doc_id`` count in no component's smallest id; one whose component
holds no other id gets null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe_codec import byte_blocks
from plumbline.llm.components import components
from plumbline.llm.prefix_trie import DENOMINATOR, NUMERATOR, Trie, needed
from plumbline.llm.shingles import BITS, set_id, shingle_sets
from plumbline.plans.scratch import Scratch, ship, table

#: The sketch has a counter for about LOAD shingles, within these powers of two.
SKETCH, LOAD = (22, 25), 8
PART, FILTER, MAP_WORDS = 1 << 20, 1 << 23, 8
#: Prefix entries of a bucket; sets and items of a cell; sets of one shingle in a bucket and in a candidate task.
BUCKET, CHUNK, ITEMS, HOT, WIDE = 300_000, 384, 1 << 20, 1 << 18, 4096
ENTRY = np.dtype([("key", "<u8"), ("sid", "V16"), ("size", "<u4"), ("place", "<u4")])


#: What a counter holds above a byte.
OVER = np.dtype([("at", "<u4"), ("more", "<u4")])


def _packed(counts: np.ndarray) -> bytes:
    """A part of the sketch: a byte a counter, then what the few large ones have above it."""
    at = np.flatnonzero(counts > 255)
    over = np.empty(len(at), OVER)
    over["at"], over["more"] = at, counts[at] - 255
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + over.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    out, over = np.frombuffer(raw, np.uint8, PART).astype(np.int64), np.frombuffer(raw, OVER, offset=PART)
    out[over["at"]] += over["more"]
    return out


def _sketch_rows(counts: np.ndarray) -> pd.DataFrame:
    parts = [(i // PART, _packed(counts[i : i + PART])) for i in range(0, len(counts), PART)]
    return pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * len(parts), "Int64"), "digest": 0, "sid": None, "n": [k for k, _ in parts], "data": [d for _, d in parts]})


def _scan(bits: int):
    """Rows: kind 0, a document's set id, size and text digest; kind 1, a part of the task's sketch."""

    def run(batches):
        counts, seen, since = np.zeros(1 << bits, np.uint16), set(), 0
        for batch in batches:
            sid, size = [], []
            for _, texts in byte_blocks(batch["text"]):
                fresh = []
                for s in shingle_sets(texts):
                    i = set_id(s)
                    sid.append(i)
                    size.append(len(s))
                    if i not in seen:
                        seen.add(i)
                        fresh.append(s)
                if since + len(fresh) > 65_535:  # a set adds one at most to a counter
                    yield _sketch_rows(counts)
                    counts[:], since = 0, 0
                if fresh:
                    since += len(fresh)
                    for lo in range(0, len(fresh), 65_535):
                        at, c = np.unique((np.concatenate(fresh[lo : lo + 65_535]) >> np.uint64(BITS - bits)).astype(np.uint32), return_counts=True)
                        counts[at] = np.minimum(counts[at] + c, 65_535)
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "sid": sid, "n": size, "data": None})
        if since:
            yield _sketch_rows(counts)

    return run


def _add_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(_unpacked(d) for d in pdf["data"])
    return pd.DataFrame({"n": pdf["n"].iloc[:1], "data": [_packed(np.minimum(total, 1 << 32))]})


def _add_classes(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(_unpacked(d) for d in pdf["data"])
    return pd.DataFrame({"n": pdf["n"].iloc[:1], "data": [zlib.compress(np.minimum(255, np.rint(6 * np.log2(total + 1))).astype(np.uint8).tobytes(), 1)]})


def _classes(parts: DataFrame, scratch: Scratch, bits: int) -> bytes:
    """One byte for each counter: how frequent, on a logarithmic scale. Its size is fixed."""
    some = parts.select("n", "data", (F.spark_partition_id() % 16).alias("salt")).groupBy("n", "salt").applyInPandas(_add_parts, "n long, data binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in scratch.write(some.groupBy("n").applyInPandas(_add_classes, "n long, data binary"), "classes").collect():  # 32 rows at most
        out[r["n"] * PART : (r["n"] + 1) * PART] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out.tobytes()


def ordered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the global order, as keys whose own order that is."""
    bits = len(classes).bit_length() - 1
    return np.sort(classes[(shingles >> np.uint64(BITS - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(BITS) | shingles)


def parity(shingles: np.ndarray) -> bytes:
    """Bit b is set if an odd number of shingles fall on it: two sets differ in at least as many items as their maps in bits."""
    return folded(whole_parity(shingles), MAP_WORDS)


def whole_parity(shingles: np.ndarray) -> bytes:
    """The parity bitmap of the least power of two of bits, from MAP_WORDS * 64 on, that is no less than the set."""
    size = max(MAP_WORDS * 64, 1 << max(0, len(shingles) - 1).bit_length())
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(whole: bytes, words: int) -> bytes:
    """The bitmap of words * 64 bits of the same set."""
    return np.bitwise_xor.reduce(np.frombuffer(whole, "<u8").reshape(-1, words), 0).tobytes()


def prefix_length(n: int) -> int:
    return n - (-(-NUMERATOR * n // DENOMINATOR)) + 1


def _cells(block: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries dealt to the cells of their block with each block: the entry's number, and the cell. One block has cell 0."""
    at = np.repeat(np.arange(len(block)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = block[at]
    return at, np.maximum(mine, other) * (np.maximum(mine, other) + 1) // 2 + np.minimum(mine, other)


def _block(sid: np.ndarray, blocks: np.ndarray, half: int) -> np.ndarray:
    """The block of each entry, by one half of its set's id."""
    return (sid.copy().view("<u8")[half::2] % blocks.astype(np.uint64)).astype(np.int64)


def _prefix_rows(shared, buckets: int, hot: int):
    """Rows: part from 0 on, the prefixes' entries of a bucket; below 0, a set's size and parity bitmap."""

    def run(batches):
        classes, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            for _, texts in byte_blocks(batch["text"]):
                entries, sids, sizes, maps, wholes = [], [], [], [], []
                for s in shingle_sets(texts):
                    if not len(s) or (i := set_id(s)) in seen:
                        continue
                    seen.add(i)
                    keys = ordered(s, classes)[: prefix_length(len(s))]
                    e = np.empty(len(keys), ENTRY)
                    e["key"], e["sid"], e["size"], e["place"] = keys, np.void(i), len(s), np.arange(len(keys))
                    entries.append(e)
                    sids.append(i)
                    sizes.append(len(s))
                    whole = whole_parity(s)
                    maps.append(folded(whole, MAP_WORDS))
                    wholes.append(whole if len(whole) > MAP_WORDS * 8 else None)
                if not entries:
                    continue
                own = np.array([int.from_bytes(i[:4], "little") % buckets for i in sids])
                yield pd.DataFrame({"part": -1 - own, "sid": sids, "size": sizes, "map": maps, "whole": wholes, "data": None})
                e = np.concatenate(entries)
                # The most that the sketch allows a shingle's sets to be; few exceed HOT.
                most = 2.0 ** (((e["key"] >> np.uint64(BITS)).astype(float) + 0.5) / 6)
                blocks = np.maximum(1, np.ceil(most / hot)).astype(np.int64)
                at, cell = _cells(_block(e["sid"], blocks, 0), blocks)
                e = e[at]
                b = (((e["key"] + cell.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((cell, b))
                e, b, cell = e[order], b[order], cell[order]
                edges = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (cell[1:] != cell[:-1]), True])
                yield pd.DataFrame({"part": b[edges[:-1]], "sid": None, "size": cell[edges[:-1]], "map": None, "whole": None, "data": [e[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])]})

    return run


def possible(n, i, m, j):
    """Whether sets of n and m items whose first common item has the places i and j can be similar."""
    return np.minimum(n - i, m - j) >= needed(n, m)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entries of a bucket's shingles that more than one set has; those that many sets have, in cells."""
    e = np.concatenate([np.frombuffer(d, ENTRY) for d in pdf["data"]])
    outer = np.repeat(pdf["size"].to_numpy(np.int64), [len(d) // ENTRY.itemsize for d in pdf["data"]])
    half = e["sid"].copy().view("<u8")
    order = np.lexsort((half[1::2], half[::2], outer, e["key"]))
    e, outer, half = e[order], outer[order], half.reshape(-1, 2)[order]
    group = (e["key"][1:] != e["key"][:-1]) | (outer[1:] != outer[:-1])
    one = np.r_[True, group | (half[1:] != half[:-1]).any(1)]
    e, outer, group = e[one], outer[one], np.r_[True, group][one]
    first = np.flatnonzero(group)
    size = np.diff(np.r_[first, len(e)])
    many = np.repeat(size, size)
    e, outer, many = e[many > 1], outer[many > 1], many[many > 1]
    at, cell = _cells(_block(e["sid"], blocks := -(-many // WIDE), 1), blocks)
    e, raw = e[at], e["sid"][at].tobytes()
    return pd.DataFrame({"key": e["key"].astype(np.int64), "cell": outer[at] << 32 | cell, "sid": [raw[i : i + 16] for i in range(0, len(raw), 16)], "size": e["size"].astype(np.int64), "place": e["place"].astype(np.int64)})


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Maps:
    """Parity bitmaps of several sizes; two are compared at the size of the smaller one."""

    def __init__(self, maps):
        self.words = np.array([len(m) // 8 for m in maps])
        self.place, self.folds = {}, {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words >= w)
            self.place[w] = np.full(len(self.words), -1)
            self.place[w][at] = np.arange(len(at))
            self.folds[w] = np.frombuffer(b"".join(folded(maps.iloc[i], w) if self.words[i] > w else maps.iloc[i] for i in at), np.uint64).reshape(-1, w)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits at the least the maps of x and y differ."""
        out, least = np.zeros(len(x), np.int64), np.minimum(self.words[x], self.words[y])
        for w in np.unique(least).tolist():
            of = np.flatnonzero(least == w)
            for lo in range(0, len(of), step := max(1, (1 << 21) // w)):
                some = of[lo : lo + step]
                out[some] = _bits(self.folds[w][self.place[w][x[some]]], self.folds[w][self.place[w][y[some]]])
        return out


def least_linked(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least one that the links (x, y) join it with, itself included."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _pairs(first: np.ndarray, size: np.ndarray):
    """All pairs of places within groups, in portions: groups of one size together, large ones in blocks."""
    for m in np.unique(size[size > 1]).tolist():
        begin = first[size == m]
        if m <= 64:
            a, b = np.triu_indices(m, 1)
            for lo in range(0, len(begin), step := max(1, 200_000 // len(a))):
                some = begin[lo : lo + step, None]
                yield (some + a).ravel(), (some + b).ravel()
        else:
            for g in begin.tolist():
                for lo in range(0, m, 128):
                    a, b = np.arange(lo, min(lo + 128, m)), np.arange(lo, m)
                    x, y = np.broadcast_arrays(a[:, None], b[None])
                    yield g + x[x < y], g + y[x < y]


def _edges(batches):
    """Rows sorted by shingle and cell: for each set an edge to the least set that it may be similar to, by way of others in the batch."""

    def run(rows):
        key, cell = rows["key"].to_numpy(), rows["cell"].to_numpy()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        node, size, place = (rows[c].to_numpy() for c in ("node", "size", "place"))
        maps = Maps(rows["map"])
        nodes, number = np.unique(node, return_inverse=True)
        label = np.arange(len(nodes))
        for x, y in _pairs(first, np.diff(np.r_[first, len(key)])):
            apart = label[number[x]] != label[number[y]]  # what is joined already needs no second edge
            x, y = x[apart], y[apart]
            ok = possible(size[x], place[x], size[y], place[y])
            x, y = x[ok], y[ok]
            ok = maps.apart(x, y) <= size[x] + size[y] - 2 * needed(size[x], size[y])
            if ok.any():
                label = least_linked(len(nodes), np.r_[np.arange(len(nodes)), number[x[ok]]], np.r_[label, number[y[ok]]])
        at = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[at], "b": nodes[label[at]]})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows["key"] == rows["key"].iloc[-1]) & (rows["cell"] == rows["cell"].iloc[-1])
        held = rows[last].reset_index(drop=True)
        if not last.all():
            yield run(rows[~last].reset_index(drop=True))
    if held is not None and len(held):
        yield run(held)


def _filter_words(digests: DataFrame) -> bytes:
    """A bitmap of FILTER bits with the digests' bits set; its size is fixed."""
    bit = f"pmod(digest, {FILTER})"
    rows = digests.select(F.expr(f"{bit} div 64").alias("w"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(FILTER // 64, np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out.tobytes()


def _cell_hits(pdf: pd.DataFrame):
    """Nodes of a cell, by number, and its similar pairs (x, y, shared): within the one block it has, or between its two."""
    pdf = pdf.sort_values(["block", "node"], ignore_index=True)
    sets = [np.frombuffer(d, "<u8") for d in pdf["data"]]
    block = pdf["block"].to_numpy()
    a = int((block == block[0]).sum())
    if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
        x, y, shared = Trie(sets).join(sets)
        once = x < y
        return pdf, x[once], y[once], shared[once]
    x, y, shared = Trie(sets[:a]).join(sets[a:])
    return pdf, x, y + a, shared


def _cell_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, x, y, shared = _cell_hits(pdf)
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"a": node[x], "b": node[y], "shared": shared})


def _cell_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, x, y, _ = _cell_hits(pdf)
    node = pdf["node"].to_numpy()
    order = np.argsort(node)
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    label = least_linked(len(node), rank[x], rank[y])
    links = np.bincount(np.r_[x, y], minlength=len(node))
    return pd.DataFrame({"node": node, "root": node[order][label[rank]], "n_links": links, "whole": pdf["whole"]})


def _neighbourhoods(docs: DataFrame, scratch: Scratch, text: str, doc_id: str):
    """(doc_id, sid, n_shingles) of every row; (sid, node) of the sets in neighbourhoods; their cells' rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max(SKETCH[0], round(math.log2(size / 6 / LOAD + 1))), SKETCH[1])  # a word is about six letters
    scanned = scratch.write(rows.mapInPandas(_scan(bits), "kind int, doc_id long, digest long, sid binary, n long, data binary"), "scanned", by=("kind",))
    members = scanned.filter("kind = 0").select("doc_id", "sid", F.col("n").alias("n_shingles"), "digest")
    packed = _classes(scanned.filter("kind = 1"), scratch, bits)
    scratch.drop("scanned/kind=1")
    classes = spark.sparkContext.broadcast(packed)
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(64, int(total * (DENOMINATOR - NUMERATOR) / DENOMINATOR) // BUCKET)
    hot = max(HOT, 4 * total >> bits)  # no counter is hot because of what else it holds

    prefix = rows.select("text").mapInPandas(_prefix_rows(classes, buckets, hot), "part long, sid binary, size long, map binary, whole binary, data binary")

    def reduce(key, pdf):
        if key[0] < 0:
            return pdf.drop_duplicates("sid")[["sid", "size", "map", "whole"]].assign(key=None, cell=None, place=None)[["key", "cell", "sid", "size", "place", "map", "whole"]]
        return _meet(pdf).assign(map=None, whole=None)

    met = scratch.write(prefix.groupBy("part").applyInPandas(reduce, "key long, cell long, sid binary, size long, place long, map binary, whole binary"), "met")
    live = met.filter("key is not null")
    nodes = met.filter("key is null").select("sid", "size", "map", "whole").join(live.select("sid").distinct(), "sid", "left_semi")
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def linked(nodes: DataFrame, name: str) -> DataFrame:
        """Stars of the candidates among nodes (sid, node, size, map)."""
        asked = live.select("key", "cell", "sid", "place").join(nodes, "sid").drop("sid").repartition("key", "cell").sortWithinPartitions("key", "cell")
        edges = scratch.write(asked.mapInPandas(_edges, "a long, b long").distinct(), "edges")
        return components(edges, scratch, name)

    def sized(stars: DataFrame) -> DataFrame:
        roots = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        sizes = roots.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("items"))
        sizes = sizes.withColumn("g", F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("items") / (2 * ITEMS))).cast("int"))
        return roots.join(sizes, "root").join(nodes.select("node", "sid", "size"), "node")

    near = scratch.write(sized(linked(nodes.drop("whole"), "near")), "neighbourhoods")
    wide = near.filter("g > 1").select("node")
    if not near.filter(f"g > 1 and size > {MAP_WORDS * 64}").isEmpty():
        # Short bitmaps can't tell long sets apart: in what a cell can't hold, whole ones decide once more.
        again = nodes.join(wide, "node", "left_semi").select("node", "sid", "size", F.coalesce("whole", "map").alias("map"))
        near = scratch.write(near.filter("g = 1").unionByName(sized(linked(again, "finer")).select(*near.columns)), "finer_neighbourhoods")
    scratch.drop("met", "edges")

    small = near.filter("g = 1").agg(F.count(F.lit(1)), F.sum("size")).first()
    cells = max(1, (small[0] or 0) // CHUNK, (small[1] or 0) // ITEMS)
    alone = near.filter("g = 1").select("sid", "node", F.pmod(F.xxhash64("root"), F.lit(cells)).alias("cell"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("block"), F.lit(True).alias("whole"))
    split = near.filter("g > 1").select("sid", "node", F.col("root").alias("cell"), F.pmod(F.xxhash64("node"), F.col("g")).cast("int").alias("block"), F.explode(F.expr("sequence(0, g - 1)")).alias("k"))
    split = split.select("sid", "node", "cell", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", F.lit(False).alias("whole"))
    dealt = alone.unionByName(split)

    # One text of each set in a neighbourhood travels: those whose digest is in the filter.
    one = members.join(near.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("digest").alias("digest"))
    wanted = spark.sparkContext.broadcast(_filter_words(one))

    def sets(batches):
        order, bits, seen = np.frombuffer(classes.value, np.uint8), np.frombuffer(wanted.value, np.int64), set()
        for batch in batches:
            b = batch["digest"].to_numpy() % FILTER
            chosen = batch["text"][(bits[b // 64] >> (b % 64) & 1).astype(bool)]
            for _, texts in byte_blocks(chosen):
                out = []
                for s in shingle_sets(texts):
                    if len(s) and (i := set_id(s)) not in seen:
                        seen.add(i)
                        out.append((i, ordered(s, order).astype("<u8").tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=["sid", "data"])

    # Dealt by set once, for the filter, the choice of one and the join with the cells.
    whole = rows.select("text", "digest").mapInPandas(sets, "sid binary, data binary").join(near.select("sid").hint("merge"), "sid", "left_semi")
    whole = whole.groupBy("sid").agg(F.any_value("data").alias("data"))
    return members, near.select("sid", "node"), dealt.hint("merge").join(whole, "sid").select("cell", "i", "j", "block", "whole", "node", "data")


def near_links(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """a, b, shared of every pair of different sets that are similar; doc_id, sid, n_shingles and node of every row, node
    being what a and b refer to and null where nothing may be similar."""
    members, nodes, cells = _neighbourhoods(docs, scratch, text, doc_id)
    links = cells.groupBy("cell", "i", "j").applyInPandas(_cell_links, "a long, b long, shared long")
    return scratch.write(links, "links"), members.drop("digest").join(nodes, "sid", "left")


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id of every row; they read tables in scratch."""
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    members, nodes, cells = _neighbourhoods(docs, scratch, text, doc_id)
    counted = scratch.write(cells.groupBy("cell", "i", "j").applyInPandas(_cell_counts, "node long, root long, n_links long, whole boolean"), "counted")
    found = counted.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("root").alias("least"))
    open_ = counted.filter("not whole and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    if not open_.isEmpty():
        found = found.join(components(open_, scratch, "stars"), "node", "left").withColumn("least", F.coalesce("root", "least")).drop("root")
    named = members.drop("digest").join(nodes.join(found, "node"), "sid", "left")
    # A set without a neighbour is a component of its own; sets without shingles aren't in any.
    root = F.when(F.col("n_shingles") > 0, F.coalesce(F.col("least").cast("string"), F.hex("sid")))
    named = named.select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("root"))
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select("doc_id", "n_shingles", "n_links", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: The same rows by all pairs of texts that share a shingle, and closure over links.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t),
k AS (SELECT doc_id, len(g) AS n, md5(array_to_string(g, chr(10))) AS k, g FROM s),
c AS (SELECT k, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS least FROM k WHERE n > 0 GROUP BY k),
i AS (SELECT k, n, unnest(g) AS x FROM c),
p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM i a JOIN i b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(k, o) AS (SELECT k, k FROM c UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.k),
m AS (SELECT r.k, min(c.least) AS component_id FROM r JOIN c ON c.k = r.o GROUP BY r.k),
d AS (SELECT a AS k, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, k.n::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, doc_id) AS component_id FROM k LEFT JOIN m USING (k) LEFT JOIN d USING (k)
"""
