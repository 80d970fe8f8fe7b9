"""The text operators against brute force, on fixtures with every awkward case."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import attention, automaton, bpe, bpe_codec, exact_dedup, fingerprints, hashing, langid, lm_score, ngram_join, packing, pii, prefix_trie, sharding, shingles, token_counts
from plumbline.llm.components import components
from plumbline.plans.scratch import Scratch

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeghilmnorstu") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    base = prose(60)
    near = [" ".join(["edited"] + base.split()[1:]), base + " tail", base.upper()]
    odd = [
        None, "", " \t\n", "one", "three words only", "four words in here", "four words in here", "  a b\n\nc  d e f ", "don't I'll  've 's", "<|endoftext|> x<|endoftext|>y", "é ÀÉ œŒ 漢字 ✓ ² 12,3 ́x İ ß",
        "x" * 3000, "call +1 (555) 123-4567, mail me@x.org or a@b.c_d@e.f", "card 4111 1111 1111 1111 host 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1", "IBAN GB82 WEST 1234 5698 7654 32", "\U0001f600 \x00\x1c end \x85 z", prose(9000), prose(700),
    ]
    texts = [base, base, *near, *odd, *[prose(RNG.randint(1, 120)) for _ in range(60)]]
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], "s") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base, "en", "s"), (None, None, None, "s")]


ROWS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("uid", "shard", "sid", "size", "digest", "part", "block", "key", "__text", "n_tokens", "text_sha256")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def keyed(rows, value):
    """doc_id to the sorted list of values of its rows."""
    out = collections.defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(value(r))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def want(value):
    return keyed([{"doc_id": i, "text": t} for i, t, *_ in ROWS], value)


def test_token_counts(spark, docs, empty, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    cache = f"file://{tmp_path}/cache"
    count = lambda t: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))
    for _ in range(2):  # the second time from the cache alone
        got = token_counts.count_tokens(docs, BYTE, cache).collect()
        assert keyed(got, lambda r: (r.n_bytes, r.n_tokens)) == want(lambda r: count(r["text"]))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in ROWS})
    before = stored.count()
    token_counts.count_tokens(docs, BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == before
    token_counts.count_tokens(docs, WORD, cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(empty, BYTE, cache).count() == 0


def test_token_counts_come_from_the_cache(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    digests = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.lit(token_counts.tokenizer_digest(BYTE)).alias("tokenizer"), F.lit(77).cast("long").alias("n_tokens"))
    digests.distinct().write.partitionBy("tokenizer").parquet(cache)
    assert {r.n_tokens for r in token_counts.count_tokens(docs, BYTE, cache).collect()} == {77}
    spark.createDataFrame([(i, t) for i, t, *_ in ROWS[:5]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from plumbline.plans.scratch import shared_folder

    folder = f"{shared_folder(spark)}/plumbline-token-cache/{sha(str(tmp_path))[:16]}"
    first = token_counts.op1_token_counts(spark, str(tmp_path)).collect()
    kept = spark.read.parquet(folder).count()
    assert sorted(token_counts.op1_token_counts(spark, str(tmp_path)).collect()) == sorted(first) and spark.read.parquet(folder).count() == kept >= 4


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def test_ngram_join(docs, empty):
    found = brute_components([(i, t) for i, t, *_ in ROWS])
    expected = keyed([{"doc_id": r[0], "v": v} for r, v in zip(ROWS, found)], lambda r: r["v"])
    got = keyed(ngram_join.near_components(docs).collect(), lambda r: (r.n_shingles, r.component_id))
    assert got == expected
    assert ngram_join.near_components(empty).count() == 0


def test_ngram_join_at_the_threshold_and_in_chains(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(12):
        words = prose(rng.randint(8, 60), rng).split()
        for _ in range(rng.randint(1, 9)):
            rows.append((i, " ".join(words)))
            i += 1
            words = list(words)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    passage = prose(20, rng)
    rows += [(1000 + k, f"{prose(30, rng)} {passage} {prose(30, rng)}") for k in range(20)]
    rows += [(2000 + k, " ".join(passage.split()[: 5 + k])) for k in range(15)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: v for r, v in zip(rows, brute_components(rows))}


def brute_degrees(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    different = set(sets) - {frozenset()}
    n = {a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in different) for a in different}
    return [n.get(s, 0) for s in sets]


def test_ngram_join_counts_every_link(spark, docs, empty):
    rng = random.Random(11)
    base = prose(80, rng).split()
    rows = list(enumerate([" ".join([*base[:k], rng.choice(VOCABULARY), *base[k + 1 :]]) for k in range(60)] * 2))
    for df, table_ in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs, [r[:2] for r in ROWS])):
        expected = keyed([{"doc_id": r[0], "v": v} for r, v in zip(table_, brute_degrees(table_))], lambda r: r["v"])
        assert keyed(ngram_join.near_components(df).collect(), lambda r: r.n_links) == expected
    assert max(brute_degrees(rows)) > 30
    links, members = ngram_join.near_links(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "links"))
    found = links.collect()
    assert all(r.a != r.b for r in found) and len({frozenset((r.a, r.b)) for r in found}) == len(found) == sum(brute_degrees(rows)) // 4
    assert members.count() == len(rows)


def hard_words(n=1000):
    """Words that polynomial hashes of any base put together, as Thue-Morse words and what they form, and long ones that differ in one byte."""
    one, other = b"a", b"b"
    while len(one) < 1024:
        one, other = one + other, other + one
    rng = random.Random(21)
    out = [one, other, b"x" + one, b"x" + other, one + other, other + one]
    while len(out) < n:
        a, b = rng.sample(range(6), 2)
        w = bytearray(out[a] + out[b])
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = 99
        out.append(bytes(w[: rng.randint(1, len(w))]))
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_tells_hard_words_apart(path):
    with open(path) as f:
        encoder = bpe.Encoder(f.read())
    words = hard_words(200)
    text = b" ".join(words)
    ids, counts = encoder.encode([text, words[0], words[1]])
    want_ = [Tokenizer.from_file(path).encode(t.decode(), add_special_tokens=False).ids for t in (text, words[0], words[1])]
    assert counts.tolist() == [len(w) for w in want_] and ids.tolist() == sum(want_, [])


def test_groups_are_exact_whatever_the_hash():
    words = hard_words()
    data = np.frombuffer(b"".join(words), np.uint8)
    n = np.array([len(w) for w in words])
    at = np.cumsum(n) - n
    for h in (hashing.hashes(data, at, n), np.zeros(len(words), np.uint64)):
        one, which = hashing.groups(data, at, n, h)
        assert len(one) == len(set(words)) and all(words[one[g]] == w for g, w in zip(which, words))
    assert len(np.unique(hashing.hashes(data, at, n))) == len(set(words))
    assert not np.array_equal(hashing.hashes(data, at, n), hashing.hashes(data, at, n, 1))
    assert len(hashing.groups(data[:0], at[:0], n[:0])[0]) == 0


def test_hard_words_are_different_documents(spark):
    rows = [(i, " ".join([w.decode()] * 3)) for i, w in enumerate(hard_words(40))] + [(100 + i, f"a b c d {w.decode()} e f g h") for i, w in enumerate(hard_words(6))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: v for r, v in zip(rows, brute_components(rows))}


def test_hot_shingles_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 6)
    rng = random.Random(13)
    base = prose(40, rng).split()
    rows = list(enumerate([" ".join([*base[:k], rng.choice(VOCABULARY), *base[k + 1 :]]) for k in range(40)]))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: (*v, n) for r, v, n in zip(rows, brute_components(rows), brute_degrees(rows))}


def test_trie_joins_all_probes_at_once():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(120)]
    got = set(zip(*(x.tolist() for x in prefix_trie.Trie(sets).join(sets[:50]))))
    both = [[len(np.intersect1d(a, b)) for b in sets[:50]] for a in sets]
    assert got == {(i, j, both[i][j]) for i in range(120) for j in range(50) if both[i][j] and 100 * both[i][j] >= 75 * (len(sets[i]) + len(sets[j]) - both[i][j])}


def test_cells_hold_each_pair_once():
    for g in (1, 2, 5):
        block = np.arange(30) % g
        at, cell = ngram_join._cells(block, np.full(30, g))
        held = collections.defaultdict(set)
        for a, c in zip(at.tolist(), cell.tolist()):
            held[c].add(a)
        assert all(any({a, b} <= s for s in held.values()) for a in range(30) for b in range(30)) and len(held) == g * (g + 1) // 2


def test_trie_against_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(300)]
    trie = prefix_trie.Trie(sets)
    for probe in sets[:60]:
        expected = {(i, len(np.intersect1d(probe, s))) for i, s in enumerate(sets)}
        expected = {(i, n) for i, n in expected if 100 * n >= 75 * (len(probe) + len(sets[i]) - n)}
        assert set(trie.similar(probe)) == expected
    assert prefix_trie.Trie([]).similar(sets[0]) == []


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 56, 200)).astype(np.uint64) for _ in range(2))
        c = np.unique(np.r_[a[:150], b[:50]])
        p, q = (int.from_bytes(ngram_join.parity(x)) for x in (a, c))
        assert (p ^ q).bit_count() <= len(np.setxor1d(a, c))


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    root = {n: n for e in links for n in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    loose = spark.createDataFrame([(3, 3), (None, 4), (5, None), (8, 6), (6, 8)], "a long, b long")
    assert [tuple(r) for r in components(loose, Scratch(spark, "t"), "d").collect()] == [(8, 6)]
    assert components(loose.limit(0), Scratch(spark, "t"), "e").count() == 0


def test_sharding(spark, docs, empty):
    got = sharding.byte_shards(docs, 6).collect()
    size = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert keyed(got, lambda r: (r["size"], r.text_crc32)) == want(lambda r: size(r["text"]))
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert sharding.byte_shards(empty).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    sums = [r.b for r in sharding.byte_shards(many, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 2 * max(88, sum(sums) / 24 / 50) + 2
    # A group of more than a fiftieth of a shard is cut; smaller ones stay whole.
    assert sharding.byte_shards(many, 24).filter(F.col("text_crc32") == zlib.crc32(b"hot " * 20)).select("shard").distinct().count() > 10
    split = sharding.byte_shards(many.filter("doc_id % 3 <> 0"), 24).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n"))
    assert split.agg(F.max("n")).first()[0] == 1


def brute_shards(rows, shards, share=50):
    """(doc_id, shard, slot) by the rule in plain Python: rows by hash of the text, units at their middle byte."""
    import xxhash

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    rows = sorted(((signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "", i is not None, i or 0, len((t or "").encode()) + 8) for i, t in rows))
    total, largest, start, out, first = sum(r[4] for r in rows), max(r[4] for r in rows), 0, [], {}
    spans = {}
    for r in rows:
        spans.setdefault(r[1], [start, 0, 0])
        spans[r[1]][1] += r[4]
        spans[r[1]][2] += 1
        start += r[4]
    start = 0
    for k, r in enumerate(rows):
        a, size, n = spans[r[1]]
        a, size = (a, size) if n > 1 and size <= max(total // (shards * share), largest) else (start, r[4])
        shard = min(shards - 1, (2 * a + size) * shards // (2 * total))
        first.setdefault(shard, k)
        out.append((r[3] if r[2] else None, shard, k - first[shard]))
        start += r[4]
    return out


def test_sharding_against_plain_python(spark, docs):
    rng = random.Random(3)
    some = [(i, rng.choice(VOCABULARY) * rng.randint(1, 9)) for i in range(900)] + [(1000 + i, "hot " * 15) for i in range(300)] + [(None, "x"), (None, None)]
    for df, rows, n in ((docs, [r[:2] for r in ROWS], 5), (spark.createDataFrame(some, "doc_id long, text string").repartition(7), some, 24)):
        got = sorted(((r.doc_id, r.shard, r.slot) for r in sharding.byte_shards(df, n).collect()), key=repr)
        assert got == sorted(brute_shards(rows, n), key=repr)


def test_packing(docs, empty):
    tok = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, 512).collect()
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]
    cut = lambda v: [(p, a, len(v[a : a + 512]), zlib.crc32(np.array(v[a : a + 512], "<u4").tobytes())) for p, a in enumerate(range(0, len(v), 512))]
    expected = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        expected[i] += cut(ids(t))
    assert keyed(got, lambda r: (r.piece, r.start, r.length, r.ids_crc32)) == {k: sorted(v, key=repr) for k, v in expected.items()}
    fill = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 512 and len(fill) <= -(-sum(fill.values()) // 512) + 1
    assert packing.pack(empty, WORD).count() == 0


def test_packing_comes_to_the_bound_on_a_whole_table(spark):
    got = packing.op4_packing(spark, "/root/testdata/sf0.01").toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert got["doc_id"].nunique() == 1000 and fill.max() <= packing.LENGTH
    assert len(fill) <= -(-int(fill.sum()) // packing.LENGTH) + 1


def test_local_search_empties_bins():
    rng = np.random.default_rng(1)
    for n, high in ((1, 5), (300, 2000), (200, 4096)):
        sizes = rng.integers(1, high + 1, n)
        bins = packing.local_search([[i] for i in range(n)], sizes, 4096)
        assert sorted(i for b in bins for i in b) == list(range(n)) and max(sizes[b].sum() for b in bins) <= 4096
        assert len(bins) <= len(packing.best_fit(sizes, 4096)) + max(2, n // 20)
    assert len(packing.pack_lengths(np.zeros(0, np.int64))) == 0


def test_local_search_swaps_where_no_move_fits():
    sizes = np.array([6, 3, 5, 4, 2])
    bins = packing.local_search([[0, 1], [2, 3], [4]], sizes, 10)
    assert len(bins) == 2


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    with open(path, encoding="utf-8") as f:
        content = f.read()
    tok, encoder = Tokenizer.from_str(content), bpe.Encoder(content)
    alphabet = ["a", "b", " ", " ", "'", "1", ".", "é", "\n", "\t", "漢", "<|endoftext|>", "À", "ß", "|", " ", " ", "́", "s", "'ll", "\x1c"]
    texts = [t or "" for _, t, *_ in ROWS] + ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 30))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    plain = encoder.encode(raw)
    data, starts, lengths, _ = encoder.chunks(raw)
    chunks = sorted({data.tobytes()[a : a + n] for a, n in zip(starts, lengths) if n <= bpe.LONG})[::2]
    ids, n = encoder.encode_chunks(chunks)
    at = np.cumsum(n) - n
    encoder.automaton = automaton.Automaton(automaton.compile({c: ids[a : a + k].tolist() for c, a, k in zip(chunks, at, n)}))
    for flat, counts in (plain, encoder.encode(raw)):
        for t, lo, k in zip(texts, np.cumsum(counts) - counts, counts):
            assert flat[lo : lo + k].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_automaton_shares_suffixes():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "w", "zebra"])}
    a = automaton.Automaton(automaton.compile(words))
    assert a.states < 20
    asked = [*words, b"walk", b"", b"zebras", b"talkin"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    n = np.array([len(w) for w in asked])
    got = a.lookup(data, np.cumsum(n) - n, n)
    assert [a.ids[a.offsets[k] : a.offsets[k + 1]].tolist() if k >= 0 else None for k in got] == [*words.values(), None, None, None, None]
    assert automaton.Automaton(automaton.compile({})).lookup(data, np.cumsum(n) - n, n).max() == -1


def test_codec(docs, empty):
    tok = Tokenizer.from_file(BYTE)

    def one(r):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False))

    got = bpe_codec.codec(docs, BYTE, ids=True).collect()
    assert keyed(got, lambda r: (r.n_tokens, r.ids_sha256, r.decoded_sha256)) == want(one)
    assert keyed(got, lambda r: r.decoded) == want(lambda r: r["text"] or "")
    assert bpe_codec.codec(empty, BYTE).count() == 0


def base_spans(t):
    t, out = t or "", []

    def luhn(x):
        v = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(x))]
        return sum(a - 9 if a > 9 else a for a in v) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


HARD = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "001.002.3.255 1.2.3.256", "x" * 30000 + "@y.z", "1" * 30000, "+" + "1 " * 20000, "é\U0001f600 me@x.org +1 (555) 123-4567", "4111-1111-1111-1111 4111 1111 1111 1112", "a@b.c@d.e", "@" * 20000, "1.2.3" + ".4" * 5000, "+1+2 3 4 5 6 7 8 9", "GB82WEST12345698765432 DE89370400440532013000 GB82 WEST 1234 5698 7654 33"]


def test_pii(spark, docs, empty):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(HARD, 100000)), "doc_id long, text string"))
    rows = [{"doc_id": i, "text": t} for i, t, *_ in ROWS] + [{"doc_id": i, "text": t} for i, t in enumerate(HARD, 100000)]
    got = pii.find(df).select("doc_id", pii.joined(*[f"__{k}" for k in pii.BASE]).alias("b"), pii.joined("__iban").alias("i")).collect()
    assert keyed(got, lambda r: r.b) == keyed(rows, lambda r: base_spans(r["text"]))
    ibans = keyed(got, lambda r: r.i)
    assert ibans[100000 + len(HARD) - 1] == ["iban:0:22,iban:23:45"] and sum(bool(x) for v in ibans.values() for x in v) == 2
    assert pii.find(empty).count() == 0


def test_pii_context_decides(spark):
    rows = ["my SSN is 123-45-6789", "part 123-45-6789 of it", "social security: 123-45-6789, 123-45-6780", "ssn 000-12-3456 666-12-3456 923-45-6789 123-00-6789", "ssn " + "x" * 41 + " 123-45-6789",
            "IMEI 490154203237518", "no 490154203237518", "imei 490154203237519", "12 34 56 host 10.0.0.1 78 server", "10.0.0.1 a 10.0.0.2 b"]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("doc_id", pii.joined(*[f"__{k}" for k in pii.OWN]).alias("own"), F.transform("__ip", lambda x: F.round(x["score"], 2)).alias("ip")).collect()}
    assert [got[i].own for i in range(10)] == ["ssn:10:21", "", "ssn:17:28,ssn:30:41", "", "", "imei:5:20", "", "", "", ""]
    assert got[8].ip == [0.8] and got[9].ip == [0.6, 0.6]


def test_pii_score_is_that_of_the_text_around(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "10.0.0.1", "12", "mail", "host", " ", ", ", "x" * 15, "1.2.3.4", "é", "ip:", "+1 555 123 4567", "call"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        t = texts[r.doc_id]
        for k in pii.BASE:
            for x in r[f"__{k}"]:
                around = t[max(0, x.start - pii.NEAR) : x.end + pii.NEAR].lower()
                assert x.score == pytest.approx(pii.START[k] + pii.BONUS * bool(re.search(rf"\b(?:{pii.CONTEXT[k]})", around))), (k, t[max(0, x.start - 60) : x.end + 60])


def test_pii_in_a_text_of_many_matches(spark):
    text = "m a@b.co " * 20000
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.joined("__email").alias("e")).first()
    assert r.e == ",".join(f"email:{9 * i + 2}:{9 * i + 8}" for i in range(20000))


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1.", 24, "k"), (2, None, None, "k"), (3, "clean", 5, "k"), (4, "", 0, "k")], "doc_id long, text string, n_chars long, __row string")
    out = {r.doc_id: r for r in pii.redact(df.withColumnRenamed("__row", "row")).collect()}
    assert (out[1].text, out[1].n_chars) == ("mail [EMAIL] or [IP].", 21) and out[2].text is None and out[2].n_chars is None and out[3].text == "clean" and out[4].text == ""


def test_lm_base_and_split(docs, empty):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, t, *_ in ROWS if not held(i) for w in words(t))
    n = sum(c.values())

    def one(r):
        w = words(r["text"])
        return held(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w), 6)

    got = lm_score.lm_scores(docs, BYTE).collect()
    assert keyed(got, lambda r: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) == want(one)
    assert all(r.score < 0 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(round(r.score, 6))
    assert len(by[ROWS[0][0]]) == 1
    assert lm_score.lm_scores(empty, BYTE).count() == 0


def test_lm_windows_tile_every_training_text_and_pairs_count_it(spark, docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    with open(BYTE, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    encoder = bpe.Encoder(content.value)
    size = 50257
    types = lm_score.Types(np.bincount(np.arange(size) % 977, minlength=size), size - 1, np.arange(size) % 3 == 0)
    assert types.closing == 0 and np.allclose(np.bincount(types.type_of, np.exp(types.share), lm_score.TYPES), 1)
    df = docs.select("doc_id", "text", (F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0).alias("held_out"))
    heavy = spark.sparkContext.broadcast({b"one": 3, b"words": 2})
    scanned = Scratch(spark, "tile").write(lm_score.scan(df, content, spark.sparkContext.broadcast(types), heavy, 7), "scanned")
    rows = scanned.filter("kind = 0").toPandas()
    expected, pairs = [], collections.Counter()
    for i, t, *_ in ROWS:
        words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())
        own = types.type_of[lm_score.word_ids(encoder, words)[0]]
        expected.append((repr(i), own.astype("<u2").tobytes()))
        if not held(i):
            seq = [0, *own.tolist(), 0]
            pairs.update(zip(seq, seq[1:]))
    assert collections.Counter(zip(rows["doc_id"].map(lambda i: repr(None if i != i else int(i))), rows["data"].map(bytes))) == collections.Counter(expected)
    joint = lm_score.count_pairs(scanned)
    assert {(a, b): int(joint[a, b]) for a, b in zip(*np.nonzero(joint))} == pairs
    tiled = collections.Counter()
    for x, y in lm_score.training_windows([rows[~rows["held_out"].astype(bool)]], 0):
        for before, after in zip(x[:, attention.SPAN :], y):
            tiled.update((a, b) for a, b in zip(before.tolist(), after.tolist()) if b >= 0)
    assert tiled == pairs


def test_lm_gather_tells_hashes_apart_and_adds_up():
    e = np.array([(7, 1, 0, 65535), (7, 1, 0, 2), (7, 2, 1, 3), (7, 3, 1, 1), (9, 1, 2, 4)], lm_score.ENTRY)
    import pandas as pd

    counts = pd.DataFrame({"bucket": 0, "data": [np.array(x, lm_score.COUNT).tobytes() for x in ([(7, 2, 5), (8, 1, 1)], [(7, 1, 9)])]})
    got = lm_score._gather(pd.DataFrame({"bucket": [0], "block": [4], "data": [e.tobytes()]}), counts).iloc[0]
    assert np.frombuffer(got["texts"], "<u4").tolist() == [0, 1, 2] and np.frombuffer(got["known"], np.int64).tolist() == [65537, 3, 0]
    assert np.allclose(np.frombuffer(got["base"]), [65537 * np.log10(9.1), 3 * np.log10(5.1) + np.log10(0.1), 4 * np.log10(0.1)])


def small_model(seed=0, types=40, classes=attention.CLASSES):
    rng = np.random.default_rng(seed)
    kind, prior = rng.integers(0, classes, types), rng.random((types, classes)).astype(np.float32) + 0.1
    return attention.init(), kind, prior / prior.sum(1, keepdims=True)


def test_attention_is_causal_scores_once_and_sums_to_one():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 30, 31, 32, 33, 100, 57])
    types = rng.integers(1, 40, counts.sum())
    x, y, owner = attention.windows(types, counts, 0)
    begin = np.cumsum(counts) - counts
    for t, (b, n) in enumerate(zip(begin, counts)):
        assert y[owner == t][y[owner == t] >= 0].tolist() == [*types[b : b + n], 0]
    p, kind, prior = small_model()
    link, _ = attention.forward(p, kind.take(np.maximum(x, 0)), x >= 0)
    later = np.where((np.arange(x.shape[1]) > attention.SPAN + attention.STEP) & (x >= 0), 5, x)
    again, _ = attention.forward(p, kind.take(np.maximum(later, 0)), later >= 0)
    assert np.allclose(link[:, :2], again[:, :2], atol=1e-5) and not np.allclose(link[:, 2:], again[:, 2:], atol=1e-5)
    total, kinds = 0.0, np.arange(attention.CLASSES)
    for c in range(attention.CLASSES):
        y1 = np.full_like(y[-1:], -1)
        y1[0, 10] = c
        total += np.exp(attention.score(p, x[-1:], y1, np.r_[kinds], prior.repeat(4, 0)[: attention.CLASSES]))[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_every_target_sees_every_input_before_it():
    x = np.random.default_rng(4).integers(1, 40, (1, 2 * attention.SPAN))
    p, kind, _ = small_model()
    link, _ = attention.forward(p, kind.take(x), x >= 0)
    assert link.shape[1] == attention.SPAN  # a query a target
    for place in range(2 * attention.SPAN):
        other = x.copy()
        other[0, place] = next(t for t in range(1, 40) if kind[t] != kind[x[0, place]])
        changed = (attention.forward(p, kind.take(other), other >= 0)[0] != link).any(2)[0]
        assert changed.tolist() == [i + attention.SPAN >= place for i in range(attention.SPAN)]


def test_later_windows_score_after_half_a_window():
    counts = np.array([100, 33, 500])
    x, y, owner = attention.windows(np.ones(counts.sum(), np.int64), counts, 0)
    later = np.r_[False, owner[1:] == owner[:-1]]
    assert later.sum() > 10 and (x[later][:, : attention.SPAN] >= 0).all() and (x[~later][:, : attention.SPAN] == -1).all()
    assert y.shape[1] * 2 == x.shape[1]


def test_model_is_a_distribution():
    rng = np.random.default_rng(3)
    joint = np.zeros((lm_score.TYPES,) * 2, np.int64)
    np.add.at(joint, tuple(rng.integers(0, 300, (2, 5000))), 1)
    for table_ in (joint, np.zeros_like(joint)):
        m = lm_score.Model(table_, 0)
        assert m.kind[0] == 0 and (m.kind == 0).sum() == 1 and np.allclose(m.prior.sum(1), 1, atol=1e-4)
        for before in (0, 5, 299, 2000):
            have = np.unique(m.kind)
            assert np.allclose(np.bincount(m.kind, np.exp(m.within[before].astype(float)), attention.CLASSES)[have], 1, atol=1e-3)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    p, kind, prior = small_model()
    counts = np.array([70, 20, 40])
    x, y, _ = attention.windows(rng.integers(0, 40, counts.sum()), counts, 0)
    p = {k: v.astype(float) for k, v in p.items()}
    prior = prior.astype(float)
    g = attention.gradient(p, x, y, kind, prior)[1]
    for name in p:
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        p[name][i] += 1e-5
        a = attention.gradient(p, x, y, kind, prior)[0]
        p[name][i] -= 2e-5
        b = attention.gradient(p, x, y, kind, prior)[0]
        p[name][i] += 1e-5
        assert (a - b) / 2e-5 == pytest.approx(g[name][i], rel=1e-3)


def plain_logs(p, x, y, kind, prior):
    """Log probabilities of the targets' classes, one target after the other."""
    out = np.zeros(y.shape)
    for w, i in zip(*np.nonzero(y >= 0)):
        seen = [j for j in range(attention.SPAN + i + 1) if x[w, j] >= 0]
        c, last = kind[x[w, seen]], kind[x[w, attention.SPAN + i]]
        a = np.exp(np.clip(p["key"][c] @ p["query"][last] / attention.WIDTH**0.5 + p["place"][i, seen], -60, 60))
        h = p["last"][last] + a / (a.sum() + 1e-30) @ p["value"][c] @ p["mix"]
        h = h + np.maximum(h @ p["up"], 0) @ p["down"]
        share = prior[x[w, attention.SPAN + i]] * np.maximum(1 + p["out"] @ h / 8, attention.FLOOR) ** 8
        out[w, i] = np.log(share[kind[y[w, i]]] / share.sum())
    return out


def test_attention_is_that_of_one_target_after_the_other():
    rng = np.random.default_rng(6)
    counts = np.array([0, 5, 31, 32, 33, 700, 90])
    x, y, _ = attention.windows(rng.integers(0, 40, counts.sum()), counts, 0)
    p, kind, prior = small_model(types=60)
    prior = prior.astype(float)
    for times in (1, 4, 40):  # of 4 some links are held, of 40 some exponents are, too
        q = {k: v.astype(float) * times for k, v in p.items()}
        logs = plain_logs(q, x, y, kind, prior)
        assert np.allclose(attention.score(q, x, y, kind, prior), logs.sum(1), rtol=1e-9)
        assert attention.gradient(q, x, y, kind, prior)[0] == pytest.approx(-np.maximum(logs, np.log(1e-30)).sum() / (y >= 0).sum(), rel=1e-9)


def test_attention_gradient_of_held_links_and_parts():
    rng = np.random.default_rng(1)
    p, kind, prior = small_model(types=60)
    counts = np.array([900, 20, 0, 40])
    x, y, _ = attention.windows(rng.integers(0, 40, counts.sum()), counts, 0)
    p, prior = {k: v.astype(float) * 4 for k, v in p.items()}, prior.astype(float)
    whole = attention.gradient(p, x, y, kind, prior)[1]
    real = (y >= 0).sum(1)
    for name in p:
        parts = sum(attention.gradient(p, x[i : i + 1], y[i : i + 1], kind, prior)[1][name] * real[i] for i in range(len(x)))
        assert np.allclose(whole[name], parts / real.sum(), atol=1e-9 * np.abs(whole[name]).max())
        i = np.unravel_index(np.abs(whole[name]).argmax(), whole[name].shape)
        p[name][i] += 1e-6
        a = attention.gradient(p, x, y, kind, prior)[0]
        p[name][i] -= 2e-6
        b = attention.gradient(p, x, y, kind, prior)[0]
        p[name][i] += 1e-6
        assert (a - b) / 2e-6 == pytest.approx(whole[name][i], rel=1e-3)


def test_attention_works_on_few_windows_at_a_time():
    import tracemalloc

    x = np.random.default_rng(2).integers(0, 40, (attention.BATCH, 2 * attention.SPAN + 1))
    p, kind, prior = small_model()
    args = p, x[:, :-1], x[:, attention.SPAN + 1 :], kind, prior
    peak = []
    for step in (attention.gradient, attention.score):
        step(*args)
        tracemalloc.start()
        step(*args)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[0] < 8 << 20 and peak[1] < 5 << 20  # 21 and 12 MiB where a whole batch is worked on at once


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = lm_score.op7_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and len(held) > 50
    assert held["score"].sum() > held["base_score"].sum() and (held["score"] > held["base_score"]).mean() > 0.5


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    once = {}
    for i, t, *_ in ROWS:
        once.setdefault(i, t or "") if i is not None else once.__setitem__(None, min(once.get(None, "￿"), t or "", key=len))
    order = sorted((i for i in once if i is not None), reverse=True) + [None]
    assert set(got) == set(order)
    for k, i in enumerate(order):
        t, after = once[i], once[order[(k + 1) % len(order)]]
        n = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(t[: len(t) - n] + after[:n])
    assert got[1].fingerprint == got[4].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert fingerprints.fingerprints(empty).count() == 0


def test_op8_keeps_every_row(spark, tmp_path):
    rows = [(5, "five words of a text"), (5, "another text"), (5, "another text"), (4, "four"), (None, "no id"), (None, "none either"), (9, "nine of them"), (1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = ["nine of them", "another text", "another text", "five words of a text", "four", "", "no id", "none either"]
    ids = [9, 5, 5, 5, 4, 1, None, None]
    after = order[1:] + order[:1]
    expected = collections.Counter((i, len(t), sha(t[: len(t) - len(t) // 3] + n[: len(t) // 3])) for i, t, n in zip(ids, order, after))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()) == expected
    for blocks in (2, 7):
        df = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(df, blocks=blocks, every=True).collect()) == expected


def brute_imatch(texts):
    """The fingerprint function of plain Python: lexicon by document frequency, subsets by parts of the hash space, chained hashes."""
    import xxhash

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def terms(t):
        return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}

    def chained(hs):
        h = 42
        for x in sorted(hs):
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        return h

    df = collections.Counter(h for t in texts for h in terms(t))
    low, high = max(2, math.ceil(0.002 * len(texts))), max(2, math.floor(0.25 * len(texts)))
    lexicon = {h for h, n in df.items() if low <= n <= high}
    ranges_ = [(a + k * w, a + (k + 1) * w) for a, w, n in ((0, 32, 16), (512, 4, 16), (1024, 256, 4)) for k in range(n)]

    def code(t):
        known = terms(t) & lexicon
        own = [[h for h in known if a <= (h >> 40) % 2048 < b] for a, b in ranges_]
        out = "".join(f"{chained(p) & 0xFFFFFFFF:08x}" if p else "--------" for p in own)
        return out if known and any(own) else out + f"{chained(terms(t)):016x}"

    return code


def test_fingerprints_against_plain_imatch(spark, tmp_path):
    rng = random.Random(8)
    many = [a + b for a in VOCABULARY[:60] for b in VOCABULARY[:6]]
    texts = [" ".join(rng.choice(many) for _ in range(rng.randint(0, 90))) for _ in range(150)] + [None, "", "one", "Ünïcode TEXT", " ".join(many[:300])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t or "" for t in texts]
    code = brute_imatch(texts)

    def like(a, b):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 36 * 8, 8)]
        used = sum(x != "-" * 8 or y != "-" * 8 for x, y in pairs)
        return sum(x == y != "-" * 8 for x, y in pairs) / used if used else float(a == b)

    for df in (fingerprints.op8_fingerprints(spark, str(tmp_path)), fingerprints.fingerprints(spark.read.parquet(f"{tmp_path}/documents.parquet"), blocks=1, run=2000)):
        got = {r.doc_id: r for r in df.collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            after, n = texts[i - 1], len(t) // 3
            edited = t[: len(t) - n] + after[:n]
            assert (got[i].fingerprint, got[i].edited_fingerprint, got[i].edited_sha256) == (code(t), code(edited), sha(edited))
            assert (got[i].near_edited, got[i].near_next) == (pytest.approx(like(code(t), code(edited))), pytest.approx(like(code(t), code(after))))


def test_fingerprints_recognise_edited_documents(spark):
    rng = random.Random(2)
    many = [a + b for a in VOCABULARY for b in VOCABULARY[:10]]
    df = spark.createDataFrame([(i, " ".join(rng.choice(many) for _ in range(150))) for i in range(400)], "doc_id long, text string")
    row = fingerprints.fingerprints(df, blocks=7).agg(F.avg("near_edited").alias("a"), F.avg("near_next").alias("b"), F.count(F.lit(1)).alias("n")).first()
    assert row.n == 400 and row.a > 3 * row.b and row.a > 0.08


def test_langid(spark, docs, empty):
    rows = langid.held_out_split(docs)
    got = langid.predict(rows, langid.train(rows.filter("not held_out")), keep=("doc_id", "held_out")).collect()
    letters = lambda t: t is not None and any(c.isalpha() for c in t)
    assert keyed(got, lambda r: r.lang_pred == "und") == want(lambda r: not letters(r["text"]))
    assert {r.lang_pred for r in got} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got)
    assert keyed(got, lambda r: r.held_out) == want(lambda r: zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
    nothing = langid.train(langid.held_out_split(empty))
    assert {r.lang_pred for r in langid.predict(rows, nothing).collect()} == {"und"}
    assert langid.predict(empty, nothing).count() == 0


def test_langid_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    truth = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    got = langid.op9_langid(spark, path).filter("held_out").join(truth.filter("lang is not null"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_langid_predicts_the_best_plain_cosine(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:60] + [None, "", "12 34", "é"]
    train = langid.held_out_split(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("not held_out")
    names, prototypes = langid.train(train)
    unit = [p / math.sqrt(sum(p * p)) for p in prototypes]
    mean = sum(unit) / len(unit)
    unit = [(u - mean) / math.sqrt(sum((u - mean) ** 2)) for u in unit]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (names, prototypes)).collect()}
    for i, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        v = langid.Space().vectors([t])[0][0].astype(float)
        cosine = [float(v @ u / math.sqrt(v @ v)) if v.any() else 0.0 for u in unit]
        assert got[i].lang_pred == names[int(np.argmax(cosine))] and got[i].score == pytest.approx((1 + max(cosine)) / 2, abs=1e-4)


def test_hypervectors_against_plain_binding():
    s = langid.Space()
    text = "abc dé!x"
    v, _ = s.vectors([text, "ab", ""])
    symbols = [int(s.table[ord(c)]) for c in "abc dé!x"]
    plain = np.zeros(s.dimensions)
    letters = s.places[-1]
    for i in range(len(symbols) - 2):
        plain += np.roll(letters[symbols[i]], 2) * np.roll(letters[symbols[i + 1]], 1).astype(int) * letters[symbols[i + 2]]
    assert np.array_equal(v[0], plain) and not v[1:].any()


def test_exact_dedup(docs, empty, monkeypatch):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[norm(t)].append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    for width in (32, 1):
        monkeypatch.setattr(exact_dedup, "FIRST_WIDTH", width)
        got = exact_dedup.exact_groups(docs).collect()
        assert keyed(got, lambda r: (r.keep_id, r.group_size, r.text_sha256)) == want(lambda r: (keep[norm(r["text"])], len(groups[norm(r["text"])]), sha(norm(r["text"]))))
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_shingles_of_short_texts():
    a, b, c, d, e = shingles.shingle_sets([b"", b" \n", b"a b c d", b"A B\tc d", b"a b c d e f"])
    assert len(a) == len(b) == 0 and len(c) == 1 and c == d and len(e) == 2


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    rows = [(*r, len(r[1] or "")) for r in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_chars long").withColumn("uid", F.lit("clash"))
    letters = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    kept, now = [], docs
    for name, stage in pipeline.STAGES[:-1]:
        now = Scratch(spark, "stage").write(stage(spark, now, ""), name)
        assert now.columns == docs.columns
        kept.append(now.collect())
    assert sorted(r.text for r in kept[0]) == sorted(r[1] for r in letters)
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t)
    first = {}
    for r in kept[0]:
        k = norm(r.text)
        first[k] = min(first.get(k, (True, 0)), (r.doc_id is None, r.doc_id or 0)) if k in first else (r.doc_id is None, r.doc_id or 0)
    assert sorted(r.doc_id for r in kept[1]) == sorted(i for _, i in first.values())
    comps = brute_components([(r.doc_id, r.text) for r in kept[1]])
    assert sorted(r.doc_id for r in kept[2]) == sorted({c for _, c in comps if c is not None})
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2]}
    assert all(base_spans(r.text) == "" or "[" in r.text for r in kept[3]) and all(r.n_chars == len(r.text) for r in kept[3])
    out = pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept[3]}
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as pipeline

    names = ["score", "lang_pred", "held_out", "__uid", "__text", "__row", "row", "group", "sid", "n_chars", "travels1", "a.b"]
    rows = [(*r, *[f"{k}:{r[0]}" for k in names if k != "n_chars"]) for r in ROWS[:25]]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"`{k}` string" for k in names if k != "n_chars")).withColumn("n_chars", F.length("text"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[k] == f"{k}:{r.doc_id}" for r in got for k in names if k != "n_chars")
    assert pipeline.STAGES[-1][1](spark, docs, "").columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_long_sets_do_not_link_up_by_chance(spark, monkeypatch):
    """Long texts that share one shingle with the next one each are no neighbourhood, however many there are; true copies among them stay linked."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rng = np.random.default_rng(7)
    long = [[f"a{i}x{j}" for j in range(1500)] for i in range(12)]
    for i in range(11):
        long[i + 1][:60] = long[i][-60:]
    near = list(long[4])
    for j in rng.choice(1500, 20, False):
        near[j] += "y"
    rows = [(i, " ".join(w)) for i, w in enumerate([*long, near])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join._neighbourhoods(docs, Scratch(spark, "long"), "text", "doc_id")[2].count() == 2
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_components(docs).collect()}
    assert got == {i: (int(i in (4, 12)), 4 if i == 12 else i) for i in range(13)}


def test_whole_parity_bounds_the_difference():
    rng = np.random.default_rng(8)
    a = np.unique(rng.integers(0, 1 << 56, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[200:], rng.integers(0, 1 << 56, 9000).astype(np.uint64)]))
    maps = ngram_join.Maps(pd.Series([ngram_join.whole_parity(s) for s in (a, b, a[:300])]))
    x, y = np.array([0, 0, 1, 0]), np.array([1, 2, 2, 0])
    sets = [set(s.tolist()) for s in (a, b, a[:300])]
    assert all(d <= len(sets[i] ^ sets[j]) for d, i, j in zip(maps.apart(x, y).tolist(), x, y))
    assert maps.apart(x, y)[3] == 0 and ngram_join.folded(ngram_join.whole_parity(a), 8) == ngram_join.parity(a)


def test_rows_of_files_are_told_apart_without_a_copy(spark, tmp_path):
    rows = [(3, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3), (7, None, 4), (7, None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, more int").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    marked = corpus_pipeline._marked(spark, docs, "x")
    assert sorted(marked.inputFiles()) == sorted(docs.inputFiles()) and marked.select("row").distinct().count() == 5
    assert sorted(r.doc_id for r in corpus_pipeline.exact_copies(spark, docs, "").collect()) == [3, 7]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [3, 7, 7]


def test_kept_rows_are_found_without_dealing_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i // 2} of several words in a row", "en") for i in range(300)], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
            out = stage(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
            assert sorted(r.doc_id for r in out.collect()) == list(range(0, 300, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rng = np.random.default_rng(1)
    numbers = np.unique(np.r_[0, 63, 64, 65_535, 65_536, 3 << 40, rng.integers(0, 1 << 18, 3000), (1 << 40) + rng.integers(0, 1 << 12, 3000), (1 << 62) + rng.integers(0, 99, 50)]).tolist()
    kept = sorted(random.Random(2).sample(numbers, len(numbers) // 2))
    rows, keep = (spark.createDataFrame([(x,) for x in n], "row long") for n in (numbers, kept))
    assert sorted(r.row for r in corpus_pipeline._only(rows, keep).collect()) == kept
    assert corpus_pipeline._only(rows, keep.filter("row < 0")).count() == 0
    monkeypatch.setattr(corpus_pipeline, "MARKS_MB", 0)
    assert sorted(r.row for r in corpus_pipeline._only(rows, keep).collect()) == kept
