"""Exact byte-pair encoding of many texts at once, with flat arrays.

A block of texts is cut into chunks that the tokenizer would never join: before each run of white space that follows
something else (byte-level tokenizers, whose tokens hold white space), or at white space (tokenizers that drop it). Equal chunks, compared
byte by byte, are encoded once. A chunk known to the lexicon's automaton takes its ids from there; the others are split into pre-tokens
and merged exactly, lowest rank first, all of a round together. Chunks with anything but ASCII and plain Latin letters, or with an apostrophe
or a bar, take the library's own pre-tokenizer (or the library, where white space is dropped); so do very long ones.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from plumbline.llm.automaton import Automaton
from plumbline.llm.hashing import groups

LETTER, DIGIT, OTHER, SPACE, UNSAFE = 0, 1, 2, 3, 4
LONG = 512
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _classes() -> np.ndarray:
    out = np.full(256, UNSAFE, np.uint8)
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[[ord("'"), ord("|")]] = UNSAFE
    return out


CLASS = _classes()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _latin(data: np.ndarray, cls: np.ndarray, extended: bool) -> None:
    """Marks two-byte Latin letters as letters: U+00C0 to U+00FF but the two signs, and up to U+017F if extended."""
    lead = np.flatnonzero((data == 0xC3) | ((data == 0xC4) | (data == 0xC5) if extended else False))
    lead = lead[lead + 1 < len(data)]
    after = data[lead + 1]
    ok = (data[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))
    cls[lead[ok]] = LETTER
    cls[lead[ok] + 1] = LETTER


class Encoder:
    """One tokenizer: its merges as arrays, and the cutting rules that fit its kind."""

    def __init__(self, content: str, automaton: Automaton | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(content)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.word = bool(self.suffix)
        if self.word != bool(spec["normalizer"]) or model["type"] != "BPE":
            raise ValueError("a byte-level BPE without normalizer, or a lower-casing one with word ends, is needed")
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, at = np.unique(keys, return_index=True)  # of a pair listed twice the first counts
        self.merged = merged.astype(np.int32)
        bits = 19
        self.mask = (1 << bits) - 1
        self.slot_key, self.slot_rank, self.reach = self._table(keys, at, bits)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), *self.specials.values()) + 1
        texts = [b""] * size
        for piece, i in vocab.items():
            if all(c in self.byte_of for c in piece):
                texts[i] = bytes(self.byte_of[c] for c in piece)
        for piece, i in self.specials.items():
            texts[i] = piece.encode()
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_len = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.automaton = automaton

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))).astype(np.int64)

    def _table(self, keys: np.ndarray, ranks: np.ndarray, bits: int):
        slot_key, slot_rank = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, NONE, np.int32)
        reach, left, home = 0, np.arange(len(keys)), self._slot(keys, bits)
        while len(left):
            at = home[left] + reach
            free = slot_key[at] == -1
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            slot_key[at[one]], slot_rank[at[one]] = keys[left[one]], ranks[left[one]]
            left, reach = np.delete(left, one), reach + 1
        self.bits = bits
        return slot_key, slot_rank, reach

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys, self.bits)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for step in range(1, self.reach):
            if not len(open_):
                break
            found = self.slot_key[at[open_] + step]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]] + step]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of symbols, merged lowest rank first; and the number of ids of each.

        Each round merges every run's best pair wherever it stands; only the ranks of pairs beside a merge are looked up again.
        """
        symbols, size, name = symbols.astype(np.int32), lengths.astype(np.int64), np.arange(len(lengths))
        done_ids, done_run, done_size = [], [], []
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(size[size > 0]) - 1] = True
        name, size = name[size > 0], size[size > 0]
        rank = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.rank(symbols[inner].astype(np.int64) << 20 | symbols[inner + 1])
        while len(symbols):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            ended = best == NONE
            if ended.any():
                out = np.repeat(ended, size)
                done_ids.append(symbols[out])
                done_run.append(name[ended])
                done_size.append(size[ended])
                go = ~out
                symbols, rank, last = symbols[go], rank[go], last[go]
                name, size, best = name[~ended], size[~ended], best[~ended]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            beside = np.flatnonzero(at[1:] == at[:-1] + 1)
            if len(beside):  # of overlapping pairs of one run every second, from the left
                chosen = np.ones(len(at), bool)
                for i in beside.tolist():
                    if chosen[i]:
                        chosen[i + 1] = False
                at = at[chosen]
            symbols[at] = self.merged[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # Every run merges once at least; mostly each does just once.
            size -= 1 if len(at) == len(size) else np.bincount(np.searchsorted(np.cumsum(size), at, "right"), minlength=len(size))
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            at -= np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = NONE
            near = near[~last[near]]
            rank[near] = self.rank(symbols[near].astype(np.int64) << 20 | symbols[near + 1])
        if not done_run:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        run, size, ids = np.concatenate(done_run), np.concatenate(done_size), np.concatenate(done_ids)
        counts = np.zeros(len(lengths), np.int64)
        counts[run] = size
        order = np.argsort(run)
        return ids[ranges((np.cumsum(size) - size)[order], size[order])].astype(np.int64), counts

    def chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, then start, length and text number of each chunk."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        if self.word:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.zeros(len(data) + 1, bool)
        first[begin[sizes > 0]] = True
        first = first[:-1]
        if self.word:
            starts = np.flatnonzero(~space & (first | np.r_[True, space[:-1]]))
            ends = np.flatnonzero(~space & np.r_[first[1:] | space[1:], True]) + 1
        else:
            cut = space & ~np.r_[True, space[:-1]] & ~first
            odd = np.flatnonzero(cut & np.r_[False, data[:-1] >= 0x80])
            for i in odd[self._wide_space(data, odd)]:
                cut[i] = False
            starts = np.flatnonzero(cut | first)
            ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        doc = np.searchsorted(begin + sizes, starts, "right")
        return data, starts, ends - starts, doc

    @staticmethod
    def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the character before a place is white space beyond ASCII."""
        a, b, c = (data[np.maximum(at - k, 0)].astype(np.int64) for k in (3, 2, 1))
        two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        three = a << 16 | b << 8 | c
        return two | (three == 0xE19A80) | (three == 0xE1A08E) | ((three >= 0xE28080) & (three <= 0xE2808A)) | np.isin(three, [0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])

    def _pieces(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in concatenated plain chunks."""
        cls = CLASS[data]
        _latin(data, cls, not self.word)
        start = np.cumsum(lengths) - lengths
        new = np.zeros(len(data), bool)
        new[start] = True
        new[1:] |= (cls[1:] != cls[:-1]) & (cls[:-1] != SPACE)
        if self.word:
            return np.flatnonzero(new | (cls == DIGIT))
        solid = np.flatnonzero(cls != SPACE)
        at = np.searchsorted(solid, start)
        f = np.where(at < len(solid), solid[np.minimum(at, len(solid) - 1)], len(data)) if len(solid) else np.full(len(start), len(data))
        has = f < start + lengths
        f, r = f[has], (f - start)[has]
        f, r = f[r > 0], r[r > 0]
        new[f[r >= 2] - 1] = True
        new[f[data[f - 1] != 32]] = True
        return np.flatnonzero(new)

    def _odd(self, chunk: bytes) -> list[np.ndarray | int]:
        """Pre-tokens of any chunk by the library's pre-tokenizer: byte runs, and ids of special strings."""
        import re

        out: list = []
        text = chunk.decode("utf-8")
        parts = re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text) if self.specials else [text]
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out += [np.array([self.byte_of[c] for c in piece], np.uint8) for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and the number of ids of each."""
        return self.encode_runs(np.frombuffer(b"".join(chunks), np.uint8), np.array([len(c) for c in chunks], np.int64))

    def encode_runs(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that stand one after the other in data."""
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cls = CLASS[data]
        _latin(data, cls, not self.word)
        start, original = np.cumsum(lengths) - lengths, data
        chunk = lambda i: original[start[i] : start[i] + lengths[i]].tobytes()
        odd = (np.maximum.reduceat(cls, start) == UNSAFE) | (lengths > LONG)
        if self.word and not odd.all():  # upper-case Latin letters, two bytes each
            data = data.copy()
            up = np.flatnonzero(data[:-1] == 0xC3) + 1
            up = up[(data[up] >= 0x80) & (data[up] <= 0x9E) & (data[up] != 0x97)]
            data[up] += 32
        plain = np.flatnonzero(~odd)
        part = data[ranges(start[plain], lengths[plain])]
        ids, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = np.zeros(len(lengths), np.int64)
        if len(plain):
            begin = self._pieces(part, lengths[plain])
            size = np.diff(np.r_[begin, len(part)])
            symbols = self.first[part]
            symbols[begin + size - 1] = self.last[part[begin + size - 1]]
            ids, count = self.merge(symbols, size)
            owner = np.searchsorted(np.cumsum(lengths[plain]), begin, "right")
            counts[plain] = np.bincount(owner, count, len(plain)).astype(np.int64)
        if not odd.any():
            return ids, counts
        more: list[np.ndarray] = []
        strange = np.flatnonzero(odd)
        if self.word:
            for e in self.tok.encode_batch_fast([chunk(i).decode("utf-8") for i in strange], add_special_tokens=False):
                more.append(np.array(e.ids, np.int64))
        else:
            pieces = [self._odd(chunk(i)) for i in strange]
            short = [p for own in pieces for p in own if not isinstance(p, int) and len(p) <= LONG]
            size = np.array([len(p) for p in short], np.int64)
            flat, n = self.merge(self.first[np.concatenate(short)], size) if short else (np.zeros(0, np.int64), size)
            ends, k = np.cumsum(n).tolist(), 0
            for own in pieces:
                got = []
                for piece in own:
                    if isinstance(piece, int):
                        got.append(np.array([piece], np.int64))
                    elif len(piece) > LONG:
                        alphabet = byte_alphabet()
                        got.append(np.array([t.id for t in self.tok.model.tokenize("".join(alphabet[b] for b in piece))], np.int64))
                    else:
                        got.append(flat[ends[k] - n[k] : ends[k]])
                        k += 1
                more.append(np.concatenate(got))
        counts[strange] = [len(m) for m in more]
        out = np.zeros(counts.sum(), np.int64)
        at = np.cumsum(counts) - counts
        out[ranges(at[plain], counts[plain])] = ids
        out[ranges(at[strange], counts[strange])] = np.concatenate(more)
        return out, counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and the number of ids of each."""
        data, starts, lengths, doc = self.chunks(texts)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        one, which = groups(data, starts, lengths)
        s, n = starts[one], lengths[one]
        counts, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        known = self.automaton.lookup(data, s, n) if self.automaton else np.full(len(one), -1, np.int64)
        hit, miss = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
        fresh, fresh_count = self.encode_runs(data[ranges(s[miss], n[miss])], n[miss])
        pool = fresh
        counts[miss], at[miss] = fresh_count, np.cumsum(fresh_count) - fresh_count
        if len(hit):
            a = self.automaton
            counts[hit] = a.offsets[known[hit] + 1] - a.offsets[known[hit]]
            got = a.ids[ranges(a.offsets[known[hit]], counts[hit])]
            at[hit] = len(fresh) + np.cumsum(counts[hit]) - counts[hit]
            pool = np.concatenate([fresh, got])
        ids = pool[ranges(at[which], counts[which])]
        return ids, np.bincount(doc, counts[which], len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; special ones included."""
        return self.text[ranges(self.text_at[ids], self.text_len[ids])].tobytes()


@functools.lru_cache(maxsize=1)
def shared_encoder(content: str) -> Encoder:
    """The process's encoder of a tokenizer: workers run many tasks, and building one takes time and memory."""
    return Encoder(content)
