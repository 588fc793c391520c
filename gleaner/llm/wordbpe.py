"""Ids of a word-level BPE vocabulary for many texts at once, in Arrow and NumPy.

The tokenizer drops white space and cuts words into runs of letters, single digits
and runs of other characters, so words are independent of each other.  Texts are
cut at white space in Arrow; only distinct words of a batch are cut into pieces,
and only distinct pieces are merged, all of one length together: every row of a
matrix loses one symbol a round.  No Python object is made for a word.

Words whose code points need more than two bytes, with marks, apostrophes or "<|",
and pieces of over ``LONGEST`` bytes go through the tokenizers library, each
distinct one once; so do whole texts that hold the separators \\x1c to \\x1f,
which only one of the two sides takes for white space.  The ids are always those
of the library.

Nulls and empty texts have no ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

LONGEST = 64
SLOTS_BITS = 19
NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Classes of code points.
LETTER, NUMBER, OTHER, UNSAFE = 0, 1, 2, 3


def vocabulary_text(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def slot_of(key: np.ndarray) -> np.ndarray:
    return ((key * _MIX) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)


def code_points() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case code point) of every code point below 0x800."""
    kind, low = np.full(0x800, UNSAFE, np.uint8), np.arange(0x800)
    for cp in range(0x800):
        c = chr(cp)
        category, lower = unicodedata.category(c), c.lower()
        fits = len(lower) == 1 and (len(lower.encode()) == len(c.encode()))
        if category[0] in "M" or category in ("Cn", "Cs", "Co") or not fits or not unicodedata.is_normalized("NFC", c):
            continue
        kind[cp] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
        low[cp] = ord(lower)
    return kind, low


def compile_tables(spec: str) -> dict[str, np.ndarray]:
    """Arrays of a vocabulary: first ids of bytes, a hash table of merges, ranks of
    pairs of bytes, classes and lower case of code points."""
    model = json.loads(spec)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    letters = byte_letters()
    inner = np.array([vocab[c] for c in letters], np.int32)
    last = np.array([vocab[c + end] for c in letters], np.int32)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    key = np.array([(vocab[a] << 24) + vocab[b] for a, b in pairs], np.uint64)
    slots = np.full(1 << SLOTS_BITS, np.iinfo(np.uint64).max, np.uint64)
    rank = np.full(1 << SLOTS_BITS, NO_RANK, np.int32)
    _, first = np.unique(key, return_index=True)    # of a repeated pair the first counts
    left = np.sort(first)
    at = slot_of(key[left])
    while len(left):
        free = slots[at] == np.iinfo(np.uint64).max
        _, one = np.unique(at, return_index=True)
        take = np.zeros(len(left), bool)
        take[one] = True
        take &= free
        slots[at[take]], rank[at[take]] = key[left[take]], left[take]
        left, at = left[~take], (at[~take] + 1) & ((1 << SLOTS_BITS) - 1)
    out = {"inner": inner, "last": last, "slots": slots, "rank": rank,
           "product": np.array([vocab[a + b] for a, b in pairs], np.int32)}
    out["kind"], out["low"] = code_points()
    for name, second in (("rank_inner", inner), ("rank_last", last)):
        a, b = np.meshgrid(inner, second, indexing="ij")
        out[name] = rank_of(out, a.ravel(), b.ravel()).reshape(256, 256)
    return out


def rank_of(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge ranks of pairs of ids (``NO_RANK``: no merge)."""
    key = (a.astype(np.uint64) << np.uint64(24)) + b.astype(np.uint64)
    at = slot_of(key)
    found = t["slots"][at]
    out = np.where(found == key, t["rank"][at], NO_RANK)
    look = np.flatnonzero((found != key) & (found != np.iinfo(np.uint64).max))
    at = at[look]
    while len(look):
        at = (at + 1) & ((1 << SLOTS_BITS) - 1)
        found = t["slots"][at]
        hit = found == key[look]
        out[look[hit]] = t["rank"][at[hit]]
        go = ~hit & (found != np.iinfo(np.uint64).max)
        look, at = look[go], at[go]
    return out


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated runs ``flat[start:start + size]``."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat((start - (ends - size)).astype(np.int64), size)
    index += np.arange(total)
    return flat[index]


def merged(t: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per piece) of byte strings of 1 to ``LONGEST`` bytes: in each always
    the pair of lowest rank, leftmost first."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    ids = np.zeros((0, LONGEST + 1), np.int32)
    rank = np.zeros((0, LONGEST), np.int32)
    who = np.zeros(0, np.int64)
    by_size = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[by_size], np.arange(LONGEST + 2))
    for n in range(LONGEST, 0, -1):
        new = by_size[bounds[n]:bounds[n + 1]]
        if len(ids):
            # rows carried on from n + 1 symbols merge one pair and lose one symbol
            row = np.arange(len(ids))
            j = rank.argmin(1)
            r = rank[row, j]
            end = r == NO_RANK
            if end.any():
                done.append((who[end], ids[end]))
                go = ~end
                ids, rank, who, j, r = ids[go], rank[go], who[go], j[go], r[go]
                row = np.arange(len(ids))
            ids[row, j] = t["product"][r]
            keep = np.ones(ids.shape, bool)
            keep[row, j + 1] = False
            ids = ids[keep].reshape(len(row), n)
            keep = np.ones(rank.shape, bool)
            keep[row, j] = False
            rank = rank[keep].reshape(len(row), n - 1)
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = rank_of(t, ids[left, j[left] - 1], ids[left, j[left]])
            right = np.flatnonzero(j < n - 1)
            rank[right, j[right]] = rank_of(t, ids[right, j[right]], ids[right, j[right] + 1])
        else:
            ids, rank = np.zeros((0, n), np.int32), np.zeros((0, n - 1), np.int32)
        if len(new):
            raw = data[start[new][:, None] + np.arange(n)]
            fresh = t["inner"][raw]
            fresh[:, -1] = t["last"][raw[:, -1]]
            pairs = np.concatenate([t["rank_inner"][raw[:, :-2], raw[:, 1:-1]], t["rank_last"][raw[:, -2:-1], raw[:, -1:]]],
                                   axis=1) if n > 1 else np.zeros((len(new), 0), np.int32)
            ids, rank, who = np.concatenate([ids, fresh]), np.concatenate([rank, pairs]), np.concatenate([who, new])
    done.append((who, ids))
    out_size = np.zeros(len(size), np.int64)
    for w, x in done:
        out_size[w] = x.shape[1]
    at = np.cumsum(out_size) - out_size
    out = np.zeros(int(out_size.sum()), np.int32)
    for w, x in done:
        out[(at[w][:, None] + np.arange(x.shape[1])).ravel()] = x.ravel()
    return out, out_size


class WordBpe:
    """Encoder of one task."""

    def __init__(self, spec: str, tables: dict[str, np.ndarray]):
        self.spec, self.t, self.library_ = spec, tables, None

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) by the tokenizers library."""
        if self.library_ is None:
            from tokenizers import Tokenizer

            self.library_ = Tokenizer.from_str(self.spec)
            self.library_.no_truncation()
            self.library_.no_padding()
        out = [np.zeros(0, np.int32)]
        size = np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 10_000):     # an encoding is far larger than its ids
            for i, e in enumerate(self.library_.encode_batch_fast(texts[at:at + 10_000], add_special_tokens=False)):
                x = np.array(e.ids, np.int32)
                size[at + i] = len(x)
                out.append(x)
        return np.concatenate(out), size

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct words without white space."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]] if words.buffers()[2] else np.zeros(0, np.uint8)
        off = off - off[0]
        # words that the library must encode
        bad = (data >= 0xE0) | (data == 0x27)
        bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        lead = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
        cp = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
        bad[lead] |= self.t["kind"][cp] == UNSAFE
        total = np.concatenate([[0], np.cumsum(bad)])
        odd = total[off[1:]] > total[off[:-1]]
        slow = np.flatnonzero(odd)
        slow_ids, slow_size = self.library(words.take(pa.array(slow)).to_pylist())
        # the others: lower case and classes on one buffer
        size = np.diff(off)
        if len(slow):
            data = data[np.repeat(~odd, size)]
            lead = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
            cp = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
        fast = np.flatnonzero(~odd)
        size = size[fast]
        start = np.cumsum(size) - size
        kind = self.t["kind"][np.where(data < 0x80, data, 0)]
        low = self.t["low"]
        lowered = np.where(data < 0x80, low[np.where(data < 0x80, data, 0)], data).astype(np.uint8)
        kind[lead] = kind[lead + 1] = self.t["kind"][cp]
        lowered[lead], lowered[lead + 1] = 0xC0 | (low[cp] >> 6), 0x80 | (low[cp] & 63)
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        cut[start] = True
        cut[lead + 1] = False
        piece_at = np.flatnonzero(cut)
        ids, got_at, got_size = self.piece_ids(lowered, piece_at)
        # pieces back into words
        first = np.searchsorted(piece_at, start)
        ends = np.concatenate([[0], np.cumsum(got_size)])
        fast_size = ends[np.append(first[1:], len(piece_at))] - ends[first] if len(first) else np.zeros(0, np.int64)
        flat = ragged(ids, got_at, got_size)
        out_start, out_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        out_size[fast], out_size[slow] = fast_size, slow_size
        out_start[fast] = np.cumsum(fast_size) - fast_size
        out_start[slow] = len(flat) + np.cumsum(slow_size) - slow_size
        return np.concatenate([flat, slow_ids]), out_start, out_size

    def piece_ids(self, data: np.ndarray, piece_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of the pieces that ``data`` is cut into at ``piece_at``."""
        offsets = np.append(piece_at, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(piece_at), [
            None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        names, code = pieces.dictionary, pieces.indices.to_numpy()
        off = np.frombuffer(names.buffers()[1], np.int64)[:len(names) + 1] if len(names) else np.zeros(1, np.int64)
        raw = np.frombuffer(names.buffers()[2], np.uint8) if len(names) else np.zeros(0, np.uint8)
        size = np.diff(off)
        short, long = np.flatnonzero(size <= LONGEST), np.flatnonzero(size > LONGEST)
        ids, got = merged(self.t, raw, off[:-1][short], size[short])
        long_ids, long_got = self.library([names[int(i)].as_py().decode() for i in long])
        all_size, all_at = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        all_size[short], all_size[long] = got, long_got
        all_at[short], all_at[long] = np.cumsum(got) - got, len(ids) + np.cumsum(long_got) - long_got
        return np.concatenate([ids, long_ids]), all_at[code], all_size[code]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        cut = pc.utf8_split_whitespace(plain)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        words = cut.flatten().cast(pa.large_string())
        filled = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)     # at the ends of a text
        bounds = np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]
        words = words.filter(pa.array(filled)).dictionary_encode()
        ids, start, size = self.word_ids(words.dictionary)
        code = words.indices.to_numpy()
        by_word = size[code]
        flat = ragged(ids, start[code], by_word)
        total = np.concatenate([[0], np.cumsum(by_word)])[bounds]
        out_size = np.diff(total)
        if not whole.any():
            return flat, out_size
        odd = np.flatnonzero(whole)
        odd_ids, odd_size = self.library([texts[int(i)].as_py() for i in odd])
        at = total[:-1].copy()
        at[odd], out_size[odd] = len(flat) + np.cumsum(odd_size) - odd_size, odd_size
        return ragged(np.concatenate([flat, odd_ids]), at, out_size), out_size


def ended(ids: np.ndarray, size: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The same runs of ids with the id ``last`` behind each."""
    size = size + 1
    out = np.full(len(ids) + len(size), last, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size) - 1] = False
    out[inside] = ids
    return out, size


def encoder(spark: SparkSession, spec: str):
    """A function that makes a task's encoder; vocabulary and tables (of fixed size)
    are broadcast."""
    shared = spark.sparkContext.broadcast((spec, compile_tables(spec)))
    return lambda: WordBpe(*shared.value)
