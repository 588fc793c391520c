"""Phrase collocations against a brute-force count."""

import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, prefix string, n long, h long, slice int"


def brute(rows, least=C.LEAST, top=C.TOP):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = collections.defaultdict(int)
    for (lang, p), a in cand.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(longer[lang, q], a)
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * longer[lang, p] >= 50 * a and longer[lang, p]:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def made(seed=1, docs=300):
    rng = np.random.default_rng(seed)
    words = np.array(["the", "of", "New", "YORK", "city", "naïve", "été", "x", "a-b", "中文", "#", "Ä"])
    weight = 1 / np.arange(1, len(words) + 1)
    ends = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "? ", ";\v", "   "]
    rows = []
    for i in range(docs):
        got = rng.choice(words, rng.integers(0, 40), p=weight / weight.sum())
        text = "".join(w + ends[k] for w, k in zip(got, rng.integers(0, len(ends), len(got))))
        if i % 3 == 0:
            text += " new york city hall " * (i % 4)
        rows.append((text, ["en", "de", None, "und"][i % 4]))
    return rows + [(None, "en"), ("", None), (" . , ", "fr"), ("w" * 100_000 + " tail", "en"), ("once only here", "xx")] + [("same row again", "en")] * 30


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, g, "p", 1, 2, 3) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)


def got_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_phrases_against_brute_force(spark):
    rows = made()
    want = brute(rows)
    assert len(want) > 50 and {r[0] for r in want} == {"en", "de", "und"}
    assert got_of(C.collocations(frame(spark, rows))) == want
    assert C.collocations(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("share,bits,block", [(3, 26, 50_000), (10_000, 15, 50_000), (20, 20, 1)])
def test_hot_prefixes_are_split_and_a_full_bitmap_loses_nothing(spark, monkeypatch, share, bits, block):
    monkeypatch.setattr(C, "SHARE", share)          # many slices of hot prefixes
    monkeypatch.setattr(C, "BITS", bits)
    monkeypatch.setattr(C, "BATCH_BYTES", 3000)     # many stripes of a prefix
    monkeypatch.setattr(C, "BLOCK", block)
    rows = made(2)
    assert got_of(C.collocations(frame(spark, rows, 7), top=5)) == brute(rows, top=5)


def test_bitmap_is_the_set(spark, monkeypatch):
    monkeypatch.setattr(C, "BITS", 18)
    h = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 500)
    bits = C.bitmap_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert C.allowed(bits, h.view(np.uint64)).all()
    assert np.unpackbits(bits).sum() == len(np.unique(h & (2**18 - 1)))


def test_words_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", None, "en"], "text": ["A b.C\td", None, "b  Éa"]})
    w = C.Words(batch)
    assert [w.names[int(c)].as_py() for c in w.code] == ["a", "b", "c", "d", "b", "Éa"]
    assert w.next.tolist() == [True, False, True, False, True, False]
    assert len(set(w.key_hash.tolist())) == 5


def test_exact_scores_of_large_counts(spark):
    """Counts whose products pass 64 bits."""
    a, left, right = 3_000_000_007, 9_000_000_011, 3_000_000_019
    wide = "cast(%d as decimal(19,0))"
    got = spark.sql(f"select ({wide % a} * {wide % a} * cast(1000000 as decimal(7,0))) div ({wide % left} * {wide % right})").first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_words_of_a_batch_take_few_bytes_for_each_byte_of_text():
    """Executors went past their memory: nothing of 8 bytes stands for each byte of text."""
    rng = np.random.default_rng(3)
    names = np.array(["w%d" % i for i in range(3000)])
    text = [" ".join(rng.choice(names, 400)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(text), "text": text})
    C.Words(batch)                                  # powers of the hashes are kept
    tracemalloc.start()
    try:
        w = C.Words(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(w.code) == 400_000
    assert peak < 14 * batch.nbytes


def test_stripes_are_handed_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(C, "ENTRIES", 3)
    rows = made(4)
    batch = pa.RecordBatch.from_pydict({"lang": [g for _, g in rows], "text": [t for t, _ in rows]})
    bits, none = np.full(1 << (C.BITS - 3), 255, np.uint8), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for of in (C.words_of, C.pairs_of):
        got = list(of(batch, bits, none))
        assert len(got) > 10 and sum(len(b) for b in got) == len({k for b in got for k in b.column("key").to_pylist()})
        # a batch ends with the stripe that fills it
        assert all(sum(len(x.split(" ")) for x in b.column("stripe").to_pylist()[:-1]) <= 3 for b in got)
    monkeypatch.setattr(C, "SHARE", 3)              # slices of hot prefixes, too
    assert got_of(C.collocations(frame(spark, rows), top=7)) == brute(rows, top=7)


def test_hashes_in_small_steps(monkeypatch):
    words = pa.array(["", "a", "b" * 50, "", "ab", "ba", "é", "x" * 9, "a", ""], pa.large_string())
    whole = C.hashes(words)
    assert len(set(whole.tolist())) == 7 and len(C.hashes(words[:0])) == 0
    for step in (1, 2, 7, 60):
        monkeypatch.setattr(C, "HASHED", step)
        for low in range(len(words)):
            assert C.hashes(words[low:]).tolist() == whole[low:].tolist()
