"""Token-ID files: blocks, random access, whole tables against the library."""

import zlib

import numpy as np
import pytest

from gleaner.llm import tokenfile as T
from gleaner.llm.util import open_fs, scratch
from gleaner.llm.wordbpe import vocabulary_text

SCHEMA = "doc_id long, text string, start long, path string, _tie string"


def blocks_of(ids):
    got = T.pack_blocks(ids)
    data = np.frombuffer(b"".join(got), np.uint8)
    start = np.cumsum([0, *(len(b) for b in got)])[:-1]
    return data, start


@pytest.mark.parametrize("top", [1, 2, 5, 300, 49_408, 2**32 - 1])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top % 97)
    ids = rng.integers(0, top, T.BLOCK * 6).astype(np.uint32)
    ids[T.BLOCK:2 * T.BLOCK] = top - 1                    # one value: no bits
    ids[2 * T.BLOCK:3 * T.BLOCK] = np.where(rng.random(T.BLOCK) < 0.05, top - 1, 0)
    data, start = blocks_of(ids)
    assert np.array_equal(T.unpack_blocks(data, start), ids)
    assert np.array_equal(T.unpack_blocks(data, start[3:5]), ids[3 * T.BLOCK:5 * T.BLOCK])


def test_width_is_the_percentile_and_outliers_are_exceptions():
    ids = np.full(T.BLOCK, 1000, np.uint32)
    ids[::3] += 7
    ids[5], ids[400] = 40_000, 2**31
    data, start = blocks_of(ids)
    low, (width, odd) = data[:4].view("<u4")[0], data[4:8].view("<u2")
    assert (low, width, odd) == (1000, 3, 2)
    assert len(data) == 8 + T.BLOCK * 3 // 8 + 2 * 6
    assert np.array_equal(T.unpack_blocks(data, start), ids)


def test_reader_reads_any_run_and_refuses_a_cut_file(spark, monkeypatch):
    monkeypatch.setattr(T, "STEP", 4 * T.BLOCK)
    folder = scratch(spark, "t12")
    fs, base = open_fs(folder)
    fs.create_dir(base)
    rng = np.random.default_rng(2)
    sizes = np.array([1, 700, 0, 30_000, 5, 5, 512, 3])
    ids = rng.integers(0, 50_000, sizes.sum()).astype(np.int32)
    w = T.Writer(folder)
    w.add(np.arange(4), np.array([True, False, False, False]), ids[:sizes[:4].sum()], sizes[:4])
    w.add(np.arange(4, 8), np.zeros(4, bool), ids[sizes[:4].sum():], sizes[4:])
    w.close()
    r = T.Reader(w.path, fs)
    for a, b in [(0, 1), (0, len(ids)), (511, 513), (700, 700), (20_000, 20_600), (len(ids) - 3, len(ids))]:
        assert np.array_equal(r.ids(a, b), ids[a:b])
    crcs = [c for _, x in r.documents() for c in x]
    assert crcs == [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert r.docs.tolist() == list(range(8)) and r.nulls.tolist() == [True] + [False] * 7
    whole = open(w.path, "rb").read()
    with open(w.path + "x", "wb") as f:
        f.write(whole[:-3])
    with pytest.raises(ValueError):
        T.Reader(w.path + "x", fs)


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary_text())
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, T.END], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, monkeypatch):
    rows = [(i * 7 % 50, f"Text {i}, it's number {i * i}! " * (i % 9)) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "é中文<|endoftext|> x\x1cy"), (63, "long words " * 20_000), (None, "no id"), (-4, "before")]
    docs = spark.createDataFrame([(*r, 1, "p", "t") for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(T, "FILE_DOCS", 1)                # several files a task
    monkeypatch.setattr(T, "BATCH_BYTES", 2000)
    folder = scratch(spark, "t12")
    manifest = T.write_files(docs, vocabulary_text(), folder)
    assert manifest.count() > 1
    got = [tuple(r) for r in T.read_files(manifest).collect()]
    want = brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted(got, key=lambda r: r[1]) == want


def test_repeated_ids_share_no_task_order_and_lose_nothing(spark):
    rows = [(5, f"same id {i % 40}") for i in range(400)] + [(1, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in T.read_files(T.write_files(docs, vocabulary_text(), scratch(spark, "t12"))).orderBy("start").collect()]
    assert [r[0] for r in got] == [1] + [5] * 400 + [9]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows))
    nothing = docs.limit(0)
    assert T.read_files(T.write_files(nothing, vocabulary_text(), scratch(spark, "t12"))).count() == 0
