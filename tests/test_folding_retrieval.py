"""Folding, ordered scans, chunking, top-k and tree reduction on hand-made rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import retrieval as R
from gleaner.operators import scan
from gleaner.operators import transcripts as TR

T0 = dt.datetime(2025, 1, 1)


def _events(spark, rows):
    data = [(i, T0 + dt.timedelta(minutes=i), "s", a, o) for i, (a, o) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, ts timestamp, session string, agent string, out string")


def test_last_output_skips_speaker_change(spark):
    ev = _events(spark, [("A", "hello"), ("A", "first"), ("B", "announce"), ("B", ""), ("B", "final"),
                         ("C", "switch only")])
    (r,) = TR.last_output(ev, ["session"], ["ts", "seq"], "agent", "out", F.col("ts")).collect()
    assert r.last_output == "final"


def test_state_defaults(spark):
    ev = spark.createDataFrame([("s", 1, "review", "ok"), ("s", 2, "review", "better")],
                               "session string, seq long, name string, value string")
    (r,) = TR.state_with_defaults(ev, ["session"], "name", "value", ["seq"]).collect()
    assert (r.report_content, r.review) == ("Not written yet.", "better")


def test_call_budget(spark):
    rows = TR.call_budget(_events(spark, [("a", "x")] * 11).withColumn("ok", F.lit(True)),
                          ["session"], ["ts", "seq"], F.col("ok"), F.col("ts")).orderBy("seq").collect()
    assert [r.rejected for r in rows] == [False] * 10 + [True]
    flags = [True] * 9 + [False, True]
    ev = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), "s", f) for i, f in enumerate(flags)],
                               "seq long, ts timestamp, session string, ok boolean")
    rows = TR.call_budget(ev, ["session"], ["ts", "seq"], F.col("ok"), F.col("ts")).orderBy("seq").collect()
    assert [r.rejected for r in rows] == [False] * 11


def test_two_level_scans_equal_plain_windows(spark):
    rnd = random.Random(7)
    rows = [(k, i, rnd.choice("xyz")) for k in range(3) for i in range(300)]
    rows += [(99, i, rnd.choice("xyz")) for i in range(3000)]   # one hot key
    df = spark.createDataFrame(rows, "k int, pos int, v string")
    bucket = F.floor(F.col("pos") / 37)
    w = Window.partitionBy("k").orderBy("pos")
    want = df.select("k", "pos", F.lag("v").over(w).alias("p"),
                     F.coalesce(F.sum((F.col("v") == "x").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)).alias("n"),
                     F.min(F.when(F.col("v") == "z", F.col("pos"))).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("nx"))
    got = scan.previous_value(df, ["k"], ["pos"], "v", bucket, out="p")
    got = scan.count_before(got, ["k"], ["pos"], F.col("v") == "x", bucket, out="n")
    got = scan.next_matching(got, ["k"], ["pos"], F.col("v") == "z", "pos", bucket, out="nx")
    a = sorted(tuple(r) for r in want.collect())
    b = sorted(tuple(r) for r in got.select("k", "pos", "p", "n", "nx").collect())
    assert a == b


def test_chunk_counts_and_overlap(spark):
    lens = [0, 1, 200, 1024, 1025, 1848, 1849]
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in lens], "n int, text string")
    c = R.chunk(docs, "text")
    counts = {r.n: r.k for r in c.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert [counts[n] for n in lens] == [1, 1, 1, 1, 2, 2, 3]
    rows = c.where("n = 1849").orderBy("chunk_pos").collect()
    toks = [r.chunk_text.split(" ") for r in rows]
    assert toks[0][-200:] == toks[1][:200] and toks[1][-200:] == toks[2][:200]
    rebuilt = toks[0] + toks[1][200:] + toks[2][200:]
    assert rebuilt == [f"w{i}" for i in range(1849)]


def test_cosine_topk_matches_brute_force_across_blocks(spark):
    rnd = np.random.default_rng(3)
    vecs = rnd.normal(size=(300, 8))
    vecs[5] = vecs[4]          # exact tie: lower id must win
    labels = rnd.integers(0, 3, 300)
    df = spark.createDataFrame([(i, vecs[i].tolist(), int(labels[i])) for i in range(300)],
                               "id long, embedding array<double>, label int")
    got = R.cosine_topk(df, df, 3, "id", "id", exclude_self=True, q_block=64, c_block=50)
    got = {(r.qid, r.rank): r.cid for r in got.collect()}
    n = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -np.inf)
    for q in range(300):
        order = sorted(range(300), key=lambda c: (-round(s[q, c], 9), c))[:3]
        assert [got[(q, r)] for r in (1, 2, 3)] == order
    scoped = R.cosine_topk(df, df, 2, "id", "id", scope="label", exclude_self=True, q_block=64, c_block=50)
    lab = {i: int(labels[i]) for i in range(300)}
    assert all(lab[r.qid] == lab[r.cid] for r in scoped.collect())


def test_catalog_ties_and_single_doc(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "same")], "doc_id long, name string")
    cat = R.tool_catalog(docs, "doc_id", "name").withColumn("tool_id", F.col("doc_id") * 2 + F.col("tool_pos"))
    assert cat.count() == 6
    vec = R.hash_embed(cat, ["tool_id"], "description")
    q = R.hash_embed(spark.createDataFrame([(0, "query the document same")], "qid long, text string"),
                     ["qid"], "text")
    top = R.cosine_topk(q, vec, 3, "qid", "tool_id").orderBy("rank").collect()
    assert [r.cid for r in top] == [2, 4, 6]         # equal similarity -> lowest ids
    one = R.tool_catalog(docs.limit(1), "doc_id", "name").collect()
    assert [r.tool_name for r in one] == ["vector_tool_same", "summary_tool_same"]


def test_tree_reduce_loses_no_node(spark):
    rows = [("d", i, f"text of node {i} " * 5, 9) for i in range(9)]
    whole = R.tree_reduce(spark.createDataFrame(rows, "doc string, pos long, text string, n long"), "doc", fanout=4).first()
    assert whole.summary == " ".join(r[2] for r in rows)


def test_tree_reduce_levels(spark):
    rows = [(1, p, f"node{p}", 9) for p in range(9)] + [(2, 0, "only", 1)]
    nodes = spark.createDataFrame(rows, "doc long, pos long, text string, n long")
    out = {r.doc: (r.summary, r.n_levels) for r in R.tree_reduce(nodes, "doc", fanout=4).collect()}
    lvl1 = ["node0 node1 node2 node3", "node4 node5 node6 node7", "node8"]
    assert out[1] == (" ".join(x[:40] for x in lvl1), 2)
    assert out[2] == ("only", 1)


def test_index_insert_is_idempotent(spark):
    from gleaner.session import shared_path

    idx = R.VectorIndex(spark, shared_path(spark, "test-index", unique=True))
    c = spark.createDataFrame([(1, 0, "h1"), (1, 1, "h1"), (1, 2, "h2")], "doc_id long, chunk_pos int, chunk_hash string")
    idx.insert(c)
    idx.insert(c)
    assert sorted((r.chunk_hash, r.chunk_pos) for r in idx.read().collect()) == [("h1", 0), ("h2", 2)]


def test_sentence_chunks(spark):
    sents = [" ".join(f"s{j}w{i}" for i in range(5 + j % 7)) + "." for j in range(60)]
    text = " ".join(sents)
    chunks = R.sentence_chunks(text, size=40, overlap=12)
    toks = [c.split() for c in chunks]
    assert all(len(t) <= 40 for t in toks)
    # every chunk is made of whole sentences, and all sentences appear in order
    seen = []
    for c in chunks:
        for sent in [x + "." for x in c.split(". ") if x]:
            s = sent if sent.endswith("..") is False else sent[:-1]
            assert s.rstrip(".") + "." in sents
            if not seen or sents.index(s.rstrip(".") + ".") > sents.index(seen[-1]):
                seen.append(s.rstrip(".") + ".")
    assert seen == sents
    # consecutive chunks overlap by trailing sentences of at most 12 tokens
    for a, b in zip(toks, toks[1:]):
        k = next(i for i in range(len(a) + 1) if b[:len(a) - i] == a[i:]) if a else len(a)
        assert len(a) - k <= 12
    assert R.sentence_chunks("", 40, 12) == [""]
    long = " ".join(f"w{i}" for i in range(100)) + "."
    assert [len(c.split()) for c in R.sentence_chunks(long, 40, 12)] == [40, 40, 20]
    df = spark.createDataFrame([(1, text)], "doc long, text string")
    rows = R.chunk(df, "text", 40, 12, mode="sentence").orderBy("chunk_pos").collect()
    assert [r.chunk_text for r in rows] == chunks and rows[0].n_chunks == len(chunks)


def test_range_buckets_split_a_hot_key(spark):
    rnd = random.Random(11)
    rows = [(1, i, rnd.choice("xy")) for i in range(4000)] + [(2, i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, pos int, v string")
    b = scan.with_range_bucket(df, ["k"], ["pos"], n=8)
    sizes = [r["count"] for r in b.groupBy("k", "_rb").count().collect()]
    assert max(sizes) < 4000 / 2                       # the hot key spans several buckets
    got = scan.previous_value(b, ["k"], ["pos"], "v", F.col("_rb"), out="p")
    want = df.select("k", "pos", F.lag("v").over(Window.partitionBy("k").orderBy("pos")).alias("p"))
    assert sorted(tuple(r) for r in got.select("k", "pos", "p").collect()) == sorted(tuple(r) for r in want.collect())


def test_scoped_blocks_follow_each_scope(spark):
    """A question is copied as often as its own scope has blocks; results are exact."""
    import numpy as np

    rng = np.random.default_rng(5)
    scopes = [None] * 3 + ["hot"] * 90 + ["s1"] * 4 + ["lone"]
    coll = [(i, s, rng.normal(size=4).tolist()) for i, s in enumerate(scopes)]
    ques = [(1000 + i, s, rng.normal(size=4).tolist()) for i, s in enumerate(["hot", "hot", "hot", "s1", None, "none"])]
    c = spark.createDataFrame(coll, "cid long, doc string, embedding array<double>")
    q = spark.createDataFrame(ques, "qid long, doc string, embedding array<double>")
    qb, cb = R.with_blocks(q, c, "doc", 2, 10)
    copies = {r.qid: r["count"] for r in qb.groupBy("qid").count().collect()}
    assert copies == {1000: 9, 1001: 9, 1002: 9, 1003: 1, 1004: 1}
    assert {r.doc: r["count"] for r in cb.groupBy("doc").count().collect()} == {None: 3, "hot": 180, "s1": 4}
    got = {}
    for r in R.cosine_topk(q, c, 2, "qid", "cid", scope="doc", q_block=2, c_block=10).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.cid
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = {}
    for i, s, v in ques:
        best = sorted((-cos(v, w), j) for j, t, w in coll if t == s)[:2]
        if best:
            want[i] = {k + 1: j for k, (_, j) in enumerate(best)}
    assert got == want
