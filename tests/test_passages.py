"""Passage index: built once, searched through the catalog; labels per question."""

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import retrieval as R
from gleaner.operators.passages import PassageIndex
from gleaner.session import shared_path

DOCS = [(0, "apples and pears grow on trees in the garden"), (1, "rockets fly to the moon with fuel"),
        (2, ""), (3, None), (4, "apples " * 30 + "tail"), (5, "the sea is deep and blue")]


def _docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_hash_embed_is_the_normalised_count(spark):
    got = {r.doc_id: r.embedding for r in R.hash_embed(_docs(spark), ["doc_id"], "text").collect()}
    assert set(got) == {d for d, _ in DOCS}

    def brute(text):
        import hashlib

        v = np.zeros(64)
        for w in (text or "").lower().split():
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        n = np.linalg.norm(v)
        return v / n if n else v

    for d, t in DOCS:
        assert np.allclose(got[d], brute(t), atol=1e-12)


def test_hash_embed_has_no_python(spark):
    plan = R.hash_embed(_docs(spark), ["doc_id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_second_build_embeds_nothing(spark):
    embedded = []

    def embed(df, key, text):
        embedded.append(df.count())
        return R.hash_embed(df, key, text)

    index = PassageIndex(spark, shared_path(spark, "test-passages", unique=True), embed=embed)
    assert index.build(_docs(spark), size=8, overlap=2) == 0
    n = index.chunks().count()
    assert embedded == [n, 12] and index.catalog().count() == 12
    assert index.build(_docs(spark), size=8, overlap=2) == 1
    assert embedded[2:] == [0, 0] and index.chunks().count() == n
    # one more document, one that has grown: only their new chunks
    index.build(_docs(spark, [(6, "new words here"), (1, "rockets fly to the moon with fuel and more fuel")]), size=8, overlap=2)
    assert embedded[4:] == [2 + 1, 2] and index.catalog().count() == 14


def test_passages_come_from_the_chosen_documents(spark):
    index = PassageIndex(spark, shared_path(spark, "test-passages", unique=True), n_buckets=64)
    index.build(_docs(spark), size=8, overlap=2)
    q = spark.createDataFrame([(7, "rockets to the moon"), (8, ""), (9, "apples")], "item_id long, text string")
    rows = index.search(q, "item_id").collect()
    best = {r.item_id: r for r in rows if r["rank"] == 1}
    assert set(best) == {7, 9}                              # no tokens, no passage
    assert best[7].doc_id == 1 and best[7].chunk_text.startswith("rockets fly")
    assert best[9].doc_id == 4 and set(best[9].chunk_text.split()) <= {"apples", "tail"}
    assert all(r["rank"] <= 2 for r in rows)


def test_only_the_buckets_of_the_documents_are_read(spark):
    index = PassageIndex(spark, shared_path(spark, "test-passages", unique=True), n_buckets=64)
    index.build(_docs(spark, [(i, f"text number {i}") for i in range(200)]))
    one = index.chunks(spark.createDataFrame([(17,)], "doc_id long"))
    assert [r.doc_id for r in one.collect()] == [17]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]


def test_label_lists_per_question(spark):
    c = spark.createDataFrame([(i, [1.0, float(i)], ["a", "b", "c"][i % 3]) for i in range(9)], "cid long, embedding array<double>, label string")
    q = spark.createDataFrame([(0, [0.0, 1.0], []), (1, [0.0, 1.0], ["a"]), (2, [0.0, 1.0], ["b", "c", "b"]), (3, [0.0, 1.0], None),
                               (4, [0.0, 1.0], ["none"])], "qid long, embedding array<double>, labels array<string>")
    got = {}
    for r in R.topk_labelled(q, c, 3, "qid", "cid", "labels", "label").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.cid)
    assert got == {0: [8, 7, 6], 1: [6, 3, 0], 2: [8, 7, 5], 3: [8, 7, 6]}


def test_a_build_shuffles_no_text(spark):
    index = PassageIndex(spark, shared_path(spark, "test-passages", unique=True))
    write, plans = index.log.write_attempt, {}

    def seen(table, rows, *more):
        plans.setdefault(table, []).append(rows._jdf.queryExecution().executedPlan().toString())
        return write(table, rows, *more)

    index.log.write_attempt = seen
    for _ in range(2):
        index.build(_docs(spark), size=8, overlap=2)
    assert all("Exchange" not in plans[t][0] and "Join" not in plans[t][0] for t in ("chunks", "catalog"))
    assert index.catalog().count() == 12 and index.chunks().where("batch_id > 0").isEmpty()


def test_equal_chunks_of_a_document_in_one_row_or_several(spark):
    words = "a b c d e f g h "
    rows = [(1, words * 3), (1, "x y " + words), (2, words * 3), (2, words * 3), (3, words), (4, "z " * 40), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = PassageIndex(spark, shared_path(spark, "test-passages", unique=True))
    index.build(docs, size=8, overlap=0)
    got = sorted((r.doc_id, r.chunk_text, r.chunk_pos) for r in index.chunks().collect())
    chunks = R.chunk(docs.na.fill({"text": ""}), "text", 8, 0).groupBy("doc_id", "chunk_text").agg(F.min("chunk_pos").alias("chunk_pos"))
    assert got == sorted((r.doc_id, r.chunk_text, r.chunk_pos) for r in chunks.collect())
    assert index.catalog().count() == 14
    # a document that has grown: its new chunks only, the others untouched
    index.build(spark.createDataFrame([(3, words + "new"), (4, "z " * 40)], "doc_id long, text string"), size=8, overlap=0)
    new = index.chunks().where("batch_id = 1").collect()
    assert [(r.doc_id, r.chunk_text, r.chunk_pos) for r in new] == [(3, "new", 1)]


def test_hash_vector_equals_hash_embed(spark):
    rows = [*DOCS, (6, "Ä ä ß  \t a\r\na A"), (7, "  x y")]
    want = {r.doc_id: r.embedding for r in R.hash_embed(_docs(spark, rows), ["doc_id"], "text").collect()}
    got = {r.doc_id: r.embedding for r in R.hash_vector(_docs(spark, rows), "text").collect()}
    assert got == want
