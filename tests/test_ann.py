"""Approximate top-k against the exact one.  The table's vectors are spread evenly, so
neighbours lie in many lists; the made ones have clusters, as text embeddings have."""

import numpy as np

from gleaner.operators import retrieval as R
from gleaner.operators.ann import VectorLists, fit_centres
from gleaner.session import shared_path

from conftest import SF_SMALL


def _pairs(df):
    return {(r.qid, r.cid) for r in df.collect()}


def test_recall_of_probed_lists(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (30, 16))
    made = spark.createDataFrame([(i, [float(x) for x in middles[i % 30] + rng.normal(0, 0.3, 16)]) for i in range(1500)],
                                 "vec_id long, embedding array<double>")
    for vectors, n_lists, probes in ((e, 16, 11), (made, 32, 4)):
        lists = VectorLists(spark, shared_path(spark, "test-lists", unique=True), n_lists)
        lists.add(vectors, "vec_id")
        exact = _pairs(R.cosine_topk(vectors, vectors, 5, "vec_id", "vec_id"))
        found = _pairs(lists.search(vectors, "vec_id", 5, probes=probes))
        assert len(found & exact) >= 0.9 * len(exact)
        assert _pairs(lists.search(vectors, "vec_id", 5, probes=n_lists)) == exact      # all lists: exact


def test_every_vector_is_stored_and_added_ones_are_found(spark):
    rows = [(i, [float(i % 7 - 3), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0])]
    lists = VectorLists(spark, shared_path(spark, "test-lists", unique=True), 4)
    lists.add(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id")
    assert lists.log.read("vectors").count() == 42 and len(lists.centres()) == 4
    lists.add(spark.createDataFrame([(200, [-9.0, 0.1])], "vec_id long, embedding array<double>"), "vec_id")
    q = spark.createDataFrame([(1, [-8.0, 0.1]), (2, None), (3, [0.0, 0.0])], "qid long, embedding array<double>")
    got = lists.search(q, "qid", 1, probes=1).collect()
    assert [(r.qid, r.cid) for r in got] == [(1, 200)]


def test_fit_of_few_vectors():
    assert len(fit_centres(np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 2.0]]), 8)) == 2
