"""Approximate top-k for many questions: vectors stored by list, a few lists searched.

The centres of the lists are fitted on a bounded sample of the vectors (a share by hash
of the id); every vector is stored, under its nearest centre.  A question
searches its ``probes`` nearest lists exactly, so the only error is a neighbour in
another list; ``probes = n_lists`` is the exact search.  ``retrieval.cosine_topk`` stays the
default where exactness matters.

Vectors that are null, empty or of length zero have no direction: they are stored in
list -1 and never found, as in the exact search.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.retrieval import cosine_topk
from gleaner.sources.commits import CommitLog

#: About so many vectors are sampled to fit the centres; rounds of the fit.
SAMPLE, FIT_ROUNDS = 20_000, 10


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fit_centres(sample: np.ndarray, n_lists: int, seed: int = 0) -> np.ndarray:
    """Directions of at most ``n_lists`` lists: rounds of nearest centre and mean direction."""
    x = _unit(np.asarray(sample, float))
    x = x[np.abs(x).sum(1) > 0]
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:n_lists]]
    for _ in range(FIT_ROUNDS):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        used = np.bincount(at, minlength=len(centres)) > 0
        centres = np.where(used[:, None], _unit(sums), centres)
    return centres


def nearest_lists(df: DataFrame, centres: np.ndarray, vec: str, probes: int = 1) -> DataFrame:
    """``df`` with ``list``: a row for each of the ``probes`` nearest lists (-1: no direction)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = np.array([v is not None and len(v) == centres.shape[1] and bool(np.any(v)) for v in pdf[vec]], bool)
            lists = np.full((len(pdf), probes), -1)
            if good.any() and len(centres):
                s = _unit(np.stack([np.asarray(v, float) for v in pdf[vec][good]])) @ centres.T
                k = min(probes, s.shape[1])
                lists[good, :k] = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row, slot = np.nonzero((lists >= 0) | ((np.arange(probes) == 0) & ~good[:, None]))
            yield pdf.iloc[row].assign(list=lists[row, slot])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, schema + ", list int")


class VectorLists:
    """Stored vectors (cid, embedding) by list, and their centres."""

    def __init__(self, spark: SparkSession, root: str, n_lists: int = 64):
        self.spark, self.log, self.n_lists = spark, CommitLog(spark, root), n_lists

    def centres(self, before: int | None = None) -> np.ndarray | None:
        """At most ``n_lists`` rows."""
        rows = self.log.read("centres", before=before)
        return None if rows is None else np.array([r["embedding"] for r in sorted(rows.collect(), key=lambda r: r["list"])])

    def add(self, vectors: DataFrame, cid: str, vec: str = "embedding") -> int:
        """Store more vectors; the first call also fits the centres.  Returns the run."""
        rows = vectors.select(F.col(cid).alias("cid"), F.col(vec).cast("array<double>").alias("embedding"))

        def build(run: int) -> dict:
            centres = self.centres(before=run)
            out = {}
            if centres is None:
                share = min(1.0, SAMPLE / max(rows.count(), 1))
                picked = rows.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(share * (1 << 30))).where("embedding is not null")
                sample = sorted((r["embedding"] for r in picked.select("embedding").collect()))
                centres = fit_centres(np.array(sample).reshape(len(sample), -1), self.n_lists)
                out["centres"] = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, embedding array<double>")
            return out | {"vectors": nearest_lists(rows, centres, "embedding")}

        return self.log.append(build, partitions={"vectors": ["list"]})

    def search(self, questions: DataFrame, qid: str, k: int, vec: str = "embedding", probes: int = 8) -> DataFrame:
        """(qid, cid, sim, rank): the best ``k`` in each question's ``probes`` nearest lists; only those lists are read."""
        asked = nearest_lists(questions.select(qid, F.col(vec).cast("array<double>").alias("embedding")), self.centres(), "embedding", probes)
        asked = asked.where("list >= 0")
        lists = [r[0] for r in asked.select("list").distinct().collect()]          # at most n_lists
        stored = self.log.read("vectors").where(F.col("list").isin(lists)).select("cid", "embedding", "list")
        return cosine_topk(asked, stored, k, qid, "cid", scope="list").drop("list")
