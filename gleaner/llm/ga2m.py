"""Operator 2: quality classifier, a generalised additive model with pairwise
interactions.

Training boosts one shallow tree per feature in turn (cyclic), each tree being
added to that feature's lookup table, so the model is a table per feature plus a
two-dimensional table per chosen pair.  A score is a sum of looked-up values
through the logistic function; scoring is vectorised bin additions.

Training reads at most ``TRAIN_ROWS`` labelled rows (the smallest by hash of the
id; a documented parameter), never ids, languages or sources as inputs; scoring
reads every row and whole text.

Defined cases: null and empty texts are scored by their (all-zero) features; very
long texts are read whole; repeated rows give repeated rows; an empty table gives
an empty result; with no labelled rows, or labels of one class, the score is the
smoothed share of label 1; rows with a null label are not learned from; extra columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import crc_mod, map_batches

TRAIN_ROWS = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, MIN_LEAF = 32, 120, 0.2, 3, 8, 6, 20
THRESHOLD = 0.7

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "pipe", "exclaim", "stop",
            "non_ascii", "line_length", "dup_lines", "same_as_before", "distinct", "longest_word", "space")

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&@^~_=+<>{}[]\\",
            "pipe": b"|", "exclaim": b"!", "stop": b".,;:?", "non_ascii": bytes(range(0x80, 0xC0)),
            "space": b" \t\r\n\x0b\x0c"}


def features(texts: list) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    table = np.zeros((256, len(_CLASSES)))
    for j, chars in enumerate(_CLASSES.values()):
        table[list(chars), j] = 1
    at = {n: i for i, n in enumerate(FEATURES)}
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "replace")
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ table
        words = text.split()
        n = max(len(words), 1)
        lines = [x for x in text.split("\n") if x]
        row = dict(zip(_CLASSES, counts))
        shares = {k: row[k] / (len(data) if k in ("upper", "digit", "non_ascii", "space") else n) for k in row}
        shares |= {"log_bytes": np.log1p(len(data)), "log_words": np.log1p(n), "word_length": (len(data) - row["space"]) / n,
                   "line_length": np.log1p(len(text) / max(len(lines), 1)),
                   "dup_lines": 1 - len(set(lines)) / max(len(lines), 1),
                   "same_as_before": sum(map(eq, words, words[1:])) / n,
                   "distinct": len(set(words)) / n ** 0.85, "longest_word": np.log1p(max(map(len, words), default=0))}
        for k, v in shares.items():
            out[i, at[k]] = v
    return out


def _leaf_values(grad: np.ndarray, hess: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A shallow tree over ordered bins: greedy splits, a value per bin."""
    g, h, n = np.cumsum(grad), np.cumsum(hess), np.cumsum(count)
    cuts = [0, len(grad)]

    def part(x, a, b):
        return x[b - 1] - (x[a - 1] if a else 0)

    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            lg, lh, ln = (x[a:b - 1] - (x[a - 1] if a else 0) for x in (g, h, n))
            tg, th, tn = part(g, a, b), part(h, a, b), part(n, a, b)
            gain = lg ** 2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg ** 2 / (th + 1)
            gain[(ln < MIN_LEAF) | (tn - ln < MIN_LEAF)] = 0
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), a + k + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = part(g, a, b) / (part(h, a, b) + 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables of the model (a dict of small arrays)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"bias": float(np.log(share / (1 - share))), "edges": [], "tables": [], "pairs": [], "coarse": [], "pair_tables": []}
    if len(set(y.tolist())) < 2:
        return model
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    model["edges"] = [np.unique(np.quantile(c, q)) for c in x.T]
    model["coarse"] = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    # a heavy point mass hides the rare side of a feature: add cuts on the other side of it
    for j, c in enumerate(x.T):
        other = c[c > np.median(c)]
        if len(other) > 2 * MIN_LEAF:
            extra = np.quantile(other, np.linspace(0, 1, 9)[:-1])
            model["edges"][j] = np.unique(np.append(model["edges"][j], extra))
            model["coarse"][j] = np.unique(np.append(model["coarse"][j], extra[[0, 4]]))
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model["edges"], x.T)]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model["coarse"], x.T)]
    tables = [np.zeros(len(e) + 1) for e in model["edges"]]
    f = np.full(len(y), model["bias"])
    for _ in range(ROUNDS):
        for b, t in zip(bins, tables):
            p = _sigmoid(f)
            size = len(t)
            step = RATE * _leaf_values(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), np.bincount(b, minlength=size))
            t += step
            f += step[b]
    p = _sigmoid(f)
    gains = []
    for i in range(len(bins)):
        for j in range(i):
            wide = len(model["coarse"][j]) + 1
            cell = coarse[i] * wide + coarse[j]
            g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            gains.append((float((g ** 2 / (h + 1)).sum()), i, j))
    model["pairs"] = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    grids = [np.zeros((len(model["coarse"][i]) + 1, len(model["coarse"][j]) + 1)) for i, j in model["pairs"]]
    for _ in range(ROUNDS // 4):
        for (i, j), t in zip(model["pairs"], grids):
            p = _sigmoid(f)
            cell = coarse[i] * t.shape[1] + coarse[j]
            g = np.bincount(cell, y - p, t.size).reshape(t.shape)
            h = np.bincount(cell, p * (1 - p), t.size).reshape(t.shape)
            n = np.bincount(cell, minlength=t.size).reshape(t.shape)
            # a two-level tree: the best row cut, then the best column cuts on either side
            rows = _leaf_values(g.sum(1), h.sum(1), n.sum(1))
            step = np.zeros_like(t)
            for v in np.unique(rows):
                side = rows == v
                step[side] = RATE * _leaf_values(g[side].sum(0), h[side].sum(0), n[side].sum(0))
            t += step
            f += step.ravel()[cell]
    model["tables"], model["pair_tables"] = tables, grids
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Bin additions, then the logistic function."""
    f = np.full(len(x), model["bias"])
    for e, t, c in zip(model["edges"], model["tables"], x.T):
        f += t[np.searchsorted(e, c, side="right")]
    for (i, j), t in zip(model["pairs"], model["pair_tables"]):
        f += t[np.searchsorted(model["coarse"][i], x[:, i], side="right"),
               np.searchsorted(model["coarse"][j], x[:, j], side="right")]
    return _sigmoid(f)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fit on about ``rows`` labelled rows (columns doc_id, quality), a share by hash of
    the id, or all if there are no more.  Only their feature rows (a few numbers
    each) reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, rows / max(known.count(), 1))
    ids = (known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
           .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")   # bounded by ``rows``
    got = map_batches(picked.select("text", "quality"),
                      lambda c: {"f": features(c["text"]).tolist(), "y": c["quality"]},
                      "f array<double>, y int").collect()
    # the order of rows from tasks is not fixed: sort, so that a fit is repeatable
    got = sorted((tuple(r["f"]), r["y"]) for r in got)
    x = np.array([g[0] for g in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([g[1] for g in got], float))


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and predicted of every row."""
    def fn(cols):
        s = score(model, features(cols["text"]))
        return {"doc_id": cols["doc_id"], "score": s, "predicted": (s >= THRESHOLD).astype(int)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn,
                       "doc_id long, score double, predicted int")


def train_on_folds(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = spark.read.parquet(table_path(sf_dir, "labels")).where(crc_mod("doc_id", 4) != 2)
    return train(docs, labels)


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return (quality(docs, train_on_folds(spark, docs, sf_dir))
            .select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text is predicted 1."""
    model = train_on_folds(spark, spark.read.parquet(table_path(sf_dir, "documents")), sf_dir)

    score_column = "score"
    while score_column in {c.lower() for c in docs.columns}:        # a name of its own
        score_column += "_"

    def fn(cols):
        return cols | {score_column: score(model, features(cols["text"]))}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (map_batches(docs, fn, f"{schema}, {score_column} double")
            .where(F.col(score_column) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns)))
