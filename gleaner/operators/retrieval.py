"""Chunking, embedding, exact top-k retrieval, tool catalogs, tree reduction,
idempotent vector index."""

from __future__ import annotations

import math
from typing import Optional, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import materialize, path_exists

# Chunk size and overlap in tokens, passages per vector query,
# tools per question.
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 200
VECTOR_TOP_K = 2
TOOL_TOP_K = 3
# Tool catalog names and descriptions per document.
TOOL_KINDS = [
    ("vector", "vector_tool_", "A tool to query the document "),
    ("summary", "summary_tool_", "A tool to summarize the document "),
]
HASH_DIMS = 64


# -- text -> tokens -> chunks ------------------------------------------------
def tokens(text: Column) -> Column:
    """White-space tokens (runs of space, tab, CR, LF separate).  Built-in
    array functions only (no lambda), so it stays in generated code."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), " "), "")


def sentence_chunks(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list:
    """Sentence-aware packing: whole sentences (ending in . ! or ?) are packed
    into chunks of at most ``size`` white-space tokens; the next chunk starts
    with the trailing sentences of the previous one that fit in ``overlap``
    tokens.  A sentence longer than ``size`` is cut into ``size``-token pieces."""
    import re

    if not isinstance(text, str) or not text.strip():
        return [""]
    units = []
    for sent in re.split(r"(?<=[.!?])\s+", text.strip()):
        toks = sent.split()
        units.extend(toks[i:i + size] for i in range(0, len(toks), size))
    chunks, cur, n_cur = [], [], 0
    for u in units:
        if cur and n_cur + len(u) > size:
            chunks.append(cur)
            keep, n_keep = [], 0
            for v in reversed(cur):
                if n_keep + len(v) > overlap:
                    break
                keep.insert(0, v)
                n_keep += len(v)
            cur, n_cur = (keep, n_keep) if n_keep + len(u) <= size else ([], 0)
        cur.append(u)
        n_cur += len(u)
    chunks.append(cur)
    return [" ".join(w for u in c for w in u) for c in chunks]


def chunk(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
          mode: str = "tokens") -> DataFrame:
    """One row per chunk: windows of ``size`` tokens advancing by
    ``size - overlap``; a short (or empty) text is one chunk.

    Adds ``chunk_pos``, ``n_chunks``, ``n_tokens``, ``chunk_text``; other
    columns are carried.  Pure column work + ``posexplode``: no shuffle.
    ``mode="sentence"`` packs whole sentences instead (``sentence_chunks``,
    a row-local pandas function; still no shuffle).
    """
    if mode == "sentence":
        @F.pandas_udf(T.ArrayType(T.StringType()))
        def _sent(s: pd.Series) -> pd.Series:
            return pd.Series([sentence_chunks(t, size, overlap) for t in s])

        d = df.withColumn("_c", _sent(F.col(text))).withColumn("n_chunks", F.size("_c"))
        d = d.select(*[c for c in df.columns if c != text], "n_chunks",
                     F.posexplode("_c").alias("chunk_pos", "chunk_text"))
        return d.withColumn("n_tokens", F.size(tokens(F.col("chunk_text"))))
    step = size - overlap
    t = tokens(F.col(text))
    n_chunks = F.greatest(F.lit(1), F.ceil((F.size("_t") - overlap) / F.lit(float(step))).cast("int"))
    d = df.withColumn("_t", t).withColumn("n_chunks", n_chunks)
    parts = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1),
                        lambda i: F.slice(F.col("_t"), i * step + 1, size))
    d = d.select(*[c for c in df.columns if c != text], "n_chunks", F.posexplode(parts).alias("chunk_pos", "_p"))
    return d.select("*", F.size("_p").alias("n_tokens"), F.array_join("_p", " ").alias("chunk_text")).drop("_p")


def distinct_chunks(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``chunk`` by tokens as chunk_pos, chunk_hash (SHA-256), chunk_text; of a row's equal
    chunks only the first.  Decided in the row: no shuffle."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("_t") - overlap) / F.lit(float(step))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(F.col("_t"), i * step + 1, size), " "))
    d = df.withColumn("_t", tokens(F.col(text))).withColumn("_c", parts)
    d = d.withColumn("_h", F.transform("_c", lambda c: F.sha2(c, 256)))
    d = d.withColumn("_z", F.transform("_c", lambda c, i: F.struct(
        i.alias("chunk_pos"), F.col("_h")[i].alias("chunk_hash"), c.alias("chunk_text"))))
    first = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.col("_z")).otherwise(
        F.filter("_z", lambda z: F.array_position("_h", z["chunk_hash"]) == z["chunk_pos"] + 1))
    return d.select(*[c for c in df.columns if c != text], F.inline(first))


# -- hashed term-frequency embedding -----------------------------------------
def token_bucket(w: Column, dims: int = HASH_DIMS) -> Column:
    """Bucket of a token: first 32 bits of its md5, modulo ``dims``."""
    return F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims))


def hash_buckets(df: DataFrame, key: Sequence[str], text: str, dims: int = HASH_DIMS) -> DataFrame:
    """(key, bucket, cnt): lower-cased token counts per hash bucket.

    ``explode`` + ``groupBy`` with partial aggregation: a huge document
    collapses to at most ``dims`` rows per task before the shuffle."""
    w = df.select(*key, F.explode(tokens(F.lower(F.col(text)))).alias("_w"))
    return w.groupBy(*key, token_bucket(F.col("_w"), dims).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def hash_embed(df: DataFrame, key: Sequence[str], text: str, dims: int = HASH_DIMS,
               out: str = "embedding") -> DataFrame:
    """(key, embedding): the default embedding, L2-normalised token counts per hash
    bucket, one row per key (all zero without tokens).

    Built-in functions only.  The counts are pre-aggregated by (key, bucket), so a
    huge text leaves a task as at most ``dims`` rows; a key's vector is made of
    at most ``dims`` counts."""
    w = df.select(*key, F.explode_outer(tokens(F.lower(F.col(text)))).alias("_w"))
    counts = w.groupBy(*key, token_bucket(F.col("_w"), dims).alias("_b")).agg(F.count("_w").cast("double").alias("_n"))
    sparse = counts.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_n")))).alias("_m"),
        F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda i: F.when(
        F.col("_norm") > 0, F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_norm")).otherwise(F.lit(0.0)))
    return sparse.select(*key, dense.alias(out))


def hash_vector(df: DataFrame, text: str, dims: int = HASH_DIMS, out: str = "embedding") -> DataFrame:
    """``df`` and its rows' default embedding: ``hash_embed`` where every row is a key.

    Built-in functions on the row alone: neither the text nor its counts are shuffled,
    and no join brings the vector back to the row."""
    buckets = F.transform(tokens(F.lower(F.col(text))), lambda w: token_bucket(w, dims).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (
        F.size("_buckets") - F.size(F.array_remove("_buckets", i))).cast("double"))
    norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda s, n: s + n * n))
    vector = F.transform("_counts", lambda n: F.when(F.col("_norm") > 0, n / F.col("_norm")).otherwise(F.lit(0.0)))
    rows = df.withColumn("_buckets", F.coalesce(buckets, F.array().cast("array<int>"))).withColumn("_counts", counts)
    return rows.withColumn("_norm", norm).withColumn(out, vector).drop("_buckets", "_counts", "_norm")


def model_embed(text: Column, fn, dims: int) -> Column:
    """Plug point for a real embedding model: ``fn(list[str]) -> np.ndarray``
    (n x dims), applied per Arrow batch."""

    @F.pandas_udf("array<double>")
    def _embed(s: pd.Series) -> pd.Series:
        mat = np.asarray(fn(s.fillna("").tolist()), dtype="float64").reshape(len(s), dims)
        return pd.Series(list(mat))

    return _embed(text)


# -- exact cosine top-k --------------------------------------------------------
def _block_topk(k: int, exclude_self: bool, scope_cols: Sequence[str], tie_digits: int):
    def fn(keys, qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "cid", "sim", *scope_cols]
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame(columns=cols)
        q = np.stack([np.asarray(v, dtype="float64") for v in qpdf["qvec"]])
        c = np.stack([np.asarray(v, dtype="float64") for v in cpdf["cvec"]])
        qn = np.linalg.norm(q, axis=1)
        cn = np.linalg.norm(c, axis=1)
        qids = qpdf["qid"].to_numpy()
        cids = cpdf["cid"].to_numpy()
        kk = min(k, len(cids))
        out_q, out_c, out_s = [], [], []
        for lo in range(0, len(q), 512):
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (q[lo:lo + 512] @ c.T) / np.outer(qn[lo:lo + 512], cn)
            s = np.where(np.isnan(s), -np.inf, s)
            if exclude_self:
                s = np.where(qids[lo:lo + 512, None] == cids[None, :], -np.inf, s)
            ranked = np.round(s, tie_digits)
            for r in range(s.shape[0]):
                row = ranked[r]
                if kk < len(row):
                    thr = np.partition(row, len(row) - kk)[len(row) - kk]
                    cand = np.nonzero(row >= thr)[0]
                else:
                    cand = np.arange(len(row))
                cand = cand[np.isfinite(row[cand])]
                order = np.lexsort((cids[cand], -row[cand]))[:kk]
                sel = cand[order]
                out_q.extend([qids[lo + r]] * len(sel))
                out_c.extend(cids[sel].tolist())
                out_s.extend(s[r][sel].tolist())
        res = pd.DataFrame({"qid": out_q, "cid": out_c, "sim": out_s})
        for i, sc in enumerate(scope_cols):
            res[sc] = keys[i]
        return res[cols]

    return fn


def with_blocks(q: DataFrame, c: DataFrame, scope: Optional[str], q_block: int,
                c_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_qb`` and ``_cb``, every row once per block of the other side.

    Without ``scope`` the numbers of blocks are two scalars; with it they come
    from a count per scope value, and rows whose scope the other side lacks go."""
    if scope is None:
        sizes = {"_B": max(1, math.ceil(q.count() / q_block)), "_C": max(1, math.ceil(c.count() / c_block))}
        q, c = (df.withColumns({n: F.lit(v).cast("long") for n, v in sizes.items()}) for df in (q, c))
    else:
        n_q, n_c = (df.groupBy(F.col(scope).alias(s)).agg(F.ceil(F.count(F.lit(1)) / n).alias(b))
                    for df, s, n, b in ((q, "_s", q_block, "_B"), (c, "_t", c_block, "_C")))
        sizes = n_q.join(n_c, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
        q, c = (df.join(sizes, F.col(scope).eqNullSafe(F.col("_s"))).drop("_s") for df in (q, c))

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    q = q.select("*", F.pmod(F.xxhash64("qid"), F.col("_B")).alias("_qb"), others("_C").alias("_cb"))
    c = c.select("*", F.pmod(F.xxhash64("cid"), F.col("_C")).alias("_cb"), others("_B").alias("_qb"))
    return q.drop("_B", "_C"), c.drop("_B", "_C")


def cosine_topk(queries: DataFrame, collection: DataFrame, k: int,
                qid: str, cid: str, qvec: str = "embedding", cvec: str = "embedding",
                scope: Optional[str] = None, exclude_self: bool = False,
                q_block: int = 2048, c_block: int = 8192, tie_digits: int = 9) -> DataFrame:
    """Exact top-k by cosine similarity for every query: (qid, cid, sim, rank).

    Blocked nested loop without pair rows: queries and collection are split into
    blocks of about ``q_block`` and ``c_block`` rows by id hash; each (query block,
    collection block[, scope]) group meets once in a ``cogroup`` and numpy keeps
    the best ``k`` per query of that block.  ``scope`` limits matches to rows with
    the same scope value (per-document search); the numbers of blocks are then
    those of the scope's own rows, so a question is copied only as often as its
    scope has blocks, and a hot scope is split.  At most ``k`` candidates per query
    and block are shuffled to the final ``row_number() <= k`` (a partial
    ``WindowGroupLimit``).  Similarities are compared at ``tie_digits`` decimals
    (float noise is not an order); ties go to the lower id.
    """
    sc = [scope] if scope else []
    # The inputs are read twice (sizes, then the blocks): write the projected
    # vectors once in the shared checkpoint folder so an upstream embedding
    # runs once.
    q = materialize(queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("qvec"), *sc))
    c = materialize(collection.select(F.col(cid).alias("cid"), F.col(cvec).alias("cvec"), *sc))
    q, c = with_blocks(q, c, scope, q_block, c_block)
    keys = [*sc, "_qb", "_cb"]
    qt = dict(queries.select(F.col(qid)).dtypes)[qid]
    ct = dict(collection.select(F.col(cid)).dtypes)[cid]
    scope_schema = "".join(f", `{s}` {dict(queries.dtypes)[s]}" for s in sc)
    schema = f"qid {qt}, cid {ct}, sim double{scope_schema}"
    part = (q.groupBy(*keys).cogroup(c.groupBy(*keys))
             .applyInPandas(_block_topk(k, exclude_self, sc, tie_digits), schema))
    w = Window.partitionBy("qid").orderBy(F.round("sim", tie_digits).desc(), F.col("cid"))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_labelled(queries: DataFrame, collection: DataFrame, k: int, qid: str, cid: str,
                  labels: str, label: str, qvec: str = "embedding", cvec: str = "embedding") -> DataFrame:
    """Top-k per query among the rows whose ``label`` is any of the query's ``labels``
    (an array); an empty or null array searches everything.

    Queries with labels meet only the rows of their labels (one scoped search, a query
    a label), the others the whole collection; at most ``k`` rows per query
    and label are ranked again."""
    some = F.size(F.coalesce(F.col(labels), F.array().cast("array<string>"))) > 0
    scoped = (queries.where(some).select(qid, F.col(qvec).alias("qvec"), F.explode(F.array_distinct(labels)).alias("_label"))
              .where(F.col("_label").isNotNull()))
    rows = collection.select(cid, F.col(cvec).alias("cvec"), F.col(label).cast("string").alias("_label"))
    found = cosine_topk(scoped, rows, k, qid, cid, "qvec", "cvec", scope="_label").drop("_label")
    every = cosine_topk(queries.where(~some), collection, k, qid, cid, qvec, cvec)
    both = found.select("qid", "cid", "sim").unionByName(every.select("qid", "cid", "sim"))
    w = Window.partitionBy("qid").orderBy(F.round("sim", 9).desc(), F.col("cid"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per key (dimension-wise, partially pre-aggregated)."""
    e = df.select(key, F.posexplode(vec).alias("_d", "_x"))
    a = e.groupBy(key, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    g = a.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_s"))
    return g.select(key, F.transform("_s", lambda s: s["_m"]).alias(vec))


def two_level_topk(queries: DataFrame, collection: DataFrame, qid: str, cid: str, group: str,
                   k_groups: int = TOOL_TOP_K, k: int = VECTOR_TOP_K,
                   vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """Top ``k_groups`` groups per query by centroid similarity, then the top
    ``k`` vectors inside those groups (documents first, then passages)."""
    cent = centroids(collection, group, vec)
    g = cosine_topk(queries, cent, k_groups, qid, group, vec, vec)
    pick = g.select(F.col("qid").alias(qid), F.col("cid").alias(group))
    q2 = queries.select(qid, vec).join(pick, qid)
    within = cosine_topk(q2, collection.select(cid, vec, group), k, qid, cid, vec, vec,
                         scope=group, exclude_self=exclude_self)
    w = Window.partitionBy("qid").orderBy(F.round("sim", 9).desc(), F.col("cid"))
    return (within.drop("rank").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


# -- tool catalog ------------------------------------------------------------
def tool_catalog(docs: DataFrame, doc: str, name: str) -> DataFrame:
    """Two tools per document (vector query, summary), in document order."""
    tools = F.array(*[F.struct(F.lit(i).alias("tool_pos"), F.lit(kind).alias("kind"),
                               F.concat(F.lit(prefix), F.col(name)).alias("tool_name"),
                               F.concat(F.lit(desc), F.col(name)).alias("description"))
                      for i, (kind, prefix, desc) in enumerate(TOOL_KINDS)])
    return docs.select(doc, F.inline(tools))


# -- tree reduction --------------------------------------------------------------
def join_combine(text: str = "text", order: str = "pos") -> Column:
    """Default combine of a group of nodes: their whole texts, in order, joined by
    a space.  Nothing is lost; a summariser is passed as ``combine``."""
    return F.expr(f"listagg(`{text}`, ' ') within group (order by `{order}`)")


def tree_reduce(nodes: DataFrame, doc: str, fanout: int = 4, combine: Optional[Column] = None,
                n_levels: Optional[int] = None, checkpoint_every: int = 4) -> DataFrame:
    """Combine the nodes of each document level by level until one is left.

    ``nodes``: (doc, pos, text, n) with ``n`` the node count of the doc.  Each
    level groups ``floor(pos / fanout)`` -- at most ``fanout`` rows per group,
    so a long document spreads over many groups.  Level 1 applies to every
    document; later levels only to documents with more than one node.  The
    number of levels comes from the largest document (one scalar).
    """
    combine = combine if combine is not None else join_combine()
    if n_levels is None:
        # one scalar decides the depth; the nodes are materialized so the
        # levels do not recompute them
        nodes = materialize(nodes)
        mx = nodes.agg(F.max("n")).first()[0] or 1
        n_levels = max(1, math.ceil(math.log(mx, fanout))) if mx > 1 else 1
    cur = nodes.select(doc, "pos", "text", "n", F.lit(0).alias("level"))
    for lvl in range(1, n_levels + 1):
        if lvl > 1 and (lvl - 1) % checkpoint_every == 0:
            # deep trees: cut the lineage into the shared checkpoint folder
            cur = cur.checkpoint(eager=True)
        todo = cur if lvl == 1 else cur.where(F.col("n") > 1)
        done = None if lvl == 1 else cur.where(F.col("n") <= 1)
        red = (todo.groupBy(doc, F.floor(F.col("pos") / fanout).alias("_g"))
                   .agg(combine.alias("text"), F.first("n").alias("_n"))
                   .select(doc, F.col("_g").cast("long").alias("pos"), "text",
                           F.ceil(F.col("_n") / F.lit(float(fanout))).cast("long").alias("n"),
                           F.lit(lvl).alias("level")))
        cur = red if done is None else red.unionByName(done)
    return cur.select(doc, F.col("text").alias("summary"), F.col("level").alias("n_levels"))


# -- idempotent vector index -----------------------------------------------------
class VectorIndex:
    """A parquet table of chunks keyed by (doc, chunk_hash); inserting the same
    chunk again is a no-op (anti-join before writing), so rebuilding the
    index at every start adds nothing twice."""

    def __init__(self, spark: SparkSession, path: str, doc: str = "doc_id"):
        self.spark, self.path, self.doc = spark, path.rstrip("/"), doc

    def _exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def insert(self, chunks: DataFrame) -> None:
        from gleaner.operators.ingest import anti_known, dedup_first

        keyed = chunks.withColumn("_key", F.struct(self.doc, "chunk_hash"))
        new = dedup_first(keyed, ["chunk_pos"], key="_key")
        if self._exists():
            have = self.read().select(F.struct(self.doc, "chunk_hash").alias("_key"))
            new = anti_known(new, have, key="_key")
        new.drop("_key").write.mode("append").parquet(self.path)


# -- named, described tools ---------------------------------------------------------
def register_tool(spark: SparkSession, name: str, description: str, fn,
                  return_type: str = "string") -> DataFrame:
    """Register a vectorised Python function under ``name`` (callable from SQL
    and ``F.expr``) and return its catalog row (tool_name, description)."""
    udf = F.pandas_udf(fn, return_type)
    spark.udf.register(name, udf)
    return spark.createDataFrame([(name, description)], "tool_name string, description string")
