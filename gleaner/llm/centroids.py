"""Operator 13: centroid clustering by scalar lookup tables.

Vectors become integers, floor(``SCALE`` * component).  In every round each batch
of vectors tabulates, for every dimension, every integer value that occurs in it
and every centroid, the squared difference; a vector's distances are gathers from
those tables and their sum.  A task adds up its vectors by cluster and reports one
row per cluster and dimension, so a round sends at most clusters x dimensions rows
of every task to a shuffled sum, and the driver gets clusters x dimensions numbers.

All arithmetic is exact: 64-bit integers where components are below ``SAFE``, else
Python's; sums travel as limbs of ``LIMB`` bits.

Defined cases: a vector that is null, has not ``DIMENSIONS`` components or has a
null or non-finite one is left out; a null id counts as the empty text in the order
of the first centroids; rows with the same id are vectors of their own (of equal
hashes the smaller vector comes first); fewer vectors than clusters give as many
centroids as there are vectors; an empty table gives an empty result; a distance
or inertia beyond 64 bits is null, its assignment is still exact; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import store

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1:"
SAFE, LIMB, MOST = 1 << 27, 40, (1 << 63) - 1
#: First centroids are looked for among about this many vectors of smallest hash.
SHORTLIST, BATCH_ROWS = 4096, 8192


# --- one batch ----------------------------------------------------------------------

def integers(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(ids, integer vectors) of the rows that are kept."""
    ids, vectors = batch.column(0), batch.column(1)
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), DIMENSIONS), False)
    ids, vectors = ids.filter(right), vectors.filter(right)
    flat = vectors.flatten().cast(pa.float64())
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
    keep = np.isfinite(x).all(1)
    x = x[keep]
    with np.errstate(over="ignore"):
        v = np.floor(x * SCALE)
    if not len(v) or np.abs(v).max() < SAFE:
        v = v.astype(np.int64)
    else:                                               # floor(SCALE * x) of any double, as a whole number
        v = np.array([[int(a) * SCALE + int(np.floor((a - int(a)) * SCALE)) for a in row] for row in x.tolist()], object)
    return ids.filter(pa.array(keep)), v.reshape(-1, DIMENSIONS)


def distances(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of every vector to every centroid, from tables."""
    large = v.dtype == object or max(abs(c) for row in centroids for c in row) >= SAFE
    c = np.array(centroids, object if large else np.int64)
    out = np.zeros((len(v), len(c)), c.dtype)
    for d in range(v.shape[1]):
        if v.dtype != object and len(v) and int(v[:, d].max()) - int(v[:, d].min()) < 4 * len(v):
            low = int(v[:, d].min())                    # few values: found by counting
            there = np.bincount(v[:, d] - low) > 0
            seen = np.flatnonzero(there) + low
            at = (np.cumsum(there) - 1)[v[:, d] - low]
        else:
            seen, at = np.unique(v[:, d], return_inverse=True)
        table = (seen.astype(c.dtype)[:, None] - c[:, d]) ** 2
        out += table[at]
    return out


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of every vector; of equal distances the smaller cluster."""
    dist = distances(v, centroids)
    at = dist.argmin(1) if dist.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in dist], np.int64)
    return at, dist[np.arange(len(v)), at]


def limbs(x: int):
    """(position, limb) of a whole number in base 2^``LIMB``; the last limb has the sign."""
    k = 0
    while not -(1 << LIMB) <= x < 1 << LIMB:
        yield k, x & ((1 << LIMB) - 1)
        x, k = x >> LIMB, k + 1
    yield k, x


# --- jobs -----------------------------------------------------------------------------

def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield integers(batch.slice(at, BATCH_ROWS))


def kept(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that are clustered."""
    real = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("embedding").isNotNull() & (F.size("embedding") == DIMENSIONS) & ~real)


def first_centroids(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; a count of the vectors gives
    a bound of the hashes that leaves a short list."""
    n = vectors.count()
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256))
    share = SHORTLIST / max(n, 1)
    while True:
        # the first 12 hex digits as a number are even over [0, 2^48)
        bound = f"{min(int(share * (1 << 48)), (1 << 48) - 1):012x}"
        near = named if share >= 1 else named.where(F.col("h") <= bound)
        rows = near.groupBy("h", "embedding").count().orderBy("h", "embedding").limit(clusters).collect()
        if share >= 1 or sum(r["count"] for r in rows) >= clusters:
            break
        share *= 8
    out = [r["embedding"] for r in rows for _ in range(min(r["count"], clusters))][:clusters]
    if not out:
        return []
    return [[int(x) for x in row] for row in integers(pa.RecordBatch.from_arrays(
        [pa.array(range(len(out))), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "embedding"]))[1]]


def update(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: assign, then floor(sum / count) of every non-empty cluster."""
    schema = pa.schema([("cluster", pa.int32()), ("dimension", pa.int32()), ("limb", pa.int32()), ("part", pa.int64()), ("n", pa.int64())])

    def run(batches):
        sums = [[0] * DIMENSIONS for _ in centroids]
        counts = [0] * len(centroids)
        for _, v in _rows(batches):
            at, _ = nearest(v, centroids)
            for c in np.unique(at).tolist():
                mine = v[at == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(0))]
        out = [(c, d, k, part, counts[c] if k == 0 else 0) for c, row in enumerate(sums) if counts[c]
               for d, s in enumerate(row) for k, part in limbs(s)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    parts = (vectors.mapInArrow(run, "cluster int, dimension int, limb int, part long, n long")
             .groupBy("cluster", "dimension", "limb").agg(F.sum("part").alias("part"), F.sum("n").alias("n")).collect())
    total, count = {}, {}
    for r in parts:
        key = r["cluster"], r["dimension"]
        total[key] = total.get(key, 0) + (r["part"] << (LIMB * r["limb"]))
        count[key] = count.get(key, 0) + r["n"]
    return [[total[c, d] // count[c, d] if (c, d) in total else x for d, x in enumerate(row)] for c, row in enumerate(centroids)]


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance (null beyond 64 bits) of every vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for ids, v in _rows(batches):
            at, dist = nearest(v, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(
                [x if x <= MOST else None for x in dist.tolist()] if dist.dtype == object else dist, pa.int64())], schema=schema)

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    vectors = kept(table)
    centroids = first_centroids(vectors, clusters)
    if not centroids:
        none = vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = update(vectors, centroids)
    done = store(assign(vectors, centroids), "clusters")
    # a row per cluster; a sum that lacks a distance is unknown
    wide = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(wide.alias("s")).collect()}
    known = [None if s is None or s > MOST else int(s) for s in (sums.get(c, 0) for c in range(len(centroids)))]
    whole = None if None in known or sum(known) > MOST else sum(known)

    def column(values, kind):
        """A constant per cluster."""
        return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)

    return done.select("vec_id", "cluster", "distance", column(known, "long").alias("cluster_inertia"),
                       F.lit(whole).cast("long").alias("inertia"), column([digest(c) for c in centroids], "string").alias("centroid_sha256"))


def op13_centroid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(table_path(sf_dir, "embeddings")))


def _sql() -> str:
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT r, vec_id, d, CAST(floor({SCALE}::DOUBLE * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIMENSIONS + 1}) t(d)),
first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS c
  FROM kept QUALIFY c < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT c, d, x FROM first JOIN v USING (r))"""]
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, min(dist * {CLUSTERS} + c) AS m FROM (
    SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN c{k} c USING (d) GROUP BY ALL) GROUP BY r)""")
        if k < ROUNDS:
            parts.append(f"""s{k} AS (SELECT m % {CLUSTERS} AS c, d, sum(x) AS s, count(*) AS n FROM a{k} JOIN v USING (r) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (
  SELECT c, d, CASE WHEN s.n IS NULL THEN p.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{k} p LEFT JOIN s{k} s USING (c, d))""")
    return "WITH " + ",\n".join(parts) + f""",
sha AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(m % {CLUSTERS} AS INTEGER) AS "cluster", CAST(m // {CLUSTERS} AS BIGINT) AS distance,
       CAST(sum(m // {CLUSTERS}) OVER (PARTITION BY m % {CLUSTERS}) AS BIGINT) AS cluster_inertia,
       CAST(sum(m // {CLUSTERS}) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN sha ON c = m % {CLUSTERS}"""


SQL = _sql()
