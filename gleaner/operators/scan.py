"""Ordered scans within a key that stay parallel when one key is huge.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; a
session holding a third of all events would then be sorted by one core.
These scans split each key into ordered buckets (a coarse function of the
order column, e.g. the hour of the timestamp) and work in two levels:

1. a window per ``(key, bucket)`` computes the answer inside the bucket;
2. a small per-bucket summary (one row per key and bucket, built with a
   partially pre-aggregated ``groupBy``) carries what crosses bucket edges,
   and is scanned per key (rows = buckets, not events);
3. the summary joins back on ``(key, bucket)``; the rows are already
   partitioned that way after step 1, so only the summary moves.

The bucket must be monotone in the order: every row of bucket b orders before
every row of bucket b + 1.  A coarse bucket (the hour of a timestamp) costs
nothing; when a single bucket of a key may itself be huge, ``with_range_bucket``
derives buckets from a range partitioning on (key, order) whose sampled bounds
cap every (key, bucket) at about rows / partitions.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_U = Window.unboundedPreceding


def _ord(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def with_range_bucket(df: DataFrame, key: Sequence[str], order: Sequence[str],
                      n: int = None, out: str = "_rb") -> DataFrame:
    """Add ``out``: the partition id after ``repartitionByRange(n, key, order)``.

    Range bounds come from a sample, so each partition holds a contiguous,
    bounded slice of the (key, order) sequence, also inside one hot key; the id
    is monotone in the order within a key, as the scans require."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *key, *order).withColumn(out, F.spark_partition_id())


_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _by_bucket(df: DataFrame, key: Sequence[str], bucket: Column) -> DataFrame:
    """Rows hash-partitioned by (key, bucket) once: the windows and the bucket
    summary both consume this one shuffle (Spark reuses the exchange)."""
    return df.withColumn("_b", bucket).repartition(*key, "_b")


def _join_summary(d: DataFrame, per: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join of the rows with their bucket summary on (key, bucket),
    null-safe: no not-null filter is inferred into one branch only, so both
    branches keep the same shuffle (and a null key is one group, as in the
    windows)."""
    cols = [*key, "_b"]
    per = per.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(cols)],
                     *[c for c in per.columns if c not in cols])
    cond = None
    for i, c in enumerate(cols):
        e = d[c].eqNullSafe(per[f"_j{i}"])
        cond = e if cond is None else cond & e
    return d.join(per, cond, "left").drop(*[f"_j{i}" for i in range(len(cols))])


def _bucket_summary(d: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per (key, bucket) taken from the windowed rows (first row of each
    bucket), so the summary shares the shuffle under the window instead of
    reading the input again."""
    return d.where(F.col("_first")).select(*key, "_b", *cols)


def previous_value(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str,
                   bucket: Column, out: str = "prev") -> DataFrame:
    """Add ``out`` = ``value`` of the immediately preceding row of the same key
    (null for the first row)."""
    key = list(key)
    wl = Window.partitionBy(*key, "_b").orderBy(*order)
    d = (_by_bucket(df, key, bucket)
           .withColumn("_lp", F.lag(F.struct(F.col(value).alias("v"))).over(wl))
           .withColumn("_last", F.last(F.col(value)).over(wl.rowsBetween(*_ALL)))
           .withColumn("_first", F.row_number().over(wl) == 1))
    per = _bucket_summary(d, key, ["_last"])
    wb = Window.partitionBy(*key).orderBy("_b")
    per = per.select(*key, "_b", F.lag("_last").over(wb).alias("_pb"))
    d = _join_summary(d, per, key)
    return d.withColumn(out, F.when(F.col("_lp").isNotNull(), F.col("_lp.v")).otherwise(F.col("_pb"))) \
            .drop("_b", "_lp", "_pb", "_last", "_first")


def count_before(df: DataFrame, key: Sequence[str], order: Sequence[str], flag: Column,
                 bucket: Column, out: str = "n_before") -> DataFrame:
    """Add ``out`` = number of earlier rows of the same key where ``flag`` holds."""
    key = list(key)
    wl = Window.partitionBy(*key, "_b").orderBy(*order)
    d = (_by_bucket(df, key, bucket).withColumn("_f", F.coalesce(flag, F.lit(False)).cast("long"))
           .withColumn("_local", F.coalesce(F.sum("_f").over(wl.rowsBetween(_U, -1)), F.lit(0)))
           .withColumn("_n", F.sum("_f").over(wl.rowsBetween(*_ALL)))
           .withColumn("_first", F.row_number().over(wl) == 1))
    per = _bucket_summary(d, key, ["_n"])
    wb = Window.partitionBy(*key).orderBy("_b").rowsBetween(_U, -1)
    per = per.select(*key, "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_pre"))
    d = _join_summary(d, per, key)
    return d.withColumn(out, (F.col("_pre") + F.col("_local")).cast("long")) \
            .drop("_b", "_f", "_local", "_pre", "_n", "_first")


def next_matching(df: DataFrame, key: Sequence[str], order: Sequence[str], cond: Column,
                  value: str, bucket: Column, out: str = "next") -> DataFrame:
    """Add ``out`` = ``value`` of the first later row of the same key where
    ``cond`` holds (null when there is none).  ``value`` must increase with
    the order (e.g. the position itself)."""
    key = list(key)
    wl = Window.partitionBy(*key, "_b").orderBy(*order)
    # later rows as a running frame in descending order (a "1 following ..
    # unbounded following" frame would be recomputed for every row)
    wd = Window.partitionBy(*key, "_b").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(_U, -1)
    d = (_by_bucket(df, key, bucket).withColumn("_m", F.when(cond, F.col(value)))
           .withColumn("_local", F.min("_m").over(wd))
           .withColumn("_bmin", F.min("_m").over(wl.rowsBetween(*_ALL)))
           .withColumn("_first", F.row_number().over(wl) == 1))
    per = _bucket_summary(d, key, ["_bmin"])
    wb = Window.partitionBy(*key).orderBy(F.col("_b").desc()).rowsBetween(_U, -1)
    per = per.select(*key, "_b", F.min("_bmin").over(wb).alias("_later"))
    d = _join_summary(d, per, key)
    return d.withColumn(out, F.coalesce("_local", "_later")) \
            .drop("_b", "_m", "_local", "_later", "_bmin", "_first")


def ordered_concat(df: DataFrame, key: Sequence[str], order: Sequence[str], text: str,
                   bucket: Column, sep: str = "", out: str = "body") -> DataFrame:
    """Concatenate ``text`` per key in ``order`` (``sep`` between values), in
    two levels: pieces per (key, bucket) are built in parallel, then the
    pieces of a key are joined in bucket order.  Also returns ``n`` (rows)."""
    key = list(key)
    order_sql = ", ".join(f"`{c}`" for c in order)
    sep_sql = sep.replace("'", "''")
    pieces = (df.withColumn("_b", bucket).groupBy(*key, "_b")
                .agg(F.count(F.lit(1)).alias("_n"),
                     F.expr(f"listagg(`{text}`, '{sep_sql}') within group (order by {order_sql})").alias("_p")))
    return pieces.groupBy(*key).agg(
        F.sum("_n").alias("n"),
        F.expr(f"listagg(_p, '{sep_sql}') within group (order by _b)").alias(out))
