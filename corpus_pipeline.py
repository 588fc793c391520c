"""A corpus pipeline: five stages over ``documents``, each working on all that its
predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and rereads it as the next stage's ``docs``.  All but
the last return the columns of ``documents``.

1. quality: documents that the additive model scores under 0.7 go.
2. exact: of equal texts (white space normalised) the smallest doc_id stays.
3. near: of every component of near duplicates the smallest doc_id stays.
4. repeats: every byte in a 200-byte string that starts elsewhere too is cut out of
   the texts; rows stay, with what is left of their text.
5. packing: token pieces of what is left, with their sequences and places.

An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import exact, ga2m, minmax, packing, suffix
from gleaner.llm.util import store
from gleaner.session import table_path

STAGES = [
    ("quality", ga2m.keep_quality),
    ("exact", exact.keep_exact),
    ("near", minmax.keep_near),
    ("repeats", suffix.cut_stage),
    ("packing", packing.pack_stage),
]

#: The quality model and the packing can't be written in SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
