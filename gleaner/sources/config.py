"""Configuration as data: site lists and dotted-path lookups in JSON columns."""

from __future__ import annotations

from typing import Any, Union

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _col(c: Union[str, Column]) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_path(key: str) -> str:
    """Dotted key ``a.b.c`` -> JSON path ``$.a.b.c`` (keys quoted)."""
    parts = key.split(".")
    return "$" + "".join(f"['{p}']" for p in parts)


def json_path_get(json_text: Union[str, Column], key: str, default: Any = None,
                  as_type: str = "string") -> Column:
    """Value at a dotted key of a JSON text column.

    A missing key (or a path through a non-object) gives ``default``; a key
    present with JSON ``null`` gives SQL null, not the default.
    """
    v = F.try_variant_get(F.try_parse_json(_col(json_text)), json_path(key), "variant")
    present = F.when(F.is_variant_null(v), F.lit(None).cast(as_type)) \
               .otherwise(F.try_variant_get(v, "$", as_type))
    return F.when(v.isNull(), F.lit(default).cast(as_type)).otherwise(present)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON config file as one row with a single text column ``json``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def site_list(config: DataFrame) -> DataFrame:
    """``search.web.sites`` -> rows ``(site_pos, site_url)`` in list order.

    Raises ``ValueError`` when the list is missing or empty (checked with a
    one-row ``isEmpty`` action, not a collect).
    """
    arr = F.from_json(json_path_get("json", "search.web.sites", as_type="string"), "array<string>")
    sites = config.select(F.posexplode(arr).alias("site_pos", "site_url"))
    if sites.isEmpty():
        raise ValueError("No websites found in config.")
    return sites


AGENT_SCHEMA = ("array<struct<name:string, description:string, model:string, timeout:int, "
                "verbose:boolean, manager:boolean, can_handoff_to:array<string>>>")


def agent_table(config: DataFrame) -> DataFrame:
    """``agents`` of the config as rows in list order: (agent_pos, name,
    description, model, timeout, verbose, manager, can_handoff_to).  Objects
    have ragged keys; a missing key is null."""
    arr = F.from_json(F.get_json_object(F.col("json"), "$.agents"), AGENT_SCHEMA)
    return config.select(F.posexplode(arr).alias("agent_pos", "a")).select("agent_pos", "a.*")


def manager_agent(agents: DataFrame) -> DataFrame:
    """The first agent flagged as manager (a missing flag is false); raises
    ``ValueError`` when there is none (checked with a one-row action)."""
    flagged = agents.where(F.coalesce(F.col("manager"), F.lit(False)))
    first = flagged.orderBy("agent_pos").limit(1)
    if first.isEmpty():
        raise ValueError("No manager agent in config.")
    return first


def handoff_edges(agents: DataFrame) -> DataFrame:
    """The handoff graph as edges (from_agent, to_agent)."""
    return agents.select(F.col("name").alias("from_agent"),
                         F.explode_outer("can_handoff_to").alias("to_agent")).where(F.col("to_agent").isNotNull())
