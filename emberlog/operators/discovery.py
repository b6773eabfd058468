"""Names and values of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.plans import levels
from emberlog.plans.compiler import PROMOTED


def label_names(streams: DataFrame) -> DataFrame:
    """(name) of all extra labels and the four that always exist, in order."""
    spark = streams.sparkSession
    own = spark.createDataFrame([(n,) for n in (*PROMOTED, "level")], "name string")
    return streams.select(F.explode(F.map_keys("labels")).alias("name")).union(own).distinct().orderBy("name")


def label_values(streams: DataFrame, name: str) -> DataFrame:
    """(value) in order; of level all names by severity."""
    if name == "level":
        rows = streams.sparkSession.createDataFrame([(k, n) for k, n in enumerate(levels.NAMES)], "k int, value string")
        return rows.orderBy("k").select("value")
    if name in PROMOTED:
        values = streams.select(F.col(name).alias("value"))
    else:
        values = streams.where(F.map_contains_key("labels", F.lit(name))).select(F.element_at("labels", F.lit(name)).alias("value"))
    return values.distinct().orderBy("value")
