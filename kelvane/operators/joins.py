"""Joins that Spark would plan with a broadcast of unbounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left for which `key NOT IN (SELECT other FROM right)` is true, by a shuffled anti join and one row of facts.

    An empty right keeps all rows; a null in right keeps none; else rows with a null key go.
    """
    r = right.select(F.col(other).alias("_in"))
    facts = r.agg(F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_known"))
    kept = left.crossJoin(facts).where(F.expr("_n = 0") | (F.expr("_n = _known") & F.col(key).isNotNull()))
    return kept.join(r.where("_in is not null"), F.col(key) == F.col("_in"), "left_anti").drop("_n", "_known")
