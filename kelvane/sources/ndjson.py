"""Line-delimited JSON: all or nothing."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BadLoad(ValueError):
    """A file that can't be loaded whole."""


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a file of JSON objects. Without a schema the first row's keys are the columns; missing keys are null, unknown keys and broken lines fail the whole load."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.first()
    if first is None:
        raise BadLoad("no rows")
    keys = list(json.loads(first["value"]))
    if bad := [k for k in keys if not re.fullmatch(r"[A-Za-z_]\w*", k)]:
        raise BadLoad(f"not a column name: {bad[0]!r}")
    if schema is None:
        kinds = spark.createDataFrame([], _schema(json.loads(first["value"]))).schema
    else:
        kinds = spark.createDataFrame([], schema).schema
    present = F.json_object_keys("value")
    bad = lines.where(present.isNull() | (F.size(F.array_except(present, F.array(*[F.lit(f.name) for f in kinds]))) > 0))
    row = bad.first()
    if row is not None:
        raise BadLoad(f"broken row: {row['value'][:80]}")
    return lines.select(F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _schema(row: dict) -> str:
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}

    def of(v):
        if isinstance(v, list) and v and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            return "array<float>"
        return kind.get(type(v), "string")

    return ", ".join(f"`{k}` {of(v)}" for k, v in row.items())
