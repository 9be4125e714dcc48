"""Large objects as chunk rows, and pages of results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 7 * 1024


def put_object(spark: SparkSession, folder: str, number: int, data: bytes) -> None:
    """Store bytes as chunk rows (id, chunk, data)."""
    rows = [(number, k, data[at : at + CHUNK]) for k, at in enumerate(range(0, len(data), CHUNK))] or [(number, 0, b"")]
    spark.createDataFrame(rows, "id bigint, chunk int, data binary").write.mode("overwrite").parquet(f"{folder}/id={number}")


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """All objects whole: id and data."""
    rows = spark.read.schema("id bigint, chunk int, data binary").parquet(f"{folder}/*")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    return rows.groupBy("id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))


def delete_object(spark: SparkSession, folder: str, number: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/id={number}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pages(df: DataFrame, size: int) -> Iterator[list]:
    """A result in pages, forward only; one partition at a time comes to the driver."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
