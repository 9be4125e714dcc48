"""A vector index: cells around centroids (inverted file, flat). A search reads few cells and can be made exact.

Centroids come from k-means on a sample of at most SAMPLE vectors; every vector is then put into the cell of
its nearest centroid, and cells are folders, so a search prunes the others by their partition value. Of each cell its radius is
kept: a vector of a cell is at least as far from a query as the centroid is, less the radius. With exact=True
the cells that could hold something nearer than what the first ones gave are read too.

Defined results: null vectors are in no cell and never found; an empty table has an empty index; vectors
whose length differs from the first one's are an error; ties go by the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import near

SAMPLE, ROUNDS, SEED = 65_536, 12, 11


def _nearest(x, centroids):
    """Number and distance of the nearest centroid for each row of x."""
    import numpy as np

    d = np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T, 0)
    at = d.argmin(axis=1)
    return at, np.linalg.norm(x - centroids[at], axis=1)  # without the cancellation of the expanded form


def centroids_of(df: DataFrame, column: str, lists: int, sample: int = SAMPLE):
    """k-means centroids of a sample: the vectors with the least hashes."""
    import numpy as np

    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(sample)
    x = np.array([r["v"] for r in some.collect()], float)  # at most `sample` vectors
    if not len(x):
        return np.empty((0, 0))
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at, _ = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class VectorIndex:
    """An index under a folder: rows of the indexed table by cell, and the cells' centroids, radii and sizes."""

    def __init__(self, spark: SparkSession, folder: str, column: str, tie: str):
        self.spark, self.folder, self.column, self.tie = spark, folder.rstrip("/"), column, tie

    @classmethod
    def build(cls, df: DataFrame, folder: str, column: str, tie: str, lists: int = 64, sample: int = SAMPLE) -> VectorIndex:
        """Index every row of df that has a vector."""
        spark = df.sparkSession
        index = cls(spark, folder, column, tie)
        centroids = centroids_of(df, column, lists, sample)
        sent = spark.sparkContext.broadcast(centroids)  # `lists` vectors
        kind = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])

        def run(batches):
            import numpy as np
            import pyarrow as pa

            c = sent.value
            for b in batches:
                if b.num_rows:
                    at, far = _nearest(np.array(b.column(b.schema.get_field_index(column)).to_pylist(), float), c)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(far)], names=[*b.schema.names, "_cell", "_far"])

        rows = df.where(F.col(column).isNotNull()).mapInArrow(run, kind)
        rows.write.mode("overwrite").partitionBy("_cell").parquet(f"{index.folder}/cells")
        made = [(k, [float(x) for x in v]) for k, v in enumerate(centroids)]
        cells = spark.createDataFrame(made, "_cell int, centroid array<double>")
        far = index._rows(df.schema).groupBy("_cell").agg(F.max("_far").alias("radius"), F.count(F.lit(1)).alias("n")) if made else spark.createDataFrame([], "_cell int, radius double, n bigint")
        cells.join(far, "_cell").write.mode("overwrite").parquet(f"{index.folder}/centroids")
        index._schema = df.schema
        return index

    def _rows(self, schema: T.StructType) -> DataFrame:
        kind = T.StructType([*schema.fields, T.StructField("_far", T.DoubleType()), T.StructField("_cell", T.IntegerType())])
        return self.spark.read.schema(kind).parquet(f"{self.folder}/cells")

    def search(self, query: list[float], k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """The k nearest rows (Euclidean) with vec_distance, nearest first, from the `probes` nearest cells, or exactly."""
        import numpy as np

        cells = self.spark.read.parquet(f"{self.folder}/centroids").collect()  # a row a cell
        rows = self._rows(self._schema)
        if not cells:
            return near(rows.drop("_far", "_cell"), self.column, query, k, tie=self.tie)
        q = np.asarray(query, float)
        by = sorted((float(np.linalg.norm(q - np.array(c["centroid"]))), c["_cell"], c["radius"]) for c in cells)
        chosen = [cell for _, cell, _ in by[:probes]]
        found = near(rows.where(F.col("_cell").isin(chosen)).drop("_far", "_cell"), self.column, query, k, tie=self.tie)
        if not exact:
            return found
        first = [r["vec_distance"] for r in found.select("vec_distance").collect()]  # at most k
        bound = max(first) if len(first) == k else float("inf")
        slack = 1e-6 * (1 + bound) if bound != float("inf") else 0
        more = [cell for d, cell, radius in by if d - radius <= bound + slack]
        return near(rows.where(F.col("_cell").isin(sorted({*chosen, *more}))).drop("_far", "_cell"), self.column, query, k, tie=self.tie)
