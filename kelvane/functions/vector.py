"""Vector distances and nearest neighbours; exact, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nearest import best_of_cell


def _literal(v) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _pairs(a, b, f) -> Column:
    return _sum(F.zip_with(_literal(a), _literal(b), lambda x, y: f(x.cast("double"), y.cast("double"))))


def l2(a, b) -> Column:
    """Euclidean distance of two vectors (columns or sequences of numbers)."""
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a, b) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def cosine(a, b) -> Column:
    """1 - cosine; 1.0 where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1.0 - dot(a, b) / norms)


METRICS = {"l2": l2, "cosine": cosine}


def near(df: DataFrame, column: str, query, k: int, metric: str = "l2", where: Column | None = None, tie: str | None = None) -> DataFrame:
    """The k rows nearest to query with vec_distance, nearest first; rows that fail `where` are out before the k are taken."""
    query = list(query)
    if k < 0 or not query or any(x != x or abs(x) == float("inf") for x in query):
        raise ValueError("near needs a vector of finite numbers and k of at least 0")
    df = df if where is None else df.where(where)
    found = df.where(F.col(column).isNotNull()).withColumn("vec_distance", METRICS[metric](F.col(column), query))
    return found.orderBy("vec_distance", *([tie] if tie else [])).limit(k)


BLOCK = 32 << 20  # bytes of a block of queries: their vectors twice, and what is kept of their best k
GROUP = 64 << 20  # bytes of the base rows that a block of queries meets in one task
WORK = 1 << 24  # pairs that are worth a task


def knn_join(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, column: str, k: int, metric: str = "l2", chunk: int = 4096) -> DataFrame:
    """The k nearest rows of base for each query: query_id, base_id, vec_distance, rank. At most `chunk` queries are compared at once.

    Blocks of queries and groups of base rows make a grid, a task for each cell: it keeps the best k of its block while its base
    rows stream past (`nearest`), so its memory is bounded by BLOCK, GROUP and Arrow's batches however large the tables are. Only
    counts reach the driver. Comparing all pairs is quadratic: base is shuffled once a block, queries once a group.
    """
    real = "array<float>" if all(df.schema[column].dataType.simpleString() == "array<float>" for df in (queries, base)) else "array<double>"
    q = queries.select(F.col(query_id).alias("_q"), F.col(column).cast(real).alias("_v")).where("_v is not null")
    b = base.select(F.col(base_id).alias("_b"), F.col(column).cast(real).alias("_v")).where("_v is not null")
    names = [query_id, f"near_{base_id}", "vec_distance"]
    kinds = T.StructType([T.StructField(names[0], queries.schema[query_id].dataType), T.StructField(names[1], base.schema[base_id].dataType), T.StructField(names[2], T.DoubleType())])
    n = F.count(F.lit(1))
    (many, dim), (rows, _) = q.agg(n, F.coalesce(F.max(F.size("_v")), F.lit(0))).union(base.agg(n, F.lit(0))).collect()
    k = max(0, min(k, rows))
    blocks, groups = _grid(many, rows, dim, k, base.sparkSession.sparkContext.defaultParallelism)

    def deal(df, key, n):
        return df.withColumn("_own", F.pmod(F.xxhash64(key, "_v"), F.lit(n)).cast("int"))

    def each(df, n):
        return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_other"))

    q = each(deal(q, "_q", blocks), groups).select((F.col("_own") * groups + F.col("_other")).alias("_cell"), F.lit(False).alias("_base"), "_q", F.lit(None).cast(kinds[1].dataType).alias("_b"), "_v")
    b = each(deal(b, "_b", groups), blocks).select((F.col("_other") * groups + F.col("_own")).alias("_cell"), F.lit(True).alias("_base"), F.lit(None).cast(kinds[0].dataType).alias("_q"), "_b", "_v")
    cells = q.union(b).repartitionById(blocks * groups, "_cell").sortWithinPartitions("_base", "_b").select("_base", "_q", "_b", "_v")
    out = cells.mapInArrow(lambda batches: best_of_cell(batches, k, metric, chunk, names) if k else (), kinds)
    order = Window.partitionBy(names[0]).orderBy(names[2], names[1])
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _grid(many: int, rows: int, dim: int, k: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and groups of base rows; as many groups as keep all cores busy, if there is work for them."""
    blocks = max(1, -(-many * (16 * dim + 72 * k) // BLOCK))
    wanted = min(-(-many * rows // WORK), 4 * cores)
    return blocks, max(1, -(-rows * (8 * dim + 64) // GROUP), -(-wanted // blocks))
