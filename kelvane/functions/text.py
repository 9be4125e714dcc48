"""Full-text tokens and the containment predicate, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space between tokens; runs of what is neither letter nor number at a token's edges.
SPACE, EDGES = r"(?U)\s+", r"(?U)(?<!\S)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?!\S)"


def tokenize(c: Column) -> Column:
    """The distinct tokens of a text: split at white space, edges trimmed, lower case, empty ones dropped."""
    words = F.split(F.regexp_replace(F.lower(c), EDGES, ""), SPACE)  # one pass over the text, none a token
    return F.array_distinct(F.filter(words, lambda t: t != ""))


def match(c: Column, query: str | Column) -> Column:
    """Whether every token of the query is among the text's; an empty query matches nothing, a null text is null."""
    asked = tokenize(F.lit(query) if isinstance(query, str) else query)
    if isinstance(query, str) and query.isascii():  # texts that lack a token as a substring need no tokens
        holds = F.forall(asked, lambda t: F.contains(F.lower(c), t))
        exact = F.size(F.array_except(asked, tokenize(c))) == 0
        return F.when(c.isNull(), F.lit(None).cast("boolean")).when((F.size(asked) > 0) & holds, exact).otherwise(False)
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise((F.size(asked) > 0) & (F.size(F.array_except(asked, tokenize(c))) == 0))


def postings(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(token, id) pairs: the inverted index as rows, partitioned by nothing until a query needs it."""
    return df.select(F.explode(tokenize(F.col(column))).alias("token"), F.col(id_column))


def search(index: DataFrame, id_column: str, query: str) -> DataFrame:
    """Ids that have all tokens of a query, from an index of postings."""
    asked = F.broadcast(index.sparkSession.sql("SELECT 1").select(F.explode(tokenize(F.lit(query))).alias("token")))  # the query's tokens
    need = asked.agg(F.count(F.lit(1)).alias("need"))
    hits = index.join(asked, "token").groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(need), (F.col("n") == F.col("need")) & (F.col("need") > 0)).select(id_column)


BUCKETS = 64


def write_index(df: DataFrame, id_column: str, column: str, folder: str, buckets: int = BUCKETS) -> None:
    """Store the postings under folder by buckets of tokens, sorted by token in each file, so that a search reads a few row groups of a few buckets.

    A frequent token's postings are dealt by id as well, so that no task writes all of them.
    """
    rows = postings(df, id_column, column).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(id_column), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(folder)


def search_index(spark, folder: str, id_column: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """Ids that have all tokens of a query, from a stored index: only the buckets of its tokens are read."""
    token = F.explode(tokenize(F.lit(query))).alias("token")
    asked = spark.sql("SELECT 1").select(token).select("token", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket")).collect()  # the query's tokens
    index = spark.read.parquet(folder)
    if not asked:
        return index.select(id_column).limit(0)
    mine = index.where(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("token").isin([r["token"] for r in asked]))
    return mine.groupBy(id_column).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(asked)).select(id_column)
