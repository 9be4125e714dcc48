"""Operator 2: line deduplication by range-partitioned hashes. DataFrame functions only.

1. Each text is split at newlines. A line's key is the line trimmed of
   [\\x20\\x09-\\x0D] with A-Z lower-cased; keys of at least `least_chars` code points
   count. A key travels as 128 bits of hash; no text does.
2. Hashes are range-partitioned with a secondary sort by document and position:
   the range key ends in the document, so a hash that a third of all lines share
   spans many partitions. A streaming window marks the first occurrence
   in each document, and a partial count for each hash leaves every partition.
3. Hashes found in at least `least_docs` documents, with their largest doc_id, join back
   to the lines. Such a join is hash against a unique side: adaptive execution splits
   a hot hash's partition.
4. What is returned is one compressed bitmap for each document with a dropped line:
   runs, alternately kept and dropped, starting with kept, and their ends, so that a text of many runs is
   cut in time linear in them.

Defined results: a null or empty text is one empty line, which is kept. Documents of
null doc_id have no identity: their lines neither count nor go. Rows of one doc_id are
one document in counts; each row has its own bitmap, found by doc_id and text hash.
In the document that keeps a key every occurrence stays. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, stored

LEAST_CHARS, LEAST_DOCS = 40, 5


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, the text's hash, pos and h1, h2 for every line with a key of at least least_chars code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    lines = base.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "th", "pos", ascii_lower(F.trim(F.col("line"), F.lit(WS_CHARS))).alias("key"))
    keys = keys.where(F.char_length("key") >= least_chars)
    return keys.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def frequent(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2 and last_id (the largest doc_id) of hashes found in at least least_docs documents."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id")]
    ranged = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange(n, *order).sortWithinPartitions(*order, "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")) == 1
    counted = ranged.withColumn("first", first).where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id"))
    return counted.where(F.col("n") >= least_docs).select("h1", "h2", "last_id")


def drop_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, th, runs (array<int>: kept, dropped, kept, ... lines; what follows the last run is kept) and the line that each run ends before, of documents that lose lines."""
    lines = stored(keyed_lines(docs, least_chars), "lines")  # hashes and places only: texts are split once
    often = stored(frequent(lines, least_docs), "frequent")  # a plain side, so a hot hash's partition can be split
    gone = lines.join(often, ["h1", "h2"]).where("doc_id <> last_id")
    each = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    begins = F.filter("p", lambda x, i: (i == 0) | (F.col("p")[F.greatest(i - 1, F.lit(0))] != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.col("p")[F.least(i + 1, F.size("p") - 1)] != x + 1))
    each = each.select("doc_id", "th", begins.alias("b"), ends.alias("e"))
    kept = F.transform("b", lambda x, i: F.when(i == 0, x).otherwise(x - F.col("e")[F.greatest(i - 1, F.lit(0))] - 1))
    dropped = F.transform("b", lambda x, i: F.col("e")[i] - x + 1)
    pairs = lambda x, y: F.flatten(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda r: F.array(r["x"], r["y"])))
    ends = pairs(F.col("b"), F.transform("e", lambda x: x + 1))
    return each.select("doc_id", "th", pairs(kept, dropped).alias("runs"), ends.alias("ends"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (kept lines joined by a newline), n_lines before and n_dropped for every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    both = rows.join(bitmaps, ["doc_id", "th"], "left").withColumn("lines", F.split("text", "\n", -1))
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs"), F.lit(2)), lambda k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.col("ends")[F.greatest(k - 1, F.lit(0))]).alias("a"), F.when(k < F.size("runs"), F.col("runs")[F.least(k, F.size("runs") - 1)]).otherwise(F.size("lines")).alias("n")))
    kept = F.array_join(F.flatten(F.transform("pairs", lambda r: F.slice("lines", r["a"] + 1, r["n"]))), "\n")
    dropped = F.aggregate(F.sequence(F.lit(1), F.size("runs"), F.lit(2)), F.lit(0), lambda a, k: a + F.col("runs")[k])
    has = F.col("runs").isNotNull()
    both = both.withColumn("pairs", F.when(has, pairs))
    return both.select("doc_id", F.when(has, kept).otherwise(F.col("text")).alias("text"), F.size("lines").cast("long").alias("n_lines"), F.when(has, dropped).otherwise(0).cast("long").alias("n_dropped"))


def op2_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: what line deduplication leaves of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, o.k IS NOT NULL AND doc_id <> last_id AS gone FROM keyed LEFT JOIN often o USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
