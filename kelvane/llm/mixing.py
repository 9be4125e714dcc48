"""Operator 6: mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Sources, by code point with null last, weigh WEIGHTS in turn. They share a budget of
`share` of all sizes by weight; a target stops at `most` times its source's size and the
excess is reshared by weight. That is water-filling: with sources ordered by cap over
weight, one level makes every target the smaller of its cap and level times weight.

Each source's documents are shuffled by a hash of their id and queued `most` times
over. A copy's virtual finish time is the source's words up to its end divided by the
source's weight. All copies in order of virtual finish time, cut where the budget is
used up, are the mix: at virtual time t each source has sent t times its weight.

Scale. No window holds a source. A running sum has two steps: sums of hash ranges
of each source, then the sum inside a range. The cut has the same two steps over ranges
of virtual time: a histogram finds the range in which the budget ends, and only that
range is sorted. There are BUCKETS ranges, or as many more as leave about PER_RANGE documents in
each, so what one task sorts stays the same size. What meets in one task besides are the
table of sources, a source's ranges and the histogram: a row for each PER_RANGE documents.

Defined results: a null text has size 0; documents of size 0 are taken 0 words. A null
source is a source, the last. Repeated rows are ordered by id and size and, being equal,
get equal results only where the cut doesn't fall between them: the cut is after the last
of equal copies if it fits, else before the first. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, stored

WEIGHTS, SHARE, MOST, BUCKETS, PER_RANGE = (5, 2, 1), 1.5, 2, 1024, 20_000


def word_count(text):
    """The number of words of a text; null: 0."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WS.replace("[", "[^") + "+")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target and level for sizes (source, source_size), one row a source."""
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn])
    every = Window.partitionBy()
    cap = F.lit(float(most)) * F.col("source_size")
    weighed = weighed.withColumn("cap", cap).withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    order = [(F.col("cap") / F.col("weight")), F.col("source").cast("binary").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here_on = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on)
    # the first source in this order whose cap isn't reached gives the level; if all caps are reached the last one does
    weighed = weighed.withColumn("own", level)
    settled = F.coalesce(F.min(F.when(F.col("own") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("own").alias("own")))).over(every)["own"], F.max(F.col("cap") / F.col("weight")).over(every))
    out = weighed.withColumn("level", settled)
    return out.select("source", "source_size", "weight", "budget", "level", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, buckets: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of docs (doc_id, text, source)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("turn", F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("size")))
    rows = stored(rows, "sizes")
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    aim = stored(targets(sums.select("source", "source_size"), share, most, weights), "targets")
    buckets = buckets or max(BUCKETS, (sums.agg(F.sum("n")).first()[0] or 0) // PER_RANGE)
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("turn", 32), F.lit(buckets)))

    # words of a source up to and with a document, in the order (bucket, turn)
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    queued = rows.withColumn("inner", F.sum("size").over(inside))
    queued = queued.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    aim_q = aim.select(F.col("source").alias("q_source"), "source_size", "target", "weight", "budget", "level")
    queued = queued.join(aim_q, F.col("source").eqNullSafe(F.col("q_source")))
    queued = queued.select("doc_id", "source", "size", "source_size", "target", "weight", "budget", "level", "turn", (F.col("base") + F.col("inner")).alias("upto"))
    queued = stored(queued, "queued")

    # every copy's virtual finish time; the histogram's ranges are parts of the level
    copies = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: ((k * F.col("source_size") + F.col("upto")) / F.col("weight")).alias("t"))
    copy = queued.where("size > 0").select("doc_id", "turn", "size", "budget", "level", F.explode(copies).alias("t"))
    copy = copy.withColumn("range", F.least(F.floor(F.col("t") / F.col("level") * buckets), F.lit(4 * buckets)).cast("long"))
    histogram = copy.groupBy("range", "budget").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = stored(histogram.withColumn("upto", F.sum("words").over(upto)), "histogram")
    over = histogram.where("upto > budget").orderBy("range").select("range", (F.col("upto") - F.col("words")).alias("used")).limit(1)
    cut_row = over.first()
    if cut_row is None:
        taken = F.lit(most) * F.col("size")
    else:
        inside = Window.orderBy("t", "turn", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        one = copy.where(F.col("range") == F.lit(cut_row["range"])).withColumn("total", F.lit(cut_row["used"]) + F.sum("size").over(inside))
        last = one.where("total <= budget").orderBy(F.desc("t"), F.desc("turn"), F.desc("doc_id"), F.desc("size")).select("t", "turn", "doc_id", "size").first()
        floor = cut_row["range"]
        t = [((F.lit(k) * F.col("source_size") + F.col("upto")) / F.col("weight")) for k in range(most)]

        def counts(x):
            here = F.least(F.floor(x / F.col("level") * buckets), F.lit(4 * buckets)).cast("long")
            if last is None:
                return (here < floor).cast("long")
            mine = F.struct(x.alias("t"), F.col("turn"), F.col("doc_id"), F.col("size"))
            edge = F.struct(F.lit(last["t"]).alias("t"), F.lit(last["turn"]).cast("long").alias("turn"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"))
            return ((here < floor) | ((here == floor) & (mine <= edge))).cast("long")

        taken = F.col("size") * sum((counts(x) for x in t[1:]), counts(t[0]))
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as the mix takes it. Rows equal in id and text are taken alike."""
    taken = mix(docs, **options).where("taken > 0")
    times = taken.groupBy("doc_id", "source", "size").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    times = times.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_times")
    same = docs["doc_id"].cast("long").eqNullSafe(times["_id"]) & docs["source"].cast("string").eqNullSafe(times["_source"]) & (word_count(docs["text"]) == times["_size"])
    copies = F.explode(F.sequence(F.lit(1), times["_times"]))
    return docs.join(times, same).select(*[docs[c] for c in docs.columns], copies).toDF(*docs.columns, "_copy_").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the words the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
