"""Operator 9: resharding by minimum-cost flow, under the law `bytes`.

Old shards are the files that hold the table now (over OLD files: runs of them). New
shards have equal capacities in bytes. What each old shard sends to each new one is
a flow: source -> old shard -> its own new shard at cost 0 a byte, or -> a transfer hub
at cost 1 a byte -> any new shard -> sink. The flow of least cost moves the
fewest bytes. Flows through the hub are matched in shard order.

Only documents under 1/FINE of a capacity flow. Larger ones, at most FINE times the
number of shards by arithmetic, are placed one by one first: at home if they fit, else
where most room is left.

Documents keep their order in a file, so a flow is runs of rows of files. The
driver holds one row a file and the flow; the plan's runs are broadcast, at most the
files, twice the large documents and the flow's edges in number. Row sums are made
by blocks of BLOCK rows, then over blocks. A row finds its run by file and part of the file, of which
a file has twice as many as it has runs. Text moves once: from the scan to the file that is rewritten,
dealt by the byte a row starts at, in parts of at most PART bytes on average, so no task grows with the table.
A shard that keeps all rows of its files and takes none isn't rewritten: a manifest names its
files, and its rows are read from where they are.

Defined results: a null text has 0 bytes and the crc of no bytes; null and repeated
ids are rows like any other; an empty table has no rows; other columns stay in the files
but those named shard or slot or beginning with an underscore, which are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored

SHARDS, OLD, FINE, BLOCK, EXTRA, PART = 40, 256, 128, 65_536, 16, 128 << 20


def least_cost_flow(supplies: list[int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of a flow that meets all supplies within capacities and moves the fewest bytes.

    Successive shortest paths on source, old shards, hub, new shards, sink. Old shard i is at home in new shard i.
    """
    n, m = len(supplies), len(capacities)
    source, hub, sink = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(n + m + 3)]
    to, left, cost = [], [], []

    def edge(a, b, room, price):
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            left.append(r)
            cost.append(p)

    for i, s in enumerate(supplies):
        edge(source, i, s, 0)
        if i < m:
            edge(i, n + i, s, 0)
        edge(i, hub, s, 1)
    for j, c in enumerate(capacities):
        edge(hub, n + j, c, 0)
        edge(n + j, sink, c, 0)
    while True:
        far = [float("inf")] * len(graph)
        far[source], by, queue = 0, {}, [source]
        while queue:  # label correcting: costs are 0, 1 and -1
            following = []
            for x in queue:
                for e in graph[x]:
                    if left[e] and far[x] + cost[e] < far[to[e]]:
                        far[to[e]] = far[x] + cost[e]
                        by[to[e]] = e
                        following.append(to[e])
            queue = following
        if sink not in by:
            break
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push
    home, out, into = [], [], []
    for x in range(n + m):
        for e in graph[x]:
            flow = left[e ^ 1]
            if e % 2 == 0 and x < n and flow:
                (out if to[e] == hub else home).append([x, to[e] - n, flow])
    for e in graph[hub]:
        if e % 2 == 0 and left[e ^ 1]:
            into.append([to[e] - n, left[e ^ 1]])
    found, k = [tuple(h) for h in home], 0
    for i, _, flow in out:
        while flow:
            some = min(flow, into[k][1])
            found.append((i, into[k][0], some))
            flow -= some
            into[k][1] -= some
            k += into[k][1] == 0
    return sorted(found)


def plan(light: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Runs of rows for a stored table of file, pos and size: file, first, last, shard and base (the slot of the run's first row)."""
    spark = light.sparkSession
    files = sorted(light.groupBy("file").agg(F.sum("size").alias("bytes")).collect(), key=lambda r: r["file"])  # one row a file
    total = sum(r["bytes"] for r in files)
    old_of = {r["file"]: k * min(OLD, len(files)) // max(1, len(files)) for k, r in enumerate(files)}
    schema = "file string, first bigint, last bigint, shard int, base bigint"
    if not files:
        return spark.createDataFrame([], schema)
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    bound = total // (shards * FINE)
    large = light.where(F.col("size") > bound).select("file", "pos", "size").collect()  # at most shards * FINE rows: their sizes sum to the total at most
    placed = []
    for r in sorted(large, key=lambda r: (-r["size"], r["file"], r["pos"])):
        home = old_of[r["file"]]
        j = home if home < shards and room[home] >= r["size"] else max(range(shards), key=lambda j: room[j])
        room[j] -= r["size"]
        placed.append((r["file"], r["pos"], j))
    small = light.where(F.col("size") <= bound)
    # rows are summed by blocks, then over blocks
    blocks = small.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("bytes").over(upto), F.lit(0)))
    small_of = {r["file"]: r["bytes"] for r in blocks.groupBy("file").agg(F.sum("bytes").alias("bytes")).collect()}
    supplies, before = [0] * (max(old_of.values()) + 1), []
    for r in files:
        before.append((r["file"], old_of[r["file"]], supplies[old_of[r["file"]]]))
        supplies[old_of[r["file"]]] += small_of.get(r["file"], 0)
    need, free = sum(supplies), [max(0, x) for x in room]
    whole, shares = sum(free), []
    for j in range(shards):  # large documents may overfill a shard: what is left is shared in proportion
        shares.append(need * sum(free[: j + 1]) // max(1, whole) - need * sum(free[:j]) // max(1, whole) if whole else need // shards + (j < need % shards))
    edges, at = [], {}
    for i, j, flow in sorted(least_cost_flow(supplies, shares), key=lambda e: (e[0], e[0] != e[1], e[1])):
        lo = at.get(i, 0)
        edges.append((i, lo, lo + flow, j))
        at[i] = lo + flow
    inside = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    where = spark.createDataFrame(before, "file string, old int, file_base bigint")
    edge = spark.createDataFrame(edges, "e_old int, lo bigint, hi bigint, shard int") if edges else spark.createDataFrame([], "e_old int, lo bigint, hi bigint, shard int")
    rows = small.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("inner", F.sum("size").over(inside))
    rows = rows.join(blocks.select("file", "block", "base"), ["file", "block"]).join(F.broadcast(where), "file")
    rows = rows.withColumn("middle", F.col("file_base") + F.col("base") + F.col("inner") - F.ceil(F.col("size") / 2))
    rows = rows.join(F.broadcast(edge), (F.col("old") == F.col("e_old")) & (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")), "left")
    runs = rows.groupBy("file", "shard").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).collect()  # a run an edge and file
    cuts: dict[str, list] = {}
    for f, pos, j in placed:
        cuts.setdefault(f, []).append((pos, j))
    out = []
    for r in runs:  # a run ends at each large document
        lo = r["first"]
        for pos, _ in sorted(cuts.get(r["file"], [])):
            if lo <= pos <= r["last"]:
                if lo < pos:
                    out.append([r["file"], lo, pos - 1, r["shard"]])
                lo = pos + 1
        if lo <= r["last"]:
            out.append([r["file"], lo, r["last"], r["shard"]])
    out += [[f, pos, pos, j] for f, pos, j in placed]
    slots, done = [0] * shards, []
    for f, lo, hi, j in sorted(out, key=lambda x: (x[3], x[0], x[1])):
        done.append((f, lo, hi, j, slots[j]))
        slots[j] += hi - lo + 1
    return spark.createDataFrame(done, schema)


def untouched(runs: DataFrame, light: DataFrame) -> DataFrame:
    """file, shard and base of the files of shards that keep all rows of their files, in order, and take none."""
    files = light.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    whole = runs.groupBy("shard", "file").agg(F.sum(F.col("last") - F.col("first") + 1).alias("mine"), F.min("base").alias("base"), F.max(F.col("base") - F.col("first")).alias("hi"), F.min(F.col("base") - F.col("first")).alias("lo"))
    # large documents stand in order with the runs about them, so equal differences mean that slots follow positions
    whole = whole.join(files, "file").withColumn("kept", (F.col("mine") == F.col("n")) & (F.col("hi") == F.col("lo")))
    good = whole.groupBy("shard").agg(F.min(F.col("kept").cast("int")).alias("all")).where("all = 1").select("shard")
    return whole.join(good, "shard").select("file", "shard", "base")


def reshard(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Rewrite the affected part of a table read from files into folders moved/shard=N under folder; returns all rows as read back, with shard and slot.

    docs must come from a file source and have the columns doc_id and text. The folder's manifest names the files that stay as they are.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [c for c in docs.columns if c not in ("shard", "slot") and not c.startswith("_")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    light = stored(rows.select(F.col("_file").alias("file"), F.col("_pos").alias("pos"), (F.octet_length(text) + EXTRA).cast("long").alias("size")), "sizes")
    runs = stored(plan(light, shards), "runs")
    stay = stored(untouched(runs, light), "untouched")
    kept = [r["file"] for r in stay.collect()]  # files of at most `shards` shards
    stay.write.parquet(f"{folder}/_manifest")

    # a file is cut into twice as many parts as it has runs, so that a row meets one or two of them
    moved = runs.join(F.broadcast(stay.select("file")), "file", "left_anti")
    width = light.groupBy("file").agg(F.max("pos").alias("top")).join(moved.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file")
    width = width.select(F.col("file").alias("w_file"), F.ceil((F.col("top") + 1) / (2 * F.col("n"))).alias("_width"))
    cut = moved.join(F.broadcast(width), F.col("file") == F.col("w_file"))
    cut = cut.withColumn("_part", F.explode(F.sequence(F.floor(F.col("first") / F.col("_width")), F.floor(F.col("last") / F.col("_width")))))
    cut = cut.select(F.col("file").alias("_of"), F.col("_part"), F.col("first").alias("_first"), F.col("last").alias("_last"), "shard", F.col("base").alias("_base"))
    ends = runs.groupBy("shard").agg(F.max(F.col("base") + F.col("last") - F.col("first") + 1).alias("_rows")).withColumnRenamed("shard", "_shard")
    total = light.agg(F.sum("size")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    dealt = (rows if not kept else rows.where(~F.col("_file").isin(kept))).join(F.broadcast(width), F.col("_file") == F.col("w_file"))
    dealt = dealt.join(F.broadcast(cut), (F.col("_file") == F.col("_of")) & (F.floor(F.col("_pos") / F.col("_width")) == F.col("_part")) & F.col("_pos").between(F.col("_first"), F.col("_last")))
    dealt = dealt.withColumn("slot", F.col("_base") + F.col("_pos") - F.col("_first")).join(F.broadcast(ends), F.col("shard") == F.col("_shard"))
    place = F.floor((F.col("shard") + F.col("slot") / F.col("_rows")) / F.lit(shards) * n)  # shards are equal in bytes
    dealt = dealt.select(*[F.col(f"`{c}`") for c in names], "slot", "shard", F.least(place, F.lit(n - 1)).cast("int").alias("_place"))
    dealt = dealt.repartitionById(n, "_place").sortWithinPartitions("shard", "slot").drop("_place")
    dealt.write.partitionBy("shard").parquet(folder + "/moved")
    back = spark.read.schema(dealt.schema).parquet(folder + "/moved")
    if not kept:
        return back
    here = F.broadcast(stay.select(F.col("file").alias("_of"), "shard", F.col("base").alias("_base")))
    same = rows.where(F.col("_file").isin(kept)).join(here, F.col("_file") == F.col("_of"))
    return back.unionByName(same.select(*[F.col(f"`{c}`") for c in names], (F.col("_base") + F.col("_pos")).alias("slot"), "shard"))


def op9_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: where every document is after resharding, from the rewritten files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = reshard(docs, new_path(spark, "shards"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + EXTRA).cast("long")
    return back.select(F.col("doc_id").cast("long"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
