"""knn_join by brute force, over many cells, and the memory of its workers."""

import threading

import numpy as np
import psutil
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelvane.functions import vector
from kelvane.functions.nearest import Nearest


def all_pairs(queries, base, k, metric):
    """By definition: every pair, the engine's own distance, ties by id."""
    q, b = (df.where("v is not null").select(F.col("id").alias(i), F.col("v").alias(v)) for df, i, v in ((queries, "q", "x"), (base, "b", "y")))
    pairs = q.crossJoin(b).withColumn("d", vector.METRICS[metric](F.col("y"), F.col("x")))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "b"))).where(F.col("rank") <= k).select("q", "b", "d", "rank")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, metric, small):
    if small:  # several blocks and groups
        monkeypatch.setattr(vector, "BLOCK", 2000)
        monkeypatch.setattr(vector, "GROUP", 5000)
    x = np.random.default_rng(5).normal(size=(300, 6)).astype(np.float32)
    rows = [(f"k{i:03}", (x[i % 120] * (1 if i % 7 else 3)).tolist()) for i in range(300)]  # copies, and others of one direction
    rows += [("null", None), ("zero", [0.0] * 6), ("nan", [float("nan")] * 6), ("hole", [None] + [1.0] * 5), ("far", [1e30] * 6)]
    base = spark.createDataFrame(rows, "id string, v array<float>")
    queries = base.where("id like '%0' or id in ('zero', 'null', 'far')").withColumn("v", F.col("v").cast("array<double>"))
    base = base.where("id != 'hole'") if metric == "l2" else base.where("id not in ('hole', 'nan')")
    want = {tuple(r) for r in all_pairs(queries, base, 9, metric).collect()}
    got = [tuple(r) for r in vector.knn_join(queries, base, "id", "id", "v", 9, metric).collect()]
    assert len(got) == len(want) == 32 * 9 and set(got) == want


def test_grid_grows_with_the_tables():
    assert vector._grid(20, 2000, 64, 5, 12) == (1, 1)
    assert vector._grid(0, 0, 0, 0, 12) == (1, 1)
    blocks, groups = vector._grid(10**7, 10**9, 64, 5, 12)
    assert 10**7 / blocks * (16 * 64 + 72 * 5) <= vector.BLOCK and 10**9 / groups * (8 * 64 + 64) <= vector.GROUP


def test_few_rows_and_wrong_lengths(spark):
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 5.0])], "id bigint, v array<double>")
    join = lambda q, b, k: sorted(tuple(r) for r in vector.knn_join(q, b, "id", "id", "v", k).collect())
    assert join(two, two, 9) == [(1, 1, 0.0, 1), (1, 2, 5.0, 2), (2, 1, 5.0, 2), (2, 2, 0.0, 1)]
    assert join(two, two, 0) == join(two.limit(0), two, 3) == join(two, two.limit(0), 3) == []
    with pytest.raises(Exception, match="vectors of lengths"):
        join(two, spark.createDataFrame([(1, [0.0])], "id bigint, v array<double>"), 1)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_bounds_lose_no_row(metric, shift):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 16)) + shift  # far from the origin products cancel
    x[::11] = x[0]
    x[7], x[8], x[9], x[10] = 1e200, 1e-200, np.inf, np.nan
    q = np.concatenate([x[:12], x[100:700:3], rng.normal(size=(5, 16)) + shift])
    found = Nearest(q, 10, metric, 100)
    for i in (0, 3, 2500):
        found.add(x[i : {0: 3, 3: 2500, 2500: 5000}[i]])
    at = np.concatenate([part[1] for part in found.best()]).reshape(len(q), 10)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    for i, v in enumerate(q):
        with np.errstate(all="ignore"):
            if metric == "l2":
                d = np.sqrt(np.cumsum((x - v) ** 2, axis=1)[:, -1])
            else:
                norms = norm * np.sqrt(np.cumsum(v * v)[-1])
                d = np.where(norms == 0, 1.0, 1.0 - np.cumsum(x * v, axis=1)[:, -1] / norms)
        assert at[i].tolist() == np.lexsort((np.arange(len(x)), d))[:10].tolist()


def test_workers_hold_no_matrix_of_all_queries(spark):
    """4,000 queries against batches of 10,000 rows are 320 MB of distances a worker, and as much for each step on them."""
    base = spark.range(0, 40_000, 1, 4).select("id", F.array(*[F.sin(F.col("id") * (j + 1.7)) for j in range(8)]).alias("v"))
    top, stop, seen = psutil.Process(), threading.Event(), []

    def workers():
        total = 0
        for p in top.children(recursive=True):
            try:
                total += p.memory_info().rss if "pyspark.daemon" in " ".join(p.cmdline()) else 0
            except psutil.Error:
                pass
        return total / 1e6

    def watch():
        while not stop.wait(0.05):
            seen.append(workers())

    before = workers()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert vector.knn_join(base.where("id % 10 = 0"), base, "id", "id", "v", 5).count() == 20_000
    finally:
        stop.set()
        watcher.join()
    assert max(seen) - before < 1500
