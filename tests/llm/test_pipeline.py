"""The pipeline: each stage on what the stage before kept, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from kelvane.llm import quality, simhash

from .test_operators import slow_components, slow_fingerprint, slow_mix, words

SF = "/root/testdata/sf0.001"


def slow_groups(texts):
    """Component of each text: fingerprints within three bits, or five-word shingle sets of Jaccard similarity 0.8 at least."""
    tops = list(slow_components([slow_fingerprint(t) for t in texts]))
    sets = []
    for t in texts:
        w = words((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else set())
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and tops[a] != tops[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = tops[a], tops[b]
                tops = [new if t == old else t for t in tops]
    return tops


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    (_, classify), (_, deduplicate), (_, clean), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    kept = classify(spark, docs, SF)
    all_rows = docs.collect()
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(quality.term_counts([r["text"] for r in all_rows]))
    want = {r["doc_id"] for r, s in zip(all_rows, score) if s >= quality.CUT}
    got = kept.collect()
    assert {r["doc_id"] for r in got} == want and kept.columns == docs.columns and 0 < len(want) < len(all_rows)

    one = deduplicate(spark, kept, SF)
    tops = slow_groups([r["text"] for r in got])
    least = {}
    for r, t in zip(got, tops):
        least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    rows = one.collect()
    assert {r["doc_id"] for r in rows} == set(least.values()) and one.columns == docs.columns and len(rows) < len(got)

    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    cleaned = clean(spark, one, SF)
    rest = cleaned.collect()
    assert {r["doc_id"] for r in rest} == {r["doc_id"] for r in rows if not any(i in plain(r["text"]) for i in items)} and len(rest) < len(rows)

    mixed = mix(spark, cleaned, SF)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    size = {r["doc_id"]: len(words(r["text"])) for r in rest}
    source = {r["doc_id"]: r["source"] for r in rest}
    target, _ = slow_mix([(i, size[i], source[i]) for i in size], 1.5, 2, (5, 2, 1))
    taken, longest = Counter(), Counter()
    for i in size:
        taken[source[i]] += copies[i] * size[i]
        longest[source[i]] = max(longest[source[i]], size[i])
    assert set(copies.values()) <= {1, 2} and all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in target)

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    texts = {r["doc_id"]: r["text"] for r in rest}
    for r in tokens(spark, mixed, SF).orderBy("start").collect():
        ids = model.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert start


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_dropping_near_duplicates_leaves_other_texts_unshuffled(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"{x:016x}" for x in rng.integers(0, 1 << 63, 3000))
    data = [(i, text()) for i in range(40)]
    data += [(40, data[0][1]), (41, data[0][1]), (42, data[1][1] + " end"), (5, data[5][1]), (None, data[6][1]), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    path = f"/tmp/checkpoints/unshuffled-{zlib.crc32(data[0][1].encode())}"
    docs.write.mode("overwrite").parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.drop_near_duplicates(spark.read.parquet(path))
        plan = kept._jdf.queryExecution()
        rows = kept.collect()
        plan = plan.executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, i) for i in range(40)] + [(True, 0)]
    # the texts that are shuffled, by the records that the plan's exchanges of texts wrote
    written, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "ShuffleExchangeExec" and any("text" in str(a) for a in str(p.output()).split(",")) and not any("_gone" in a for a in str(p.output()).split(",")):
            written += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        todo += [p.children().apply(k) for k in range(p.children().size())]
    assert 0 < written < 3 * 10  # of 46 rows: those of ids 0, 1, 5, 6, 40, 41, 42 and null; before, all


def test_by_marks_splits_rows_exactly(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 32_767, 32_768, 4_095, 4_096, simhash.MARKS - 1, simhash.MARKS, 123_456_789]
    for marked in (values[:6], values[6:], [], values):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        some, rest = simhash.by_marks(df, df["v"], simhash.marks(spark.createDataFrame([(v,) for v in marked], "x long")))
        bits = {v % simhash.MARKS for v in marked}
        assert sorted(r["v"] for r in some.collect()) == sorted(v for v in values if v % simhash.MARKS in bits)
        assert sorted(r["v"] for r in rest.collect()) == sorted(v for v in values if v % simhash.MARKS not in bits)


def test_shingle_sets_collect_their_bitmap_in_one_job(spark):
    before, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    lines = spark.range(5000).selectExpr("xxhash64(id) as line")
    docs = spark.createDataFrame([(0, "a b c d e f g")], "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("bitmap", "bitmap")
    try:
        simhash.shingle_sets(docs, lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        context._jsc.clearJobGroup()
    assert len(context.statusTracker().getJobIdsForGroup("bitmap")) <= 4  # before, one for each of 32 partitions and more


def test_fit_holds_few_copies_of_the_rows():
    import tracemalloc

    counts = np.random.default_rng(0).poisson(0.05, (1500, quality.WIDTH)).astype(np.float32)
    tracemalloc.start()
    model = quality.fit(counts, np.arange(1500) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * counts.nbytes  # before, over 3 times
    assert np.allclose(model.vectors, model.place(counts), atol=1e-5)
