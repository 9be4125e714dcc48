"""The training-data operators on small tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from kelvane.llm import decontaminate, html_wrappers, line_dedup, mixing, quality, registry, sharding, simhash, token_files, tokenizer_rules, warc
from kelvane.llm.common import new_path

from ..conftest import SF
from ..test_oracle import canonical

#: Other columns whose names the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, fp string, th bigint, pos int, h1 string, key string, size string, upto int, root int, line string, quality int, n int, turn int, first int, _hit_id string, _times string, _words string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
LINE = "This line is long enough to be counted as a repeated one."


def rows():
    made = [
        (1, f"{LINE}\nown one", "en", "a"), (2, f" {LINE.upper()} \nown two\n", "en", "b"), (3, f"{LINE}\t", "de", "c"), (4, LINE + "\r\n" + LINE, "fr", "a"), (5, f"x\n{LINE}\ny", "es", None),
        (6, LINE, None, "b"), (7, None, "en", "c"), (8, "", "en", "a"), (9, " \n\t ", "en", "a"), (10, "short", "en", "b"), (11, LONG, "en", "b"), (12, "same text here " * 20, "en", "c"),
        (13, "same text here " * 20, "en", "c"), (13, "same text here " * 20, "en", "c"), (None, f"{LINE}\nwithout id", "en", "a"), (14, "Éléphant ünd ñandú \U0001f600 " * 9, "de", "a"), (15, "日本語の文章です。" * 12, "ja", "a"),
    ]
    return [(*r, "x", 1, 2, "y", "z", "s", 3, 4, "l", 0, 9, 8, 7, "h", "t", "w") for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in found.description], found.fetchall())


# 1


def pages(spark, data):
    return spark.createDataFrame(data, "page_id bigint, url string, html string, payload_digest string, head string, path string")


def test_warc_round_trip(spark):
    big, small_ = "<p>é</p>" * 200, "x" * 999
    data = [(1, "http://a/", big), (2, None, big), (3, "http://a/\r\nb", big), (4, "u", small_), (5, "u", small_), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "z" * 3_000_000), (10, "u", "r" * 1000), (10, "u", "r" * 1000)]
    source, target = new_path(spark, "t-raw"), new_path(spark, "t-warc")
    warc.write_monolithic(pages(spark, [(*r, "d", "h", "p") for r in data]), source)
    got = warc.read(warc.normalise(spark, source, target)).collect()
    want = []
    for i, _, html in data:
        raw = (html or "").encode()
        heads = [j for j, _, h in data if (h or "") == (html or "") and j is not None]
        to = max(heads) if len(raw) >= 1000 and max(heads) != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, want))
    assert {r["target_uri"] for r in got if r["page_id"] == 3} == {"http://a/%0D%0Ab"}


def test_warc_members_stand_alone_and_streams_stay_bounded():
    import gzip
    import io

    body = b"".join(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, bytes([65 + n % 26]) * n) for n in (0, 5, 70_000))
    for raw in (gzip.compress(body), gzip.compress(body[:40]) + gzip.compress(body[40:])):
        parts = list(warc.chunks(io.BytesIO(raw)))
        assert b"".join(parts) == body and max(map(len, parts)) <= warc.CHUNK
        assert [len(b) for _, b in warc.records(iter([body[k : k + 7] for k in range(0, len(body), 7)]))] == [0, 5, 70_000]
    with pytest.raises(ValueError):
        list(warc.records([body[:-70_100]]))


def test_warc_empty(spark):
    source, target = new_path(spark, "t-raw"), new_path(spark, "t-warc")
    warc.write_monolithic(pages(spark, []), source)
    assert warc.read(warc.normalise(spark, source, target)).count() == 0


# 2


def test_lines_against_brute_force(docs, none):
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))
    keys = defaultdict(set)
    key = lambda line: small(line.strip(" \t\n\x0b\x0c\r"))
    for r in rows():
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                if len(key(line)) >= 40:
                    keys[key(line)].add(r[0])
    want = []
    for r in rows():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or len(keys[key(x)]) < 5 or max(keys[key(x)]) == r[0]]
        want.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out.collect())
    assert line_dedup.apply_bitmaps(none, line_dedup.drop_bitmaps(none)).count() == 0


def test_texts_of_very_many_runs(spark):
    own = 30_000
    long = "\n".join(x for k in range(own) for x in (LINE, f"own {k}"))
    df = spark.createDataFrame([(k, long if k == 1 else LINE) for k in range(1, 8)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.apply_bitmaps(df, line_dedup.drop_bitmaps(df)).collect()}
    assert got[1]["n_dropped"] == own and got[1]["n_lines"] == 2 * own and got[1]["text"] == "\n".join(f"own {k}" for k in range(own))
    assert got[7]["text"] == LINE and got[3]["n_dropped"] == 1


def test_bitmaps_are_runs(docs):
    runs = {r["doc_id"]: r["runs"] for r in line_dedup.drop_bitmaps(docs).collect()}
    assert runs == {1: [0, 1], 2: [0, 1], 3: [0, 1], 4: [0, 2], 5: [1, 1]}


# 3


def test_simple8b_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    cases = [np.zeros(700, np.uint64), np.array([2**63 + 5, 1, 2, 2**60, 0, 2**64 - 1], np.uint64), np.array([7], np.uint64), rng.integers(0, 49_408, 5000).astype(np.uint64)]
    cases += [(rng.integers(0, 2**62, 3000) >> rng.integers(0, 62, 3000)).astype(np.uint64), np.array([], np.uint64)]
    cases += [np.where(rng.random(2000) < 0.1, ~rng.integers(1, 2**40, 2000).astype(np.uint64), np.uint64(3)).astype(np.uint64)]
    for ids in cases:
        w, o = token_files.encode(ids)
        assert (token_files.decode(w, o, len(ids)) == ids).all() and len(o) == -(-len(ids) // token_files.BLOCK)
    w, _ = token_files.encode(np.full(256, 3, np.uint64))
    assert len(w) == 9  # 30 ids of 2 bits a word


def test_token_files(spark, docs, none):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.read_tokens(token_files.write_tokens(docs, new_path(spark, "t-tokens")), with_ids=True).orderBy("start").collect()
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = Counter((r[0], tuple(model.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows())
    assert want == Counter((r["doc_id"], tuple(r["ids"])) for r in got)
    assert token_files.read_tokens(token_files.write_tokens(none, new_path(spark, "t-tokens"))).count() == 0


def test_chunks_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    model, chunks = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), token_files.Chunks(None, bound=50)
    rng = random.Random(3)
    alphabet = "abcDEF éÜ0123456789'.,!?<|>\t\n\x0b\x0c\r\x1c\x85  ́日語\U0001f600s t"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    letters = "".join(map(chr, range(0xC0, 0x260))) + "abz.,ªµºßŉſǅİΣςĳ"
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(9)) for _ in range(300)]
    texts += ["<|endoftext|> a", "a<|startoftext|>b", "we'll don't I'M"]
    for t in texts:
        assert chunks.ids(t).tolist() == model.encode(t, add_special_tokens=False).ids + [1], repr(t)


# 4


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality_rows(spark, "/root/testdata/sf0.01")
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def quality_rows(spark, sf):
    return registry.queries()["op4_latent_neighbours"](spark, sf).collect()


def test_quality_scores_are_exact_votes():
    import numpy as np

    texts = [f"plain words number {k} and more of them" for k in range(30)] + [f"#### $$$ %%% {k} &&& ***" for k in range(30)]
    model = quality.fit(quality.term_counts(texts), [1] * 30 + [0] * 30)
    some = quality.term_counts(["plain words and others", "$$$ %%% ###", "", None])
    score = model.score(some)
    v = model.place(some)
    for k in range(2):
        sims = sorted(((float(model.vectors[j] @ v[k]), j) for j in range(60)), reverse=True)[: quality.NEAR]
        w = [max(0, s) ** quality.POWER for s, _ in sims]
        assert abs(score[k] - sum(x * model.labels[j] for x, (_, j) in zip(w, sims)) / sum(w)) < 1e-3
    assert score[0] > 0.9 and score[1] < 0.1 and list(score[2:]) == [0.5, 0.5]
    assert quality.fit(np.empty((0, quality.WIDTH)), []).score(some).tolist() == [0.5] * 4


def test_repeats_win_inside_the_learning_folds(spark):
    """What README says of the choice of REPEATS, on the small tables: the held-out fold is not read."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in labels}
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect() if fold.get(r["doc_id"], 2) != 2]
    counts = quality.term_counts([r["text"] for r in rows])
    y, folds = [labels[r["doc_id"]] for r in rows], [fold[r["doc_id"]] for r in rows]
    without = counts.copy()
    without[:, quality.HASHED :] = 0
    chosen = quality.cross_validated(counts, y, folds)
    assert chosen > 0.97 and chosen >= quality.cross_validated(without, y, folds)


def test_projection_keeps_the_cosines_of_its_rows():
    import numpy as np

    rng = random.Random(7)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "##", "%%"], k=rng.randrange(3, 30))) for _ in range(40)]
    counts = quality.term_counts(texts)
    model = quality.fit(counts, [k % 2 for k in range(40)])  # fewer rows than dimensions, so nothing is cut off
    weight = np.log((1 + 40) / (1 + (counts > 0).sum(axis=0))) + 1
    x = np.log1p(counts.astype(float)) * weight
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(model.vectors @ model.vectors.T - x @ x.T).max() < 1e-3
    low = np.linalg.svd(x, full_matrices=False)[2]
    other = quality.term_counts(["alpha beta %% other words", "gamma gamma"])
    y = np.log1p(other.astype(float)) * weight
    y = y / np.linalg.norm(y, axis=1, keepdims=True) @ low.T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = y @ (x @ low.T / np.linalg.norm(x @ low.T, axis=1, keepdims=True)).T
    assert np.abs(model.place(other) @ model.vectors.T - want).max() < 1e-3


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (None, 1), (4, None), (99, 0), (12, 0)], "doc_id bigint, quality int")
    assert quality.scored(docs, quality.learn(docs, labels)).count() == len(rows())
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(none, labels).count() == 0
    assert {r["score"] for r in quality.scored(docs, quality.learn(none, labels)).collect()} == {0.5}


# 5


def slow_fingerprint(text):
    import xxhash

    w = small(text or "")
    w = words(w)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(fps):
    parent = list(range(len(fps)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def test_simhash_against_brute_force(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [slow_fingerprint(r[1]) for r in rows()]
    tops = slow_components(fps)
    least = {t: min((rows()[i][0] for i in range(len(fps)) if tops[i] == t and rows()[i][0] is not None), default=None) for t in tops}
    want = Counter((r[0], f, least[t]) for r, f, t in zip(rows(), fps, tops))
    assert want == Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id in (7, 8, 9, 12, 13)").collect()) == [7, 12]


def test_stage_catches_edited_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    data = [(0, " ".join(base))]
    for k in range(1, 40):  # every copy has its own edits
        edited = list(base)
        for at in rng.sample(range(300), 4):
            edited[at] = f"new{k}x{at}"
        data.append((k, " ".join(edited)))
    data += [(100 + k, " ".join(f"v{rng.randrange(5000)}" for _ in range(300))) for k in range(40)]
    data += [(200, "one two three"), (201, "one two four"), (202, None)]
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    sets = [shingles(t) for i, t in data if i < 40]
    assert all(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets)
    fps = [slow_fingerprint(t) for i, t in data if i < 40]
    assert sum((fps[0] ^ f).bit_count() > 3 for f in fps) > 10
    kept = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {0, *range(100, 140), 200, 201, 202}


def test_similar_links_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {tuple((r["text"] or "").encode().lower().split()) for r in docs.select("text").collect()}
    texts = [t for t in texts if len(t) > 5]
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = Counter(pair for some in holders.values() for pair in combinations(some, 2))
    near = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    rows = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows, similar=0.8).collect()}
    assert near and all(group[a] == group[b] for a, b in near)


def test_links_lose_nothing(spark, monkeypatch):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # chains and dense clusters
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for shard in (2048, 4):
        monkeypatch.setattr(simhash, "SHARD", shard)
        found = {r["fp"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()}
        mine = defaultdict(set)
        for f in fps:
            root = found.get(f)
            mine[root % (1 << 64) if root is not None else f].add(f)
        want = defaultdict(set)
        for f, t in zip(fps, slow_components(fps)):
            want[t].add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    n = 500
    edges = spark.createDataFrame([(k + 1, k) for k in range(n)], "a bigint, b bigint")
    assert {(r["fp"], r["root"]) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, n + 1)}
    assert simhash.components(edges.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark, docs):
    """Repeated rows, rows without an id, and one id on two texts of which one is a copy."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    data = [(1, text(1)), (1, text(1)), (2, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, text(1)), (4, text(4)), (5, None), (6, " "), (5, text(5))]
    df = spark.createDataFrame([(*r, "x", 7) for r in data], "doc_id bigint, text string, fp string, root int")
    kept = simhash.drop_near_duplicates(df)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, text(1)), (0, text(2)), (3, text(3)), (4, text(4)), (5, None), (5, text(5))], key=repr) and kept.columns == df.columns
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_hot_shards_lose_no_link(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(20, 64), rng.randrange(0, 9))) for _ in range(600)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp bigint")
    want = Counter(Counter(slow_components(values)).values())
    for hot in (16_384, 40):
        pairs = [(r["a"], r["b"]) for r in simhash.links(df, hot=hot).collect()]
        parent = {v: v for (v,) in signed}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[top(a)] = top(b)
        assert Counter(Counter(top(v) for (v,) in signed).values()) == want


# 6


def slow_mix(data, share, most, weights):
    """Targets by resharing, then the queue in order; data: (doc_id, size, source)."""
    size = Counter()
    for _, n, s in data:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, fixed = share * sum(size.values()), {}
    while rest := [s for s in names if s not in fixed]:
        level = (budget - sum(fixed.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > most * size[s]]
        if not over:
            break
        fixed |= {s: most * size[s] for s in over}
    return {s: fixed.get(s, 0) if s in fixed else level * w[s] for s in names}, budget


def test_mix(spark, docs, none):
    rng = random.Random(2)
    data = [(k, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["a", "b", "b", "b", "c", "é", None])) for k in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, source string, size string")
    got = mixing.mix(df).collect()
    target, budget = slow_mix([(i, len(words(t)), s) for i, t, s in data], 1.5, 2, (5, 2, 1))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and abs(r["target"] - target[r["source"]]) < 1e-6
    assert budget - 40 <= sum(taken.values()) <= budget
    assert all(abs(taken[s] - target[s]) <= 80 for s in target)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs).count() == len(rows())
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(df).collect())
    assert all(copies[r["doc_id"]] == (r["taken"] // r["size"] if r["size"] else 0) for r in got)
    assert mixing.mixed_rows(docs).columns == docs.columns


@pytest.mark.parametrize("buckets", [3, 64])
def test_mix_takes_what_the_whole_queue_gives(spark, buckets):
    """Every copy in one sorted list, cut where the budget ends."""
    rng = random.Random(12)
    data = [(rng.randrange(900) if k % 50 else None, " ".join("w" for _ in range(rng.randrange(0, 30))), rng.choice(["a", "b", "b", "c", None])) for k in range(1000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(df, buckets=buckets).collect())
    rows = df.selectExpr("doc_id", "source", "text").collect()
    turns = df.select(mixing.word_count(df["text"]).alias("size"), "doc_id", "source").selectExpr("doc_id", "source", "size", "xxhash64('mix', doc_id, size) AS turn").collect()
    assert len(rows) == len(turns)
    target, budget = slow_mix([(r["doc_id"], r["size"], r["source"]) for r in turns], 1.5, 2, (5, 2, 1))
    names = sorted({r["source"] for r in turns}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    size_of = Counter()
    for r in turns:
        size_of[r["source"]] += r["size"]
    first = lambda i: (i is not None, i or 0)  # noqa: E731  null ids are smallest
    copies, upto = [], {}
    for s in names:
        mine = sorted((r for r in turns if r["source"] == s), key=lambda r: ((r["turn"] >> 32) % buckets, r["turn"], first(r["doc_id"]), r["size"]))
        total, k = 0, 0
        while k < len(mine):  # equal rows stand at one place
            same = [r for r in mine[k:] if (r["turn"], r["doc_id"], r["size"]) == (mine[k]["turn"], mine[k]["doc_id"], mine[k]["size"])]
            total += sum(r["size"] for r in same)
            for r in same:
                for j in range(2 * bool(r["size"])):
                    copies.append((((j * size_of[s] + total) / weight[s]), r["turn"], first(r["doc_id"]), r["size"], s))
            k += len(same)
    copies.sort(key=lambda x: x[:4])
    taken, used, k = Counter(), 0, 0
    while k < len(copies):
        same = [x for x in copies[k:] if x[:4] == copies[k][:4]]
        used += sum(x[3] for x in same)
        if used > budget:
            break
        for x in same:
            taken[x[1], x[2], x[3], x[4]] += x[3]
        k += len(same)
    alike = Counter((r["turn"], first(r["doc_id"]), r["size"], r["source"]) for r in turns)
    want = Counter((r["doc_id"], r["source"], r["size"], taken[(key := (r["turn"], first(r["doc_id"]), r["size"], r["source"]))] // alike[key]) for r in turns)
    assert got == want


# 7


def test_contamination(spark, none):
    items = [(1, "What is the capital of the old kingdom? It was the grey city of Marlow."), (2, "Name three rivers that cross the plain. The Ald, the Bren and the Corr."), (3, None), (None, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    filler = " ".join(f"the filler{k} of was and" for k in range(400))
    data = [
        (1, filler + " " + items[0][1] + " " + filler), (2, filler), (3, items[0][1].upper().replace(" ", "\n")), (4, "What is the capital of the old kingdom?"), (5, None), (6, ""),
        (7, filler[:60] + items[1][1]), (7, items[1][1] + items[0][1]), (None, items[1][1]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, item_id string")
    for part_bytes in (8_000_000, 60):
        got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.contamination(df, bench, part_bytes=part_bytes).collect())
        assert got == [(0, 2), (1, 1), (3, 1), (7, 1), (7, 2), (7, 2)]
    kept = decontaminate.drop_contaminated(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6] and kept.columns == df.columns
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


def slow_bm25(items, passage):
    """{item_id: score against itself} by the formula, statistics over all items; passage: words."""
    k1, b, lists = 1.2, 0.75, {i: decontaminate.terms_of(t) for i, t in items}
    lists = {i: w for i, w in lists.items() if w}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    df = Counter(t for w in lists.values() for t in set(w))
    here, out = {decontaminate.term(w) for w in passage}, {}
    for i, w in lists.items():
        impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in set(w)}
        out[i] = sum(x for t, x in impact.items() if t in here) / sum(impact.values())
    return out


def test_wand_equals_scores_by_the_formula():
    import pyarrow as pa

    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(2, 90)))) for k in range(90)]
    index = decontaminate.Index(items)
    assert [p.half for p in index.classes] == [16, 64, 256]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 400)) + rng.choice(items)[1].split()) for _ in range(40)]
    got = {(d, i): s for d, i, s, _, _ in decontaminate.search(pa.array(texts), index, overlap=0.0)}
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for half in (16, 64, 256):
            mine = {i for i, x in items if decontaminate.length_class(x) == half}
            for at in range(0, max(1, -(-len(w) // half) - 1) * half, half):
                for i, s in slow_bm25(items, w[at : at + 2 * half]).items():
                    if i in mine and s >= decontaminate.THRESHOLD - 1e-9:
                        want[d, i] = max(s, want.get((d, i), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 40


def test_index_parts_change_no_score(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 70))) + ".") for k in range(60)] + [(99, " ".join(rng.choices(vocabulary, k=20_000)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(k, " ".join(rng.choices(vocabulary, k=100) + items[k % 60][1].split()[: rng.randrange(8, 70)] + rng.choices(vocabulary, k=100))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = []
    for part_bytes in (8_000_000, 60_000, 3_000):
        found.append({(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contamination(df, bench, part_bytes=part_bytes).collect()})
    assert found[0] and all(f.keys() == found[0].keys() and all(abs(f[k] - found[0][k]) < 1e-9 for k in f) for f in found)


def test_words_part_alike_in_items_and_texts():
    import pyarrow as pa

    item = "One\u00a0two three\u2003four five six? Seven\u3000eight \x85nine ten eleven twelve."
    assert [x[1] for x in decontaminate.search(pa.array(["a b c " + item + " d", None, ""]), decontaminate.Index([(5, item)]))] == [5]
    # a short answer takes words before it along, so one changed word in it doesn't hide the item
    item = "Which of the many rivers of the old plain is the longest one? Bren."
    assert [x[1] for x in decontaminate.search(pa.array([item, item.replace("Bren", "Ald"), "Bren."]), decontaminate.Index([(6, item)]))] == [6, 6]


# 8


def text(html):
    return html_wrappers.text_of(html_wrappers.main_roots(html_wrappers.parse(html)), set())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""), ("just &amp; text", "just & text"), ("<p>a<b>b</b>c\n d<p>e<br>f", "abc d e f"), ("<body><nav>m</nav><main><h1>T</h1><p>x</main><footer>f", "T x"),
        ("<article><h1>T</h1><p><b>u.<br><p>v</p></article><footer>&copy;</footer>", "T u. v"), ("<header>h</header><article><header><h1>T</h1></header>x<aside>s</aside></article>", "T x"),
        ("<div class='cookie-notice'>c</div><div id=content class='post with-ads'>x</div>", "x"), ("<article>x<form>f<p>g</form><div class=\"comments\">c</div>y</article>", "x y"),
        ("<article><p>a<script>var t='</p>';</script>b</p><style>p{}</style></article>", "ab"), ("<!-- <article>no</article> --><article>yes", "yes"),
        ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<article>a<div role=navigation>n</div>b</article><article class=comment>c</article>", "a b"),
        ("<article><p>x &lt;tag&gt; &#233; &nbsp; y</article>", "x <tag> é y"), ("<article>a <div hidden>h</div><span style='display:none'>n</span> b", "a b"), ("a < b > c", "a < b > c"),
    ],
)
def test_text_by_roles(html, want):
    assert text(html) == want


def test_constant_nodes_are_template(spark, none):
    page = lambda k: f"<html><body><div><p>Read our terms of use today</p><p>Story {k} of many</p><p>More on {k * 7}</p></div></body></html>"
    data = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(50, None, page(1)), (51, "http://lone.example/", page(2)), (52, "x", None), (53, "http://h.example/e", ""), (5, "http://h.example/5", page(5))]
    df = spark.createDataFrame([(*r, "z", 1) for r in data], "page_id bigint, url string, html string, tree string, host int")
    got = defaultdict(list)
    for r in html_wrappers.extract(df).collect():
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Story 3 of many More on 21"] and got[5] == ["Story 5 of many More on 35"] * 2
    assert got[50] == ["Read our terms of use today Story 1 of many More on 7"] and got[51] == ["Read our terms of use today Story 2 of many More on 14"]
    assert got[52] == [""] and got[53] == [""]
    assert html_wrappers.extract(df.limit(0)).count() == 0


def test_late_paragraphs_of_a_long_reference_stay(spark):
    ranked = [r[0] for r in spark.range(40).selectExpr("id", "xxhash64('page', id) AS h").orderBy("h").collect()]
    story = lambda k: [f"paragraph {p} of the long article" if p != 3 + k else f"edited {k}" for p in range(12)]
    brief = lambda k: [f"short story {k}", f"its end {k * 7}"]
    body = {i: story(k) if k < 6 else brief(k) for k, i in enumerate(ranked)}  # the reference is the first, with five near copies
    html = lambda lines: "<html><body><div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div></body></html>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", html(x)) for i, x in body.items()], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_wrappers.extract(df).collect()} == {i: " ".join(x) for i, x in body.items()}


def tree(nested):
    """A skeleton of [tag, hash, children]."""
    columns = [], [], [], [], []

    def add(node, parent):
        k = len(columns[0])
        for c, v in zip(columns, (node[0], node[1], 10 * bool(node[1]), parent, 0)):
            c.append(v)
        for x in node[2]:
            add(x, k)

    add(nested, -1)
    return html_wrappers.Tree(*columns)


def slow_match(a, b):
    """Weight of simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            best[i + 1][j + 1] = max(best[i][j] + slow_match(x, y), best[i][j + 1], best[i + 1][j])
    return (3 if a[1] == b[1] and a[1] else 1) + best[-1][-1]


def test_tree_matching(monkeypatch):
    a = ["#main", 0, [["div", 0, [["p", 1, []], ["p", 2, []], ["p", 3, []]]]]]
    b = ["#main", 0, [["div", 0, [["h1", 9, []], ["p", 1, []], ["p", 8, []], ["p", 7, []], ["p", 3, []]]]]]
    weight, pairs = html_wrappers.match(tree(a), tree(b))
    assert weight == 1 + 1 + 3 + 1 + 3 and (2, 3) in pairs and (4, 6) in pairs
    rng = random.Random(5)
    grow = lambda depth: [rng.choice("ab"), rng.randrange(3), [grow(depth - 1) for _ in range(rng.randrange(4))] if depth else []]
    cases = [(["#", 0, [grow(3) for _ in range(3)]], ["#", 0, [grow(3) for _ in range(3)]]) for _ in range(60)]
    for x, y in cases:
        weight, pairs = html_wrappers.match(tree(x), tree(y))
        assert weight == slow_match(x, y) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    monkeypatch.setattr(html_wrappers, "CELLS", 1)  # the way of long lists is a matching too, though not always the best
    for x, y in cases:
        s, t = tree(x), tree(y)
        weight, pairs = html_wrappers.match(s, t)
        assert weight <= slow_match(x, y) and all(s.tags[i] == t.tags[j] for i, j in pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        partner = dict(pairs)
        assert all(partner[s.parents[i]] == t.parents[j] for i, j in pairs if i)


def test_deep_and_wide_pages(spark):
    wide = lambda k: "<article>" + "".join(f"<p>{k} paragraph {n}" for n in range(20_000)) + "</article>"
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    inline = "<b>" * 50_000 + "<p>y" * 2_000
    pages = [(0, wide(0)), (1, wide(1)), (2, deep), (3, inline)] + [(k, f"<article><p>story {k}</article>") for k in range(4, 14)]
    df = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in pages], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(df).collect()}
    assert got[0] == " ".join(f"0 paragraph {n}" for n in range(20_000)) and got[2] == "x" and got[3] == " ".join(["y"] * 2000) and got[9] == "story 9"


def test_boilerplate_without_telling_names(spark):
    """No tag, role, class or id tells these menus, teasers and legal lines: the wrapper alone removes them, constant or not."""
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet vita nova".split()) for _ in range(n))
    story = {k: [f"Title {k}", *(some(60) for _ in range(rng.randrange(2, 6)))] for k in range(30)}
    html = lambda k: (
        f"<html><body><div><div>Home</div><div>World</div><div>{some(2)}</div></div><div><h1>{story[k][0]}</h1>"
        + "".join(f"<p>{x}</p>" for x in story[k][1:])
        + f"<p>Read the terms of use</p></div><div><div>{some(3)}</div><div>{some(4)}</div></div><div>All rights kept</div></body></html>"
    )
    data = [(k, f"http://news.example/{k}", html(k)) for k in story]
    data += [(100, "http://news.example/empty", ""), (101, "http://news.example/error", "<html><body><p>not found</p></body></html>")]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(df).collect()}
    assert {k: got[k] for k in story} == {k: " ".join(x) for k, x in story.items()}
    assert got[100] == "" and got[101] == "not found"


def test_the_wrapper_alone_finds_the_articles(spark):
    """With every tag that tells a role made a div, and no class, the texts are those of the tagged pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages.groupBy(html_wrappers.host_of(pages["url"]).alias("host")).count().where("count >= 8")
    some = pages.withColumn("host", html_wrappers.host_of(pages["url"])).join(hosts, "host").select("page_id", "url", "html")
    bare = some.selectExpr("page_id", "url", r"regexp_replace(regexp_replace(html, '<(/?)(article|nav|footer|main|aside|header)\\b', '<$1div'), ' class=\"[^\"]*\"', '') AS html")
    assert bare.where("html LIKE '%<article%' OR html LIKE '%<nav%'").count() == 0
    want = {r["page_id"]: r["text"] for r in html_wrappers.extract(some).collect()}
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(bare).collect()}
    assert len(got) > 50 and got == want


def test_near_copies_keep_what_they_share(spark):
    lines = [f"line {k} that all copies share" for k in range(20)]
    html = lambda k: "<html><body><div>Menu</div><article>" + "".join(f"<p>{x}</p>" for x in [*lines, f"edited {k}"]) + "</article></body></html>"
    df = spark.createDataFrame([(k, f"http://h.example/{k}", html(k)) for k in range(20)], "page_id bigint, url string, html string")
    assert all(r["text"] == " ".join([*lines, f"edited {r['page_id']}"]) for r in html_wrappers.extract(df).collect())


# 9


def test_flow_moves_the_least(spark):
    rng = random.Random(6)
    for _ in range(30):
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        supplies = [rng.randrange(0, 50) for _ in range(n)]
        total = sum(supplies)
        capacities = [total * (j + 1) // m - total * j // m for j in range(m)]
        flow = sharding.least_cost_flow(supplies, capacities)
        assert [sum(f for i, _, f in flow if i == k) for k in range(n)] == supplies
        assert [sum(f for _, j, f in flow if j == k) for k in range(m)] == capacities
        least = sum(max(0, s - (capacities[i] if i < m else 0)) for i, s in enumerate(supplies))
        assert sum(f for i, j, f in flow if i != j) == least


def test_reshard(spark, docs, none):
    path = new_path(spark, "t-docs")
    rng = random.Random(8)
    more = spark.createDataFrame([(100 + k, "w" * rng.randrange(0, 900), "en", "a", *([None] * 16)) for k in range(2000)], SCHEMA)
    docs.where("doc_id <> 11").unionByName(more).repartition(6).write.parquet(path)
    table = spark.read.parquet(path)
    back = sharding.reshard(table, new_path(spark, "t-shards"), 10)
    got = back.collect()
    bytes_of = Counter()
    slots = defaultdict(list)
    for r in got:
        bytes_of[r["shard"]] += len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
    assert max(bytes_of.values()) - min(bytes_of.values()) < 0.03 * sum(bytes_of.values()) / 10
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 10
    keep = [c for c in table.columns if not c.startswith("_")]
    assert Counter(map(repr, (tuple(r[c] for c in keep) for r in got))) == Counter(map(repr, (tuple(r[c] for c in keep) for r in table.collect())))
    path = new_path(spark, "t-docs")
    none.write.parquet(path)
    assert sharding.reshard(spark.read.parquet(path), new_path(spark, "t-shards")).count() == 0


def test_reshard_leaves_unaffected_shards_alone(spark):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    path = new_path(spark, "t-docs").removeprefix("file://")
    os.makedirs(path)
    text, at = "w" * 84, 0
    for k, n in enumerate((200, 200, 280, 120)):  # 100 bytes a row, 20,000 a shard
        pq.write_table(pa.table({"doc_id": pa.array(range(at, at + n), pa.int64()), "text": [text] * n, "slot": ["own"] * n}), f"{path}/part-{k}.parquet")
        at += n
    folder = new_path(spark, "t-shards")
    got = sharding.reshard(spark.read.parquet(path), folder, 4).collect()
    assert Counter(r["shard"] for r in got) == {0: 200, 1: 200, 2: 200, 3: 200}
    assert all(sorted(r["slot"] for r in got if r["shard"] == j) == list(range(200)) for j in range(4)) and len({r["doc_id"] for r in got}) == 800
    assert {r["doc_id"] for r in got if r["shard"] == 0} == set(range(200)) and sum(r["doc_id"] in range(400, 680) and r["shard"] == 3 for r in got) == 80
    written = {x for x in os.listdir(folder.removeprefix("file://") + "/moved") if x.startswith("shard=")}
    assert written == {"shard=2", "shard=3"}
    stays = {r["file"].rsplit("/", 1)[1]: r["shard"] for r in spark.read.parquet(f"{folder}/_manifest").collect()}
    assert stays == {"part-0.parquet": 0, "part-1.parquet": 1}


def test_reshard_of_one_file_with_many_large_documents(spark):
    rng = random.Random(3)
    made = [(k, "x" * (5000 if rng.random() < 0.1 else rng.randrange(0, 300))) for k in range(3000)]
    path = new_path(spark, "t-docs")
    spark.createDataFrame(made, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    got = sharding.reshard(spark.read.parquet(path), new_path(spark, "t-shards"), 8).collect()
    assert Counter((r["doc_id"], len(r["text"])) for r in got) == Counter((i, len(t)) for i, t in made)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += len(r["text"]) + 16
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 6000
    assert all(sorted(r["slot"] for r in got if r["shard"] == j) == list(range(sum(r["shard"] == j for r in got))) for j in range(8))


# 10


def test_rules_base_measures(docs, none):
    def slow(t):
        w = words(t)
        t = t or ""
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if words(x):
                dup += x in lines
                lines.add(x)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)

    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in tokenizer_rules.apply_rules(docs).collect())
    want = Counter()
    for r in rows():
        m = slow(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    assert tokenizer_rules.apply_rules(none).count() == 0


def test_repeated_words_of_many_kinds():
    import numpy as np

    base = list(range(6000))
    assert tokenizer_rules.repeated_words(np.array(base)) == 0
    assert tokenizer_rules.repeated_words(np.array(base + base[10:17] + [7000])) == 14


def test_rules_measures_follow_the_vocabulary():
    pieces = tokenizer_rules.WordPieces(None, bound=3)
    n, chars, *_, tokens, per_token, fallback, entropy, script = tokenizer_rules.measures_of("hello hello world 𓀀 again more words", pieces)
    assert n == 7 and chars == 30 and tokens > 7 and 0 < fallback < 1 and per_token == chars / tokens and entropy > 1 and script == "latin"
    assert tokenizer_rules.script_of("これは日本語") == "other" and tokenizer_rules.script_of("") == "latin"
    assert tokenizer_rules.measures_of(None, pieces)[:6] == (0, 0, 0, 0, 0, 0)


def test_kept_by_brute_force(spark):
    """Measures from whole-word encodings by the library, then the bands, by their definitions."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = Counter()
    for r in tokenizer_rules.apply_rules(docs).collect():
        kept[r["doc_id"]] += 1
        text = docs_by_id(docs)[r["doc_id"]]
        ids = [i for w in words(text["text"]) for i in model.encode(w)]
        n = len(ids)
        chars = sum(len(w) for w in words(text["text"])) / max(1, n)
        fallback = sum(model.is_byte(i) for i in ids) / max(1, n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        letters = [ord(x) for x in text["text"] or "" if ord(x) > 64 and not 91 <= ord(x) <= 96]
        script = "latin" if not letters or sum(x < 0x250 for x in letters) >= len(letters) / 2 else "other"
        band = tokenizer_rules.BANDS["other" if script == "other" else text["lang"] if text["lang"] in ("en", "de", "fr", "es") else script]
        inside = (band.least_chars if n >= band.settled else band.short_chars) <= chars <= band.most_chars and fallback <= band.most_fallback
        inside = inside and (n < band.settled or entropy >= band.least_entropy)
        assert (r["n_tokens"], r["kept"]) == (n, inside and not r["base_failed"]), r["doc_id"]
        assert abs(r["chars_per_token"] - chars) < 1e-9 and abs(r["fallback_share"] - fallback) < 1e-9 and abs(r["token_entropy"] - entropy) < 1e-9
    assert set(kept.values()) == {1}


_BY_ID = {}


def docs_by_id(docs):
    if not _BY_ID:
        _BY_ID.update({r["doc_id"]: r for r in docs.collect()})
    return _BY_ID
