"""Operator 5: near-duplicates by SimHash, found with BK-trees.

1. Fingerprints. Each text is lower-cased (A-Z), split into words, and hashed as
   3-word shingles, repeats included; a bit is 1 if over half of the hashes have it.
2. Equal fingerprints collapse in a pre-aggregated groupBy, so a group of copies
   of any size is one row from here on.
3. Shards. 64 bits are cut into five blocks. Two fingerprints at three or fewer
   differing bits agree on at least two blocks, so each fingerprint goes to ten
   shards, one for each pair of blocks, keyed by those 25 or 26 bits. No link is lost.
4. Each shard is a BK-tree: children keyed by their integer Hamming distance to
   the parent; a search follows only edges within the radius of the distance just
   measured. A shard's tree is built where its rows are. Broadcasting all trees has no
   size bound; a shard's tree goes to the one task that reads it. A shard of over
   SHARD fingerprints is cut again by pairs of blocks of its free bits; one of over HOT
   is cut so before it is dealt, and its parts go to different tasks.
5. A shard yields a star (member, smallest member) for each of its components,
   never all pairs. Stars merge by alternating large-star and small-star rounds,
   each written to the shared folder.

The pipeline's stage links by a second rule as well: a Jaccard similarity of 0.8 of
5-word shingles. Min-hash bands bring candidates together, and a bucket's texts are
compared by their whole shingle sets; a bucket meets in one task.

Joins back to documents are light rows (ids and fingerprints). Hot fingerprints meet
a unique other side, and adaptive execution splits such partitions.

Defined results: null and blank texts have fingerprint zero and link like any other;
a null doc_id is in its group but is smallest only if all the group's ids are null;
repeated rows are repeated in the result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_batches, stored

RADIUS, SEED, SHARD = 3, 42, 2048
#: Fingerprints of one shard above which it is dealt by inner blocks, so that no task holds all of it.
HOT = 16_384
#: The pipeline's rule: texts whose sets of WIDTH-word shingles have a Jaccard similarity of SIMILAR at least.
WIDTH, SIMILAR = 5, 0.8
#: BANDS keys of ROWS min-hashes each: a pair at SIMILAR shares none with probability (1 - 0.8 ** 6) ** 32 = 0.00006.
BANDS, ROWS = 32, 6
#: Bits of the bitmap that marks the keys of few rows, so that the others needn't be shuffled.
MARKS = 1 << 26


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, split at [\\x20\\x09-\\x0D]."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int):
    """Hashes of the runs of `width` words, repeats included; all words as one run if they are fewer."""
    import numpy as np
    import xxhash

    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: 1 - width].tolist()
    one = xxhash.xxh64_intdigest
    return np.array([one(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def majority(hashes) -> int:
    """64 bits; a bit is 1 if over half of the hashes have it."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):  # a very long text stays within bounded memory
        part = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    words = words_of(text)
    return majority(shingle_hashes(words, width)) if words else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    sized_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def block_masks(bits: list[int], blocks: int, same: int) -> list[int]:
    """One mask for each choice of `same` of the blocks that the bits are cut into."""
    cut = [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]
    return [sum(1 << i for part in some for i in part) for some in combinations(cut, same)]


MASKS = block_masks(list(range(64)), 5, 2)


class BKTree:
    """A tree over integers; a child's key is its Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within radius; then value is added as the next number."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return []
        near, stack, values, children = [], [0], self.values, self.children
        while stack:
            k = stack.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                near.append(k)
            below = children[k]
            if len(below) > 2 * radius:
                stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
            else:
                stack += [c for e, c in below.items() if -radius <= e - d <= radius]
        k = 0
        while (d := (values[k] ^ value).bit_count()) in children[k]:
            k = children[k][d]
        children[k][d] = len(values)
        values.append(value)
        children.append({})
        return near


def shard_links(values: list[int], used: int, radius: int, join) -> None:
    """Call join(a, b) so that all values of a shard within radius are connected; used: bits the shard agrees on."""
    if len(values) > SHARD:
        free = [i for i in range(64) if not used >> i & 1]
        if len(free) > 2 * (radius + 2):
            for mask in block_masks(free, radius + 2, 2):
                parts: dict[int, list[int]] = {}
                for v in values:
                    parts.setdefault(v & mask, []).append(v)
                for part in parts.values():
                    if len(part) > 1:
                        shard_links(part, used | mask, radius, join)
            return
    tree = BKTree()
    for v in values:
        for k in tree.near_then_add(v, radius):
            join(tree.values[k], v)


def stars(values: list[int], used: int, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) for each component of a shard."""
    parent: dict[int, int] = {}

    def top(x):
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    def join(a, b):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    shard_links(values, used, radius, join)
    return [(x, top(x)) for x in list(parent) if top(x) != x]


def dealt(distinct: DataFrame, masks: list[int], first: int = 0) -> DataFrame:
    """fp, t (the number of a mask, counted from first) and key (the fingerprint's bits under it)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = F.array(*[F.struct(F.lit(first + k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    return distinct.select("fp", F.inline(rows))


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Stars (a, b) that connect all distinct fingerprints (column fp) at radius or fewer differing bits."""
    masks = list(MASKS if radius == 3 else block_masks(list(range(64)), radius + 2, 2))
    shards = dealt(distinct, masks)
    big = stored(shards.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("t", "key"), "hot-shards")
    asked = {r["t"] for r in big.select("t").distinct().collect()}  # masks, ten at most
    if asked:
        plain, parts = shards.join(big, ["t", "key"], "left_anti").select("fp", "t", "key"), []
        for t in sorted(asked):
            free = [i for i in range(64) if not masks[t] >> i & 1]
            finer = [masks[t] | m for m in block_masks(free, radius + 2, 2)]
            own = shards.where(F.col("t") == t).join(big, ["t", "key"], "left_semi").select("fp")
            parts.append(dealt(own, finer, len(masks)))
            masks += finer
        shards = plain
        for x in parts:
            shards = shards.union(x)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []  # pieces of the shard that the last batch ended in

        def found(rows):
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
            some, out = ends - starts > 1, []
            for a, b in zip(starts[some].tolist(), ends[some].tolist()):
                out += stars(rows[a:b, 2].view(np.uint64).tolist(), masks[int(rows[a, 0])], radius)
            pair = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "fp")], axis=1)
            if not len(rows):
                continue
            whole = len(rows) - int((rows[:, :2] == rows[-1, :2]).all(axis=1).sum())
            if held and (whole or (held[0][0, :2] != rows[0, :2]).any()):
                yield found(np.ascontiguousarray(np.concatenate([*held, rows[:whole]])))
                held = []
            elif whole:
                yield found(np.ascontiguousarray(rows[:whole]))
            held.append(rows[whole:])
        if held:
            yield found(np.ascontiguousarray(np.concatenate(held)))

    return shards.select("t", "key", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(fp, root) of every node in edges (a, b), whose root is one node of its component.

    Alternating large-star and small-star rounds; the number of rounds grows with the logarithm
    of a component's size. Raises if `rounds` don't suffice, rather than return a partial answer.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select("b", "a").toDF("a", "b"))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        return out.where("a <> b").distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = state(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        edges = stored(star(edges, True), "stars")  # else the next star's plan holds this one several times
        edges = stored(star(edges, False), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def band_keys(shingles) -> list[int]:
    """BANDS keys (signed) of a set of shingle hashes; sets of similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS."""
    import numpy as np
    import xxhash

    factors = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (factors * shingles[k : k + 1024]).min(axis=1), out=least)
    found = np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return found.view(np.int64).tolist()


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), fp, line (hash of the words) and keys (of bands; none for texts of WIDTH words or fewer)."""
    sized_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps, lines, keys = [], [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                fps.append(majority(shingle_hashes(words, 3)) if words else 0)
                lines.append(line_hash(words))
                keys.append(band_keys(np.unique(shingle_hashes(words, WIDTH))) if len(words) > WIDTH else [])
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, lines)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *longs, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "fp", "line", "keys"])

    kind = "doc_id bigint, th bigint, fp bigint, line bigint, keys array<bigint>"
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, kind)


def line_hash(words: list[bytes]) -> int:
    """A hash of the sequence of words."""
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)


def marks(hashes: DataFrame) -> DataFrame:
    """A bitmap of MARKS bits, one for each value of the only column (64-bit hashes): _part counts from 1, _bits are of 32,768 places each, MARKS / 8 bytes in all at most."""
    at = hashes.toDF("at").select(F.expr(f"(at & {MARKS - 1}) + 1").alias("at"))  # Spark's buckets count from 1
    return at.groupBy(F.expr("bitmap_bucket_number(at)").alias("_part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("_bits"))


def by_marks(df: DataFrame, value: Column, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose value has its bit in the bitmap, all other rows); df isn't shuffled.

    The first holds all rows whose value was marked and, of n marked values, n / MARKS of the others; an exact join may follow.
    """
    pieces = parts.select("_part", F.posexplode(F.expr("transform(sequence(0, 7), k -> substring(_bits, 512 * k + 1, 512))")).alias("_k", "_bits"))  # a row of df copies one
    pieces = pieces.select((8 * (F.col("_part") - 1) + F.col("_k")).alias("_piece"), "_bits").where(F.translate(F.hex("_bits"), "0", "") != "")
    cols = [F.col(f"`{c}`") for c in df.columns]
    placed = df.select(*cols, value.bitwiseAND(F.lit(MARKS - 1)).alias("_at"))
    placed = placed.join(F.broadcast(pieces), F.shiftright("_at", 12) == F.col("_piece"), "left")
    bit = F.expr("getbit(conv(hex(substring(_bits, int(shiftright(_at, 3) & 511) + 1, 1)), 16, 10)::bigint, int(_at & 7))")
    hit = F.coalesce(bit, F.lit(0)) == 1
    return placed.where(hit).select(*cols), placed.where(~hit).select(*cols)


def shingle_sets(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line, fp and shingles (sorted 64-bit hashes) of the texts whose line is in lines, and of a few others: a bitmap of MARKS bits is broadcast."""
    found = marks(lines).collect()  # one job, however many partitions
    sent = docs.sparkSession.sparkContext.broadcast({r["_part"]: bytes(r["_bits"]) for r in found})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = sent.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                line = line_hash(words)
                at = line & (MARKS - 1)
                bits, k = held.get(at // 32_768 + 1) if len(words) > WIDTH else None, at % 32_768
                if bits and bits[k // 8] >> k % 8 & 1:
                    out.append((line, majority(shingle_hashes(words, 3)), np.unique(shingle_hashes(words, WIDTH)).tobytes()))
            longs = [pa.array(np.array([r[k] for r in out], np.uint64).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array([r[2] for r in out], pa.binary())], names=["line", "fp", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "line bigint, fp bigint, shingles binary")


def similar_stars(texts: list[tuple[int, bytes]], similar: float) -> list[tuple[int, int]]:
    """(member, first member) over fingerprints, so that all of a bucket's texts (fp, shingles) of at least this Jaccard similarity are connected."""
    groups: list[list[tuple[int, set]]] = []
    for fp, raw in texts:
        mine = set(memoryview(raw).cast("Q"))
        apart, joined = [], [(fp, mine)]
        for g in groups:
            for _, other in g:
                few, many = sorted((len(mine), len(other)))
                if few >= similar * many and (both := len(mine & other)) >= similar * (few + many - both):
                    joined = g + joined
                    break
            else:
                apart.append(g)
        groups = [*apart, joined]
    return [(fp, g[0][0]) for g in groups for fp, _ in g[1:] if fp != g[0][0]]


def similar_links(docs: DataFrame, found: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Stars (a, b) over fingerprints that connect the texts of docs that share a band's key (found: their prints) and are verified by exact Jaccard similarity.

    Texts of one word sequence are one row; of the buckets that hold the same texts one is kept. Shingle sets
    are made again for candidates alone, so the sets of all texts are never stored or shuffled.
    """
    texts = found.where("size(keys) > 0").groupBy("line").agg(F.first("keys").alias("keys"))
    rows = stored(texts.select("line", F.explode("keys").alias("key")), "band-rows")
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("least"), F.bit_xor(F.xxhash64("line")).alias("all")).where("n > 1")
    kept = stored(held.groupBy("n", "least", "all").agg(F.min("key").alias("key")).select("key"), "buckets")
    some, _ = by_marks(rows, F.col("key"), marks(kept))  # of all rows only these are shuffled
    members = stored(some.join(kept, "key"), "members")
    sets = shingle_sets(docs, members.select("line").distinct()).groupBy("line").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = members.join(sets, "line").select("key", "fp", "shingles").repartition(n, "key").sortWithinPartitions("key")

    def run(batches):
        import pyarrow as pa

        key, texts = None, []

        def pairs():
            out = similar_stars(texts, similar)
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

        for b in batches:
            for k, fp, raw in zip(b.column("key").to_pylist(), b.column("fp").to_pylist(), b.column("shingles").to_pylist()):
                if k != key:
                    if len(texts) > 1:
                        yield pairs()
                    key, texts = k, []
                texts.append((fp, raw))
        if len(texts) > 1:
            yield pairs()

    return buckets.mapInArrow(run, "a bigint, b bigint").distinct()


def classes(fps: DataFrame, radius: int, more=None) -> DataFrame:
    """fp, root (a fingerprint that names its component) and component_id (the component's smallest doc_id) of every fingerprint of fps (doc_id, fp). more(): other stars."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = links(distinct.select("fp"), radius)
    roots = components(edges if more is None else edges.union(more()))
    nodes = roots.union(roots.select("root", "root").distinct())
    least = distinct.join(nodes, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = nodes.join(least, "root").select("fp", "root", "component_id")
    out = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
    return stored(out, "classes")  # a plain side, so a hot fingerprint's partition can be split


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3, similar: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for every row of docs (doc_id, text).

    With `similar`, texts of at least this Jaccard similarity of WIDTH-word shingles are linked as well.
    """
    if similar is None:
        fps = stored(fingerprints(docs, width), "fingerprints")
        return fps.join(classes(fps, radius).drop("root"), "fp")
    found = stored(prints(docs), "prints")
    fps = found.select("doc_id", "fp")
    return fps.join(classes(fps, radius, lambda: similar_links(docs, found, similar)).drop("root"), "fp")


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Rows of docs without near-duplicates (links of op5 and of `similar`): of each group one row stays, that of the smallest doc_id
    (null ids last), of rows with that id that of the least text hash, of equal rows any one."""
    found = stored(prints(docs), "prints")
    known = classes(found.select("doc_id", "fp"), RADIUS, lambda: similar_links(docs, found, similar))
    rows = found.select("doc_id", "th", "fp").join(known.select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    kept = rows.groupBy("root").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n")).select(F.col("k.doc_id").alias("_kept_id"), F.col("k.th").alias("_kept_text"), "root", "n")
    kept = stored(kept, "kept")
    gone = rows.join(kept.where("n > 1"), "root").where(~(F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("th") == F.col("_kept_text"))))
    gone = stored(gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_text")).distinct(), "gone")
    again = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stored(again.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_text")), "repeated")
    own_id, own_text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    same = own_id.eqNullSafe(F.col("_gone_id")) & (own_text == F.col("_gone_text"))
    # only rows that may be in gone or again meet them; the texts of all others are not shuffled
    doubtful, rest = by_marks(docs, F.xxhash64(own_id, own_text), marks(gone.union(again).select(F.xxhash64("_gone_id", "_gone_text"))))
    out = doubtful.join(gone, same, "left_anti")
    if again.isEmpty():
        return rest.unionByName(out)
    # rows that are equal in id and text: one of each stays
    once = out.join(again, same, "left_anti")
    repeated = out.join(again, same, "left_semi").withColumns({"_id_": own_id, "_th_": own_text})
    return rest.unionByName(once).unionByName(repeated.dropDuplicates(["_id_", "_th_"]).drop("_id_", "_th_"))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
