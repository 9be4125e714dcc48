"""Operator 7: benchmark decontamination with a BM25 index and block-max WAND.

Index. Test items are documents of a BM25 index, whose statistics (number of items, document
frequencies, mean length) are those of the whole benchmark. Items are kept in blocks of BLOCK,
each posting block with its largest impact. An item's impacts are divided by its score
against itself, so one threshold holds for all: 1.0 means that every term of it occurs.

Queries. Items fall into classes of length: at most LEAST words, 4 * LEAST, 16 * LEAST and so on. For each class
every training text is cut into passages of twice the class's length, half overlapping, so
that some passage holds any whole item, and a long item doesn't widen the passages of the short ones.
A passage's distinct terms are the query. As in WAND, terms are split by document frequency: the most
frequent ones together cannot reach half of the threshold in any block, so only blocks
whose rare terms bring the rest are looked at; of these only blocks whose summed block
maxima reach the threshold are scored, exactly. Nothing above the threshold is lost. (Passages are handled many at a
time, so no pivot is moved term by term; the bounds that skip blocks are WAND's.)

Check. A hit counts if enough of the word trigrams of both the item's question and
its answer stand in the passage. The last sentence is the answer, or the last third of a
single sentence; one of fewer than ANSWER terms takes the last words before it along.

Items are cut into index parts of bounded bytes. Each part is collected with the frequencies of its terms, broadcast and
passed over all texts, so the broadcast doesn't grow with the benchmark. What a part holds changes no score.

Words are parted by [\\x20\\x09-\\x0D] in texts and items alike. Defined results: null or blank texts and items match
nothing; a null item_id or doc_id is reported as null; repeated documents are reported each, repeated items each; an
item of fewer than three words must occur word for word; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Sent, sized_batches, stored

K1, B, THRESHOLD, OVERLAP, BLOCK, PART_BYTES = 1.2, 0.75, 0.6, 0.5, 16, 8_000_000
#: The shortest class of lengths; the fewest terms of an answer; bytes of texts searched at a time.
LEAST, ANSWER, GROUP = 16, 5, 4 << 20
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def term(word: str) -> str:
    """A word in lower case without what is neither letter nor digit at its edges."""
    word = word.lower()
    return word if word.isalnum() else EDGES.sub("", word)


def terms_of(text: str | None) -> list[str]:
    return [t for w in split(text) if (t := term(w))]


def split(text: str | None) -> list[str]:
    """Words between [\\x20\\x09-\\x0D]."""
    return [w for w in re.split(f"{WS}+", text or "") if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of the question and of the answer of an item."""
    sentences = [t for s in re.split(rf"(?<=[.!?]){WS}+|\n+", text) if (t := terms_of(s))]
    words = [t for s in sentences for t in s]
    cut = len(words) - (len(sentences[-1]) if len(sentences) > 1 else max(1, len(words) // 3))
    return words[:cut], words[max(0, min(cut, len(words) - ANSWER)) :]


def grams(words: list[str], n: int) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(n))))


def length_class(text: str) -> int:
    """The class of an item's number of words: LEAST times a power of four."""
    size = LEAST
    while size < len(split(text)):
        size *= 4
    return size


@dataclass
class Statistics:
    """Of the whole benchmark: items with a term, their mean number of terms, and in how many items a term occurs."""

    items: int
    mean: float
    frequency: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        kept = [t for t in map(terms_of, texts) if t]
        return cls(len(kept), sum(map(len, kept)) / max(1, len(kept)), Counter(t for w in kept for t in set(w)))


class Index:
    """The items of an index part: posting blocks for each class of lengths."""

    def __init__(self, items: list[tuple[int | None, str]], whole: Statistics | None = None):
        whole = whole or Statistics.of([t for _, t in items])
        classes: dict[int, list] = {}
        for i, t in items:
            if terms_of(t):
                classes.setdefault(length_class(t), []).append((i, t))
        self.classes = [Postings(half, classes[half], whole) for half in sorted(classes)]
        self.numbers: dict[str, int] = {}
        for p in self.classes:
            for t in p.terms:
                self.numbers.setdefault(t, len(self.numbers))
        for p in self.classes:
            p.number(self.numbers)


class Postings:
    """Posting blocks of the items of one class of lengths."""

    def __init__(self, half: int, items: list[tuple[int | None, str]], whole: Statistics):
        import numpy as np

        kept = sorted(((i, t, terms_of(t)) for i, t in items), key=lambda x: (len(x[2]), x[0] is None, x[0] or 0, x[1]))
        self.half, self.items = half, [(i, *question_answer(t)) for i, t, _ in kept]
        n, mean = whole.items, whole.mean
        frequency = {t: whole.frequency[t] for _, _, w in kept for t in w}
        order = sorted(frequency, key=lambda t: (-frequency[t], t))
        self.terms = {t: k for k, t in enumerate(order)}
        self.blocks = ceil(len(kept) / BLOCK)
        rows: dict[tuple[int, int], list[float]] = {}
        for k, (_, _, w) in enumerate(kept):
            impact = {}
            for t in set(w):
                tf = w.count(t)
                idf = log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))
                impact[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            whole = sum(impact.values())
            for t, x in impact.items():
                rows.setdefault((self.terms[t], k // BLOCK), [0.0] * BLOCK)[k % BLOCK] = x / whole
        keys = sorted(rows)
        self.impacts = np.array([rows[k] for k in keys], np.float64).reshape(-1, BLOCK)
        self.largest = self.impacts.max(axis=1, initial=0.0)
        self.block = np.array([b for _, b in keys], np.int64)
        self.start = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(len(order) + 1))
        # frequent terms: a prefix of the order whose impacts on any one item stay under half of the threshold
        held, self.frequent = np.zeros((self.blocks, BLOCK)), 0
        for t in range(len(order)):
            trial = held.copy()
            for r in range(self.start[t], self.start[t + 1]):
                trial[self.block[r]] += self.impacts[r]
            if trial.max(initial=0.0) > THRESHOLD / 2:
                break
            held, self.frequent = trial, t + 1
        self.rest = held.max(axis=1, initial=0.0)

    def number(self, numbers: dict[str, int]) -> None:
        """mine[number in the whole part]: the term's number here, or -1."""
        import numpy as np

        self.mine = np.full(len(numbers) + 1, -1, np.int64)  # the last is the place of -1: in no item
        for t, k in self.terms.items():
            self.mine[numbers[t]] = k

    def retrieve(self, passages, terms):
        """(passage, item number, score) of all pairs at the threshold or above. passages, terms: pairs, repeats allowed."""
        import numpy as np

        width = len(self.terms)

        def postings(some):
            pairs = np.unique(passages[some] * width + terms[some])
            p, t = pairs // width, pairs % width
            lengths = self.start[t + 1] - self.start[t]
            where = np.repeat(np.arange(len(t)), lengths)
            row = np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.start[t][where]
            return p[where] * self.blocks + self.block[row], row

        pair, row = postings(terms >= self.frequent)
        keys, back = np.unique(pair, return_inverse=True)
        bound = np.bincount(back, self.largest[row], len(keys)) + self.rest[keys % self.blocks] if len(keys) else np.empty(0)
        keys = keys[bound >= THRESHOLD - 1e-9]
        if not len(keys):
            return []
        pair, row = postings(np.isin(passages, np.unique(keys // self.blocks)))
        place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        mine = keys[place] == pair
        place, row = place[mine], row[mine]
        bound = np.bincount(place, self.largest[row], len(keys))
        full = bound[place] >= THRESHOLD - 1e-9
        score = np.zeros((len(keys), BLOCK))
        np.add.at(score, place[full], self.impacts[row[full]])
        hit = np.argwhere(score >= THRESHOLD - 1e-9)
        return [(int(keys[k] // self.blocks), int(keys[k] % self.blocks) * BLOCK + int(j), float(score[k, j])) for k, j in hit]

    def verified(self, item: int, words: list[str], overlap: float) -> tuple[float, float] | None:
        """Shares of the question's and the answer's trigrams in a passage, if both suffice."""
        shares = []
        for part in self.items[item][1:]:
            n = min(3, len(part))
            mine = grams(part, n) if n else set()
            shares.append(len(mine & grams(words, n)) / len(mine) if mine else 1.0)
            if shares[-1] < overlap:
                return None
        return shares[0], shares[1]


def search(texts, index: Index, overlap: float = OVERLAP) -> list[tuple[int, int | None, float, float, float]]:
    """(place in texts, item_id, score, question's share, answer's share) for an Arrow array of texts, the best passage for each text and item."""
    import numpy as np
    import pyarrow.compute as pc

    if not index.classes or not len(texts):
        return []
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    size = np.asarray(pc.list_value_length(parts), np.int64)
    first = np.cumsum(size) - size
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    known = np.array([index.numbers.get(term(w), -1) for w in coded.dictionary.to_pylist()], np.int64)
    numbers = known[coded.indices.to_numpy()]
    at = np.flatnonzero(numbers >= 0)
    numbers, doc = numbers[at], np.searchsorted(first + size, at, "right")
    at = at - first[doc]
    found = []
    for postings in index.classes:
        own = postings.mine[numbers]
        some = own >= 0
        half, d, k, own = postings.half, doc[some], at[some] // postings.half, own[some]
        count = np.maximum(1, -(-size // half) - 1)
        base = np.cumsum(count) - count
        passages = np.concatenate([base[d] + np.minimum(k, count[d] - 1), base[d[k > 0]] + k[k > 0] - 1])
        best: dict[tuple[int, int], tuple] = {}
        for passage, item, score in postings.retrieve(passages, np.concatenate([own, own[k > 0]])):
            place = int(np.searchsorted(base, passage, "right")) - 1
            start = (passage - int(base[place])) * half
            words = flat.slice(int(first[place]) + start, min(2 * half, int(size[place]) - start)).to_pylist()
            shares = postings.verified(item, [t for w in words if (t := term(w))], overlap)
            if shares and score > best.get((place, item), (0.0,))[0]:
                best[place, item] = (score, *shares)
        found += [(place, postings.items[item][0], *v) for (place, item), v in sorted(best.items())]
    return found


def in_groups(texts, most: int = GROUP):
    """(first row, slice) of an Arrow array of texts: slices of about `most` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most, "right")))
        yield k, texts[k:stop]
        k = stop


def items_of(benchmark: DataFrame, parts: int) -> DataFrame:
    """item_id, text, part and terms (distinct; of their number n) of every item."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words = [terms_of(t) for t in b.column("text").to_pylist()]
            columns = [*b.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "part", "n", "terms"])

    items = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    return items.mapInArrow(run, "item_id bigint, text string, part bigint, n bigint, terms array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, th (the text's hash), item_id, score, question_overlap and answer_overlap for every hit of docs (doc_id, text) on benchmark (item_id, text)."""
    spark = docs.sparkSession
    sized_batches(spark, 500)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    parts = max(1, ceil(size / part_bytes))
    items = stored(items_of(items, parts), "items").where("n > 0")
    totals = items.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean")).first()
    terms = items.select("part", F.explode("terms").alias("term"))
    counted = stored(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms") if parts > 1 else terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
    schema = "doc_id bigint, th bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    out = None
    for p in range(parts):
        mine = items.where(F.col("part") == p).select("item_id", "text").collect()  # about part_bytes
        used = counted if parts == 1 else counted.join(terms.where(F.col("part") == p).select("term").distinct(), "term")
        frequency = {r["term"]: r["n"] for r in used.collect()}  # the part's terms
        sent = Sent(spark, Index([(r["item_id"], r["text"]) for r in mine], Statistics(totals["items"], totals["mean"] or 0.0, frequency)))

        def run(batches, sent=sent):
            import pyarrow as pa

            index = sent.get()
            for b in batches:
                for first, texts in in_groups(b.column("text")):
                    hits = search(texts, index, overlap)
                    at = pa.array([first + h[0] for h in hits], pa.int64())
                    columns = [b.column("doc_id").take(at), b.column("th").take(at), pa.array([h[1] for h in hits], pa.int64())]
                    columns += [pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "item_id", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without a hit."""
    hits = stored(contamination(docs, benchmark).select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_text")).distinct(), "hits")
    same = docs["doc_id"].cast("long").eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs["text"].cast("string")) == hits["_hit_text"])
    return docs.join(hits, same, "left_anti")


def op7_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document that holds a benchmark item, with the item."""
    hits = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")
