"""Operator 4: quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte pairs and triples of the whole text, so any language and any
noise has terms, and REPEATS terms that stand for words that repeat the word before: the square
of their share of the text (in thousandths), so that chance repeats vanish. Labelled rows of the learning folds, at most FIT of each label (the least
hashes of their ids), give inverse document frequencies and a truncated singular
value decomposition; their latent vectors, at most 2 * FIT of RANK numbers, are broadcast
with the projection of WIDTH x RANK numbers. Each document's vector meets all labelled
vectors in blocked matrix products, so similarities are exact cosines; its NEAR most
similar neighbours vote with their labels, weighted by a power of their similarity.

Inputs of a score are the text alone. Learning uses labels whose crc32(doc_id as text)
mod 4 is not 2.

Defined results: null and empty texts, and texts of one byte, have no terms: they score
0.5 and are predicted 0. A null doc_id is not held out and teaches nothing; labels that are null or
name no document teach nothing; repeated labels of a document teach once for each
distinct label; without labelled rows every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, sized_batches

#: REPEATS and the square were chosen by cross_validated() over the three learning folds of the labels at sf0.1 (README).
FIT, HASHED, REPEATS, RANK, NEAR, POWER, CUT, SEED = 1500, 4096, 64, 96, 21, 8, 0.7, 7
#: Words added to a text's length when its share of repeats is taken, so that a chance repeat in a short text says little.
SMOOTH = 50
WIDTH = HASHED + REPEATS


def term_counts(texts: list[str | None]):
    """Counts of hashed byte pairs and triples and of repeats, a row of WIDTH for each text."""
    from itertools import islice
    from operator import eq

    import numpy as np

    out = np.zeros((len(texts), WIDTH), np.float32)
    for k, t in enumerate(texts):
        encoded = (t or "").encode("utf-8", "surrogatepass")
        words = encoded.split()
        out[k, HASHED:] = 1000 * (sum(map(eq, words, islice(words, 1, None))) / (len(words) + SMOOTH)) ** 2
        raw = np.frombuffer(encoded, np.uint8)
        for at in range(0, max(0, len(raw) - 1), 1 << 20):  # a very long text stays within bounded memory
            b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
            stop = min(1 << 20, len(raw) - at)
            two = b[:-1] * np.uint32(257) + b[1:]
            hashed = ((two * np.uint32(2654435761)) >> np.uint32(20))[:stop]
            out[k, :HASHED] += np.bincount(hashed, minlength=HASHED)
            if len(b) > 2:
                three = two[:-1] * np.uint32(251) + b[2:] + np.uint32(97)
                hashed = ((three * np.uint32(2246822519)) >> np.uint32(20))[:stop]
                out[k, :HASHED] += np.bincount(hashed, minlength=HASHED)
    return out


@dataclass
class Model:
    """What is broadcast: weights and projection of terms, unit vectors of labelled rows and their labels."""

    weight: object
    projection: object
    vectors: object
    labels: object

    def place(self, counts):
        """Unit latent vectors; rows without terms are zero."""
        import numpy as np

        x = np.log1p(counts) * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        x = x @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts):
        """Weighted vote of the NEAR nearest labelled rows, for each row of counts."""
        import numpy as np

        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.place(counts) @ self.vectors.T
        k = min(NEAR, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        vote = (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.where((total > 0) & (counts.sum(axis=1) > 0), vote, 0.5)


def scale(x):
    """Rows of x at length 1, in place; rows of zeros stay."""
    import numpy as np

    for k in range(0, len(x), 512):  # a norm's squares are as large as its rows
        x[k : k + 512] /= np.maximum(np.linalg.norm(x[k : k + 512], axis=1, keepdims=True), 1e-12)
    return x


def fit(counts, labels) -> Model:
    """Latent-semantic analysis of labelled rows (a randomised decomposition with a fixed seed)."""
    import numpy as np

    counts, labels = np.asarray(counts, np.float32), np.asarray(labels, np.float64)
    n = len(labels)
    weight = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    x = np.log1p(counts)
    del counts  # the driver holds one copy of the rows from here on
    x *= weight
    scale(x)
    rank = max(1, min(RANK, n))
    sketch = x.T @ (x @ np.random.default_rng(SEED).standard_normal((WIDTH, rank + 16), dtype=np.float32)) if n else np.zeros((WIDTH, 1), np.float32)
    for _ in range(4):
        sketch = x.T @ (x @ np.linalg.qr(sketch)[0])
    basis = np.linalg.qr(sketch)[0]
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    projection = np.ascontiguousarray((basis @ v.T)[:, :rank], np.float32)
    return Model(weight, projection, scale(x @ projection), labels)


def cross_validated(counts, labels, folds, cut: float = CUT) -> float:
    """Share of rows on whose side of the cut a model of the other folds puts them. Choices are made by this, inside the learning folds."""
    import numpy as np

    counts, labels, folds, right = np.asarray(counts, np.float32), np.asarray(labels), np.asarray(folds), 0
    for f in sorted(set(folds.tolist())):
        here = folds == f
        score = fit(counts[~here], labels[~here]).score(counts[here])
        right += int(((score >= cut) == (labels[here] == 1)).sum())
    return right / max(1, len(labels))


def fold(doc_id):
    """crc32 of the id as text, mod 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT) -> Model:
    """A model from at most `most` labelled rows of each label."""
    import numpy as np

    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality"))
    usable = usable.where("_id is not null and _quality in (0, 1)").where(fold(F.col("_id")) != 2).distinct()
    order = [F.xxhash64("_id"), F.col("_id")]
    some = usable.where("_quality = 0").orderBy(*order).limit(most).union(usable.where("_quality = 1").orderBy(*order).limit(most))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = term_counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_quality"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["_id", "_quality", "counts"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    rows = chosen.select("_id", "_quality", "text").mapInArrow(run, "_id bigint, _quality int, counts binary")
    rows = rows.dropDuplicates(["_id", "_quality"]).toArrow()  # at most 2 * most rows of WIDTH numbers
    ids, marks = rows["_id"].to_pylist(), rows["_quality"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], marks[k]))

    def matrix():
        nonlocal rows
        place, counts = {k: n for n, k in enumerate(order)}, np.empty((len(order), WIDTH), np.float32)
        for k, raw in enumerate(x for part in rows["counts"].chunks for x in part):
            counts[place[k]] = np.frombuffer(raw.as_buffer(), np.float32)
        rows = None
        return counts

    return fit(matrix(), [marks[k] for k in order])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th (the text's hash) and score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    sized_batches(spark, 500)
    sent = Sent(spark, model)

    def run(batches):
        import pyarrow as pa

        model = sent.get()
        for b in batches:
            texts = b.column("text").to_pylist()
            score = [s for k in range(0, len(texts), 250) for s in model.score(term_counts(texts[k : k + 250])).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(score, pa.float64())], names=["doc_id", "th", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
    return rows.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows of docs that score at least cut."""
    sized_batches(docs.sparkSession, 500)
    sent = Sent(docs.sparkSession, learn(docs, labels))
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        model = sent.get()
        for b in batches:
            texts = b.column(place).cast(pa.string()).to_pylist()
            keep = [s >= cut for k in range(0, len(texts), 250) for s in model.score(term_counts(texts[k : k + 250])).tolist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op4_latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: a score and a prediction for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
