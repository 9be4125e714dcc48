"""Operator 10: quality rules from tokeniser fertility.

A public vocabulary (SentencePiece BPE with byte fallback) is applied to every
word of a text. Three measures follow: characters per token, the share of
byte-fallback tokens, and the entropy of the text's tokens. A band for each
language, or for the script where the language is unknown, rejects texts that
the vocabulary finds unlike language: each measure has bounds.

The vocabulary never crosses white space, so a word's tokens are remembered and
a text costs dictionary look-ups. The memory of words has a fixed bound.

Defined results: a null or blank text has no words and fails the base rules; a
null id stays null; repeated rows give repeated results; other columns are not
read. An unknown or null language takes the band of the text's script.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_batches, worker_cache

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Bounds of the measures. Texts of fewer tokens than ``settled`` vary more: they have ``short_chars`` and no entropy."""

    least_chars: float = 1.75
    most_chars: float = 8.0
    most_fallback: float = 0.03
    least_entropy: float = 3.9
    short_chars: float = 1.2
    settled: int = 100


#: By language, then by script. The lower bounds lie under about 99.5 % of each language's labelled good texts; a caller may pass others.
BANDS: dict[str, Band] = {
    "en": Band(least_chars=2.04),
    "de": Band(least_chars=2.05),
    "fr": Band(least_chars=1.80),
    "es": Band(least_chars=1.77),
    "latin": Band(),
    "other": Band(least_chars=0.5, short_chars=0.3, most_fallback=0.4),
}

MEASURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, script string"
)


def repeated_words(words) -> int:
    """Words inside windows of five that occur at least twice; words: an array of integers that name the words."""
    import numpy as np

    n = len(words)
    if n < 6:
        return 0
    _, w = np.unique(words, return_inverse=True)
    w = w.astype(np.int64)
    size = int(w.max()) + 1
    if size <= 4096:  # five ranks fit 60 bits
        key = w[:-4]
        for k in range(1, 5):
            key = key * 4096 + w[k : n - 4 + k]
    else:
        two = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1].astype(np.int64)
        four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1].astype(np.int64)
        key = four[:-1] * size + w[4:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    start = count[back] > 1
    cover = np.zeros(n + 1, np.int64)
    cover[: n - 4] += start
    cover[5:] -= start[: n - 4]
    return int((np.cumsum(cover[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def script_of(text: str) -> str:
    """latin if most letters are below U+0250, else other."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = points[(points > 64) & ((points < 91) | (points > 96))]
    return "latin" if not len(letters) or (letters < 0x250).mean() >= 0.5 else "other"


class WordPieces:
    """Tokens of words, remembered up to a bound."""

    def __init__(self, path: str | None, bound: int = 200_000):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.model, self.bound = sentencepiece.SentencePieceProcessor(model_file=path), bound
        self.number: dict[bytes, int] = {}
        self.tokens: list[list[int]] = []
        self.fallback = {i for i in range(self.model.get_piece_size()) if self.model.is_byte(i)}

    def of(self, words: list[bytes]) -> list[int]:
        """The number of each word; its tokens are tokens[number]."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            if len(self.number) + len(new) > self.bound:
                self.number.clear()
                self.tokens.clear()
                new = list(dict.fromkeys(words))
            for w, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)):
                self.number[w] = len(self.tokens)
                self.tokens.append(ids)
        return list(map(self.number.__getitem__, words))


def measures_of(text: str | None, pieces: WordPieces) -> tuple:
    """The row of MEASURES after doc_id."""
    import numpy as np

    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    numbers = pieces.of(words)
    ids = np.fromiter(chain.from_iterable(map(pieces.tokens.__getitem__, numbers)), np.int32)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    kinds, counts = np.unique(ids, return_counts=True)
    p = counts / max(1, len(ids))
    bytes_share = float(sum(int(c) for i, c in zip(kinds.tolist(), counts.tolist()) if i in pieces.fallback)) / max(1, len(ids))
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(np.array(numbers, np.int64)),
        len(ids), chars / max(1, len(ids)), bytes_share, float(-(p * np.log2(p)).sum()) if len(ids) else 0.0, script_of(text),
    )


def measure(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The measures of every text, with its lang: one pass, no shuffle."""
    sized_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        pieces = worker_cache(f"pieces {tokenizer_path}", lambda: WordPieces(tokenizer_path))
        for b in batches:
            rows = [measures_of(t, pieces) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "script"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds)), b.column("lang")], names=["doc_id", *names, "lang"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return plain.mapInArrow(run, MEASURES + ", lang string")


def apply_rules(docs: DataFrame, tokenizer_path: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """Measures, base_failed and kept for every row of docs (doc_id, text, lang)."""
    bands = bands or BANDS
    m = measure(docs, tokenizer_path)
    key = F.when(F.col("lang").isin([k for k in bands if k not in ("latin", "other")]), F.col("lang")).otherwise(F.col("script"))
    key = F.when(F.col("script") == "other", F.lit("other")).otherwise(key)
    verdict = F.lit(False)
    for name, b in bands.items():
        settled = F.col("n_tokens") >= b.settled
        least = F.when(settled, b.least_chars).otherwise(b.short_chars)
        inside = F.col("chars_per_token").between(least, F.lit(b.most_chars)) & (F.col("fallback_share") <= b.most_fallback)
        inside &= ~settled | (F.col("token_entropy") >= b.least_entropy)
        verdict = F.when(key == name, inside).otherwise(verdict)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def op10_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every row of documents with its measures and the verdict."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "lang", "script")
