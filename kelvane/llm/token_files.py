"""Operator 3: token ids in Simple-8b word-aligned files.

Coding. Each 64-bit word has a 4-bit selector in its high bits and 60 bits of
payload. Selector s of 1 to 14 packs COUNTS[s] ids of 60 // COUNTS[s] bits each,
first id lowest. Selector 0 is an escape: its word is followed by one raw 64-bit
word for an id of over 60 bits. Ids are coded in blocks of BLOCK; a block's last
word may hold fewer ids than its selector could. A table of word offsets, one for
each block, lets a reader decode any blocks at once with array operations.

File (little-endian): MAGIC; words uint64; doc_id int64 each (absent ids: flags say so); flag uint8
each; ids of each document uint64; block offsets uint64; uint64 numbers of documents, ids, blocks
and words, and the largest id; MAGIC. What describes the words stands behind them, so a task writes words as
its texts are encoded and a reader decodes some blocks at a time: neither holds a file's ids.

Documents are range-partitioned by doc_id and sorted, so files are in ascending
order. Every task writes its file whole under the shared folder, under a name that
its partition fixes, so a retried task replaces like with like. A manifest of
one row a file holds its id count; a document's start is its file's base plus its
place in the file.

Defined results: a null text has only the end id; null doc_ids come first (nulls
first) and read back null; repeated doc_ids are ordered by the text's hash, then text;
other columns are not read; an empty table writes and returns nothing.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, file_system, new_path, put_file, sized_batches, stored, worker_cache

MAGIC, BLOCK, END_ID = b"S8BTOK02", 256, 1
#: Ids in a word, by selector; 0 marks the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)


def encode(ids):
    """(words, offsets): uint64 words of the ids, and where each block of BLOCK ids starts among them.

    The widest selector from every place comes from sliding maxima; then all blocks follow
    their chain of words together, and all words of one selector are packed together.
    """
    import numpy as np

    ids = np.asarray(ids)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    largest = int(ids.max())
    ids = ids.astype(np.uint16 if largest < 1 << 16 else np.uint32 if largest < 1 << 32 else np.uint64, copy=False)
    size = blocks * BLOCK + 64
    flat = np.zeros(size, ids.dtype)
    flat[:n] = ids
    # most[c]: the largest of the c ids from a place on, out of two shorter ones
    most, choice = {1: flat}, np.zeros(size, np.uint8)
    for s in range(14, 0, -1):
        c = COUNTS[s]
        if c > 1:
            a = max(k for k in most if k < c)
            b = min(k for k in most if k >= c - a)
            most[c] = most[a].copy()
            np.maximum(most[a][: size - (c - b)], most[b][c - b :], out=most[c][: size - (c - b)])
        fits = most[c] < (1 << (60 // c)) if 60 // c < flat.dtype.itemsize * 8 else np.ones(size, bool)
        if not fits.any():
            break
        np.copyto(choice, s, where=fits, casting="unsafe")
    lengths = np.array((1, *COUNTS[1:]))
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    begins = np.zeros(size, bool)
    at = np.arange(blocks) * BLOCK
    limit = ends
    while len(at):
        begins[at] = True
        at = at + lengths[choice[at]]
        on = at < limit
        at, limit = at[on], limit[on]
    starts = np.flatnonzero(begins)
    chosen = choice[starts]
    place = np.arange(len(starts))
    escaped = chosen == 0
    if escaped.any():
        place = place + np.cumsum(escaped) - escaped
    words = np.empty(len(starts) + int(escaped.sum()), np.uint64)
    for k in range(15):
        some = np.flatnonzero(chosen == k)
        if len(some):
            first = starts[some]
            word = np.full(len(some), k << 60, np.uint64)
            if k:
                stop = ends[first // BLOCK]
                for j in range(COUNTS[k]):
                    inside = first + j < stop
                    word |= (flat[first + j].astype(np.uint64) * inside) << np.uint64(j * (60 // COUNTS[k]))
            else:
                words[place[some] + 1] = flat[first]
            words[place[some]] = word
    offsets = place[np.searchsorted(starts, np.arange(blocks) * BLOCK)]
    return words, offsets.astype(np.uint64)


def decode(words, offsets, n: int, kind=None):
    """The n ids of encode(), as 64-bit integers or another kind that holds them."""
    import numpy as np

    out = np.empty(n, kind or np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    begins = np.asarray(offsets, np.int64)
    raw = np.zeros(len(words), bool)
    if (s == 0).any():  # a raw word may look like any selector, so escapes are followed in order
        for k in np.flatnonzero(s == 0).tolist():
            if not raw[k]:
                raw[k + 1] = True
    lengths = np.where(raw, 0, np.where(s == 0, 1, np.array((*COUNTS, 1))[s]))
    block = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(words)]))
    place = np.cumsum(lengths) - lengths
    place -= place[begins][block]
    limit = np.minimum(BLOCK, n - np.arange(len(begins)) * BLOCK)[block]
    mask = (np.uint64(1) << np.uint64(60)) - np.uint64(1)
    first = block * BLOCK + place
    stop = block * BLOCK + limit
    for k in range(1, 15):
        some = np.flatnonzero((s == k) & ~raw)
        if len(some):
            bits, word, to, end = 60 // COUNTS[k], words[some] & mask, first[some], stop[some]
            low = np.uint64((1 << bits) - 1)
            short = bool((to + COUNTS[k] > end).any())
            for j in range(COUNTS[k]):
                if short:
                    inside = to + j < end
                    out[to[inside] + j] = word[inside] & low
                else:
                    out[to + j] = word & low
                word >>= np.uint64(bits)
    some = np.flatnonzero((s == 0) & ~raw)
    out[block[some] * BLOCK + place[some]] = words[some + 1] if len(some) else 0
    return out


class Chunks:
    """Token ids of texts, group by group, with what was learnt of words kept in arrays of bounded size.

    The vocabulary drops white space, so a text's ids are its chunks' ids. A chunk that is one
    Latin word, perhaps with ASCII marks behind, is that word's ids and those of the
    marks; such words need no normalising or splitting, so the library encodes them many at a
    time with only its model, and their last tokens end a word and show where they part. Other chunks
    are encoded by the whole library. Words and other chunks of at most LONGEST bytes are remembered:
    at most `bound` of them, as an Arrow array of keys, one array of ids and sorted hashes, 30 to 60 MB in all. When they are
    more, the half that was looked up most stays. A hash finds a key, which is compared whole.
    """

    TOGETHER, GROUP, LONGEST = 500, 4 << 20, 40
    #: A word of lower-case letters below U+0250 (every one a letter that normalising leaves as it is) and marks behind it.
    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    LATIN = r"^[a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{24f}]+[!-/:-@\[-`{-~]*$"
    #: The one letter there whose lower case is two code points.
    TWO = "\u0130"
    #: What a tokenizer's file must say for words to need only the model.
    NORMALIZERS, PATTERN = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str | None, bound: int = 500_000):
        import json
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.model, self.bound = Tokenizer.from_file(path), bound
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        self.keys, self.pool = pa.array([], pa.string()), np.empty(0, self.kind)
        self.start, self.length, self.used = (np.empty(0, np.int32) for _ in range(3))
        self.hashes, self.entry = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.marks: dict[str, object] = {}
        said = json.loads(self.model.to_str())
        suffix = said["model"].get("end_of_word_suffix")
        kinds = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        parts = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = None
        if suffix and kinds == self.NORMALIZERS and parts[0].get("pattern", {}).get("Regex") == self.PATTERN:
            m = said["model"]
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
            self.plain = Tokenizer(models.BPE(vocab=m["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.model.get_vocab_size(), bool)
            for token, k in self.model.get_vocab().items():
                self.ends[k] = token.endswith(suffix)

    def _words(self, words: list[str]):
        """(ids, lengths) of plain words."""
        import numpy as np

        out, lengths = [], []
        for k in range(0, len(words), 64 * self.TOGETHER):
            groups = [words[j : j + self.TOGETHER] for j in range(k, min(len(words), k + 64 * self.TOGETHER), self.TOGETHER)]
            for g, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.kind)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(g):
                    raise ValueError("a word's tokens don't end in one that ends a word")
                out.append(ids)
                lengths.append(np.diff(cuts, prepend=0))
        return out, lengths

    def _others(self, chunks: list[str]):
        """(ids, lengths) of chunks of any kind."""
        import numpy as np

        out, lengths = [], []
        for k in range(0, len(chunks), 4096):
            for e in self.model.encode_batch_fast(chunks[k : k + 4096], add_special_tokens=False):
                ids = np.array(e.ids, self.kind)
                out.append(ids)
                lengths.append([len(ids)])
        return out, lengths

    def _look_up(self, keys, plain):
        """(start, length, pool): where the ids of each distinct key are; plain: whether it is a plain word."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        hashes = hashes_of(keys)
        lacks, place = np.ones(len(keys), bool), np.zeros(len(keys), np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            place = self.entry[at]
            lacks = (self.hashes[at] != hashes) | ~np.asarray(pc.equal(self.keys.take(pa.array(place)), keys))
        self.used[place[~lacks]] += 1
        if not lacks.any():
            return self.start[place], self.length[place], self.pool
        words, others = np.flatnonzero(lacks & plain), np.flatnonzero(lacks & ~plain)
        a, b = self._words(keys.take(pa.array(words)).to_pylist()), self._others(keys.take(pa.array(others)).to_pylist())
        new = np.r_[words, others]
        length = np.concatenate([*a[1], *b[1]]).astype(np.int32)
        first = (np.cumsum(length) - length + len(self.pool)).astype(np.int32)
        pool = np.concatenate([self.pool, *a[0], *b[0]])
        start, lengths = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
        start[~lacks], lengths[~lacks] = self.start[place[~lacks]], self.length[place[~lacks]]
        start[new], lengths[new] = first, length
        self._keep(keys.take(pa.array(new)), hashes[new], first, length, pool)
        return start, lengths, pool

    def _keep(self, keys, hashes, first, length, pool) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        short = np.asarray(pc.less_equal(pc.binary_length(keys), self.LONGEST))
        all_keys = pa.concat_arrays([self.keys, keys.filter(pa.array(short))])
        start, lengths = np.r_[self.start, first[short]], np.r_[self.length, length[short]]
        used = np.r_[self.used, np.zeros(int(short.sum()), np.int32)]
        order = np.argsort(hashes[short], kind="stable")
        sorted_new = hashes[short][order]
        at = np.searchsorted(self.hashes, sorted_new)
        table = np.insert(self.hashes, at, sorted_new)
        entry = np.insert(self.entry, at, (order + len(self.keys)).astype(np.int32))
        if len(all_keys) > self.bound:
            stay = np.sort(np.argsort(-used, kind="stable")[: self.bound // 2])
            moved = np.full(len(all_keys), -1, np.int32)
            moved[stay] = np.arange(len(stay), dtype=np.int32)
            on = moved[entry] >= 0
            table, entry = table[on], moved[entry[on]]
            all_keys, start, lengths, used = all_keys.take(pa.array(stay)), start[stay], lengths[stay], used[stay] // 2
            pool = gathered(start, lengths, pool)
            start = (np.cumsum(lengths) - lengths).astype(np.int32)
        self.keys, self.start, self.length, self.used, self.pool, self.hashes, self.entry = all_keys, start, lengths, used, pool, table, entry

    def group(self, texts):
        """(length of each text, all ids in order) for an Arrow array of texts; the end id isn't added."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(texts)
        at = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(parts), np.int64))]
        found = parts.flatten().dictionary_encode()
        which, chunks = found.indices.to_numpy(), found.dictionary
        lower = pc.utf8_lower(chunks)
        plain = np.asarray(pc.match_substring_regex(lower, self.LATIN)) & ~np.asarray(pc.match_substring(chunks, self.TWO)) & (self.plain is not None)
        stem = pc.utf8_rtrim(lower, self.MARKS)
        keys = pc.if_else(pa.array(plain), stem, chunks).dictionary_encode()
        key_of = keys.indices.to_numpy()
        key_plain = np.zeros(len(keys.dictionary), bool)
        key_plain[key_of] = plain
        start, length, pool = self._look_up(keys.dictionary, key_plain)
        # marks behind plain words
        marked = np.flatnonzero(plain & (np.asarray(pc.binary_length(stem)) < np.asarray(pc.binary_length(lower))))
        tails = [t[k:] for t, k in zip(lower.take(pa.array(marked)).to_pylist(), pc.utf8_length(stem.take(pa.array(marked))).to_pylist())]
        if len(self.marks) > 1000:
            self.marks.clear()
        for t in set(tails).difference(self.marks):
            self.marks[t] = self._others([t])[0][0]
        names = sorted(set(tails))
        number = {t: k + 1 for k, t in enumerate(names)}
        mark_length = np.array([0, *(len(self.marks[t]) for t in names)], np.int32)
        mark_start = (np.cumsum(mark_length) - mark_length + len(pool)).astype(np.int32)
        pool = np.concatenate([pool, *(self.marks[t] for t in names)])
        mark_of = np.zeros(len(chunks), np.int32)
        mark_of[marked] = [number[t] for t in tails]
        starts = np.stack([start[key_of], mark_start[mark_of]], axis=1)[which].ravel()
        lengths = np.stack([length[key_of], mark_length[mark_of]], axis=1)[which].ravel()
        upto = np.r_[0, np.cumsum(lengths)][::2]
        return np.diff(upto[at]), gathered(starts, lengths, pool)

    def stream(self, batches):
        """(number of the first text, lengths, ids) in order, for Arrow arrays of texts, in groups of about GROUP bytes; a longer text comes in pieces, the end id last."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size, first = [], 0, 0

        def group():
            lengths, ids = self.group(pa.concat_arrays(held))
            return first, (lengths + 1).tolist(), np.insert(ids, np.cumsum(lengths), END_ID)

        for texts in batches:
            texts = pc.fill_null(texts, "")
            sizes = np.asarray(pc.binary_length(texts)).tolist()
            begin = 0
            for k, b in enumerate(sizes):
                if held or k > begin:
                    if size + b > self.GROUP:
                        held.append(texts[begin:k])
                        yield group()
                        first += sum(map(len, held))
                        held, size, begin = [], 0, k
                size += b
                if b > self.GROUP:
                    for last, piece in pieces(texts[k].as_py(), self.GROUP // 4):
                        _, ids = self.group(pa.array([piece], pa.string()))
                        yield first, [len(ids) + last], np.r_[ids, np.full(int(last), END_ID, self.kind)]
                    first, size, begin = first + 1, 0, k + 1
            if begin < len(texts):
                held.append(texts[begin:])
        if held:
            yield group()

    def ids_of(self, texts: list[str | None]) -> list:
        """Arrays of ids, the end id last."""
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[] for _ in texts]
        for k, lengths, ids in self.stream([pa.array(texts, pa.string())]):
            for j, part in enumerate(np.split(ids, np.cumsum(lengths)[:-1])):
                out[k + j].append(part)
        return [np.concatenate(x) for x in out]

    def ids(self, text: str | None):
        return self.ids_of([text])[0]


def hashes_of(texts):
    """A 64-bit hash of each text of an Arrow array."""
    import numpy as np
    from pandas.util import hash_array

    return hash_array(np.asarray(texts.to_numpy(zero_copy_only=False), object), categorize=False) if len(texts) else np.empty(0, np.uint64)


def gathered(starts, lengths, pool):
    """pool[start : start + length] of every run, one behind the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    at = np.repeat((starts + lengths - ends).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at]


def pieces(text: str, size: int):
    """(whether it is the last, piece) of a long text, cut behind white space at or after every `size` characters."""
    at = 0
    while True:
        cut = re.compile(WS).search(text, at + size)
        yield cut is None, text[at : cut.end() if cut else len(text)]
        if cut is None:
            return
        at = cut.end()


def file_name(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.s8b"


class Writer:
    """A token file's content, written as ids come: at most STEP blocks of ids are held, and a few numbers a document and block."""

    STEP = 1024

    def __init__(self, out):
        import numpy as np

        self.out, self.ids, self.held, self.offsets, self.words, self.count, self.largest = out, [], 0, [], 0, 0, 0
        self.lengths, self.names = [], []
        self.np = np
        out.write(MAGIC)

    def add(self, ids) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.STEP * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        np = self.np
        flat = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint32)
        for k in range(0, n, self.STEP * BLOCK):
            words, offsets = encode(flat[k : min(n, k + self.STEP * BLOCK)])
            self.offsets.append(offsets + np.uint64(self.words))
            self.words += len(words)
            self.out.write(words.astype("<u8", copy=False).tobytes())
        self.count += n
        self.largest = max(self.largest, int(flat[:n].max(initial=0)))
        self.ids, self.held = [flat[n:].copy()], len(flat) - n

    def close(self) -> None:
        np = self.np
        self._flush(self.held)
        for values, kind in (([i or 0 for i in self.names], "<i8"), ([i is None for i in self.names], "u1"), (self.lengths, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        for part in self.offsets:
            self.out.write(part.astype("<u8", copy=False).tobytes())
        self.out.write(struct.pack("<5Q", len(self.names), self.count, sum(map(len, self.offsets)), self.words, self.largest) + MAGIC)


def write_file(uri: str, ids: list, lengths: list[int], folder_ids: list) -> int:
    """One token file; ids: arrays in order. Returns its bytes."""

    def write(out):
        w = Writer(out)
        w.lengths, w.names = lengths, folder_ids
        for x in ids:
            w.add(x)
        w.close()

    return put_file(uri, write)


class Reader:
    """A token file's documents; ids are read and decoded some blocks at a time."""

    TAIL = 48

    def __init__(self, uri: str):
        import numpy as np

        store, path = file_system(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(max(0, size - self.TAIL))
        tail = self.file.read()
        if size < self.TAIL + 8 or tail[-8:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        docs, self.n, self.blocks, self.words, self.largest = struct.unpack_from("<5Q", tail)
        self.file.seek(8 + 8 * self.words)
        raw = self.file.read(17 * docs + 8 * self.blocks)
        flags = np.frombuffer(raw, np.uint8, docs, 8 * docs)
        self.names = [None if f else int(i) for i, f in zip(np.frombuffer(raw, "<i8", docs), flags)]
        self.lengths = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", self.blocks, 17 * docs)

    def steps(self, step: int = 1024):
        """All ids in order, `step` blocks at a time."""
        import numpy as np

        kind = np.uint32 if self.largest < 1 << 32 else np.uint64
        for k in range(0, self.blocks, step):
            stop = min(self.blocks, k + step)
            a, b = int(self.offsets[k]), int(self.offsets[stop]) if stop < self.blocks else self.words
            self.file.seek(8 + 8 * a)
            words = np.frombuffer(self.file.read(8 * (b - a)), "<u8")
            yield decode(words, self.offsets[k:stop] - self.offsets[k], min(self.n, stop * BLOCK) - k * BLOCK, kind)

    def documents(self):
        """(place of a document, part of its ids, whether it is the last part) in order."""
        import numpy as np

        ends, doc, at = np.cumsum(self.lengths).tolist(), 0, 0
        for flat in self.steps():
            lo, stop = 0, at + len(flat)
            while doc < len(ends) and ends[doc] <= stop:
                yield doc, flat[lo : ends[doc] - at], True
                lo = ends[doc] - at
                doc += 1
            if lo < len(flat):
                yield doc, flat[lo:], False
            at = stop
        self.file.close()


def read_file(uri: str):
    """(doc_ids, lengths, ids) of one token file."""
    import numpy as np

    found = Reader(uri)
    parts = list(found.steps())
    return found.names, found.lengths, np.concatenate(parts) if parts else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) as token files under folder; returns the stored manifest (path, part, n_docs, n_ids, base, bytes)."""
    spark = docs.sparkSession
    sized_batches(spark, 500)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = worker_cache(f"encoder {tokenizer_path}", lambda: Chunks(tokenizer_path))
        part = TaskContext.get().partitionId()
        uri, found = file_name(folder, part), []

        def write(out):
            w = Writer(out)

            def texts():
                for b in chain([first], batches):
                    w.names += b.column("doc_id").to_pylist()
                    w.lengths += [0] * b.num_rows
                    yield b.column("text")

            for k, lengths, ids in encoder.stream(texts()):
                for j, n in enumerate(lengths, k):
                    w.lengths[j] += n
                w.add(ids)
            w.close()
            found.append((len(w.names), w.count))

        size = put_file(uri, write)
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pydict({"path": [uri], "part": [part], "n_docs": [found[0][0]], "n_ids": [found[0][1]], "bytes": [size]})

    files = stored(rows.mapInArrow(run, "path string, part bigint, n_docs bigint, n_ids bigint, bytes bigint"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return stored(files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of a manifest; with_ids: also the ids."""
    sized_batches(manifest.sparkSession, 500)

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                source, rows, crc, ids = Reader(uri), [], 0, []
                for doc, part, last in source.documents():
                    part = part.astype("<u4", copy=False)
                    crc = zlib.crc32(part, crc)
                    if with_ids:
                        ids += part.tolist()
                    if last:
                        n = int(source.lengths[doc])
                        rows.append((source.names[doc], start, n, crc, ids))
                        start, crc, ids = start + n, 0, []
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
        kinds |= {"ids": pa.list_(pa.int64())} if with_ids else {}
        return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})

    files = manifest.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return files.mapInArrow(run, schema)


def op3_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: documents written as token files, and what the files say of each."""
    folder = new_path(spark, "tokens")
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder))
