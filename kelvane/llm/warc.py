"""Operator 1: WARC archives, and a normaliser of monolithic gzip.

Writing. Pages become WARC/1.1 records: a payload of at least LEAST bytes that other
pages repeat is a response for the largest page_id and a revisit for the others. The
two line breaks that end a record are the line separator of Spark's text writer, which
commits files whole and gzips each as one stream: a monolithic archive.

Normalising. A monolithic archive is inflated once, front to back, in bounded
memory, and every record is written as its own gzip member. A sidecar index beside
the new archive has a line for each record: offset, length, type, record id.

Reading. A record is found by its index line, inflated alone and hashed. A revisit
takes its payload's digest from its header and its size from the response it refers
to, in an equi-join on ids whose hot side adaptive execution splits.

Defined results: a null html is the empty payload; a null url writes no target; a null
page_id has a record id without a number and reads back null (of null ids none can be the
largest); if the largest page_id is repeated, each of its records is a response; line breaks
in urls are percent-encoded; an empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, new_path, put_file, stored

LEAST, CHUNK, LEVEL = 1000, 1 << 20, 1
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    groups = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("head"))
    groups = groups.where("n > 1 and head is not null").select(F.col("payload_digest").alias("digest"), "head")  # only these meet the pages
    groups = stored(groups, "payloads")  # a plain side, so a hot payload's partition can be split
    joined = base.join(groups, base["payload_digest"] == groups["digest"], "left")
    return joined.select(*base.columns, F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))


def record(date: str):
    """The text of a record without its two closing line breaks."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_monolithic(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages as monolithic .gz archives under folder."""
    out = classified(pages).select(record(date).alias("value"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def chunks(stream):
    """Inflated bytes of a gzip stream of one or more members; memory is bounded."""
    engine = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            if engine.eof:
                engine = zlib.decompressobj(31)
            part = engine.decompress(raw, CHUNK)
            raw = engine.unconsumed_tail or engine.unused_data
            if part:
                yield part
    if part := engine.flush():
        yield part


def records(parts):
    """(header, block) of each record in an iterable of bytes."""
    held, source = bytearray(), iter(parts)

    def more() -> bool:
        if (part := next(source, None)) is None:
            return False
        held.extend(part)
        return True

    while True:
        while held[:2] in (b"\r\n", b"\r", b"") and (len(held) >= 2 or more()):
            if held[:2] == b"\r\n":
                del held[:2]
        if not held:
            return
        searched = 0
        while (end := held.find(END, searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                raise ValueError("a WARC record's header is cut off")
        header = bytes(held[:end])
        length = int(fields(header).get("content-length", "0"))
        while len(held) < end + 4 + length:
            if not more():
                raise ValueError("a WARC record's block is cut off")
        block = bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]
        yield header, block


def fields(header: bytes) -> dict[str, str]:
    """A record's named fields, names in lower case."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise_file(source: str, target: str) -> tuple[int, int]:
    """One archive rewritten with a member for each record, and its sidecar index target.idx. Returns its records and bytes."""
    index: list[str] = []

    def write(out):
        store, path = file_system(source)
        with store.open_input_stream(path, compression=None) as stream:
            for header, block in records(chunks(stream)):
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                at = out.tell()
                out.write(squeeze.compress(header + END) + squeeze.compress(block) + squeeze.compress(END) + squeeze.flush())
                f = fields(header)
                index.append(f"{at}\t{out.tell() - at}\t{f.get('warc-type', '')}\t{f.get('warc-record-id', '')}\n")

    size = put_file(target, write)
    put_file(f"{target}.idx", lambda out: out.write("".join(index).encode()))
    return len(index), size


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise every archive of a folder, a task each; returns the stored manifest (path, n_records, bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # lists only
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column("path").to_pylist():
                to = f"{target}/{path.rsplit('/', 1)[1].removesuffix('.gz').removesuffix('.txt')}.warc.gz"
                count, size = normalise_file(path, to)
                yield pa.RecordBatch.from_pydict({"path": [to], "n_records": [count], "bytes": [size]})

    return stored(files.repartition(n, "path").mapInArrow(run, "path string, n_records bigint, bytes bigint"), "archives")


def read_archive(path: str):
    """(fields, payload) of each record, found by its index line and inflated alone."""
    store, p = file_system(path)
    with store.open_input_stream(f"{p}.idx", compression=None) as f:
        index = [x.split("\t") for x in f.read().decode().splitlines()]
    with store.open_input_file(p) as f:
        for at, length, _, _ in index:
            f.seek(int(at))
            header, _, block = zlib.decompress(f.read(int(length)), 31).partition(END)
            yield fields(header), block[: -len(END)].partition(END)[2]


def page_number(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and target_uri of every record of normalised archives."""

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for f, payload in read_archive(path):
                    kind = f["warc-type"]
                    whole = kind == "response"
                    digest = hashlib.sha1(payload).hexdigest() if whole else f["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((page_number(f.get("warc-record-id")), len(payload) if whole else None, digest, kind, page_number(f.get("warc-refers-to")), f.get("warc-target-uri")))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"
    found = stored(manifest.select("path").repartition(n, "path").mapInArrow(run, schema), "records")
    heads = found.where("refers_to is not null").select(F.col("refers_to").alias("head")).distinct()
    sizes = found.where("record_type = 'response'").join(heads, F.col("page_id") == F.col("head"), "left_semi")
    sizes = sizes.groupBy("page_id").agg(F.max("payload_bytes").alias("full")).withColumnRenamed("page_id", "of")
    both = found.join(sizes, found["refers_to"] == sizes["of"], "left")
    return both.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every page written to monolithic archives, normalised, and read back."""
    raw, whole = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), raw)
    return read(normalise(spark, raw, whole)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
