"""What the training-data operators share: shared storage, text rules, file access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, as a regular expression and as characters.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests, one machine) a folder under /tmp/checkpoints is set; elsewhere
    that would be each executor's own disk, so it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/kelvane/{label}-{uuid.uuid4().hex}"


#: Folders that stored() wrote and remove_stored() has not removed.
STORED: list[str] = []


def remove_stored(spark: SparkSession, keep: list[str]) -> None:
    """Delete what stored() wrote, but for the paths in keep. Only for a caller that reads no earlier result any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in [p for p in STORED if p not in keep]:
        path(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(p), True)
        STORED.remove(p)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that long texts fit a Python worker. A session's own smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else. All-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder on shared storage; works on executors and the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Sent:
    """An object of bounded size broadcast to executors, with its class, so workers need no copy of this package."""

    def __init__(self, spark: SparkSession, value: object):
        from pyspark import cloudpickle

        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        import pickle

        return pickle.loads(self._bytes.value)


def worker_cache(key: str, make):
    """What make() returns, kept for later tasks of the same Python worker. Functions travel by value, so a module's own names don't last."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault("_kelvane_worker_cache", ModuleType("_kelvane_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def put_file(uri: str, write) -> int:
    """Write a file whole or not at all: write(stream) fills a temporary name, then it is renamed.

    A retried or speculative task writes the same bytes under the same final name. Returns its length.
    """
    store, path = file_system(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(temporary, compression=None) as out:
        write(out)
        length = out.tell()
    store.move(temporary, path)
    return length
