"""The change-event log: capture, offsets, formats, delivery and apply.

The log is a folder of Parquet files of EVENTS rows, appended in order of seq. Consumers'
offsets are one small table. Batch readers filter by seq, which Parquet statistics prune;
streaming readers use a file stream.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "seq bigint, xid string, table_name string, op string, before string, after string, ts_ms bigint"
OFFSETS = "consumer string, `offset` bigint"
OPS = ("insert", "update", "delete")


class EventLog:
    """Events and consumers' offsets under one folder. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # storage

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, kind: str) -> str | None:
        """The latest numbered folder of a kind (log, offsets): kind-N. A replacement is written whole under the next number."""
        top, fs = self._fs()
        found = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        numbers = [int(n.split("-")[1]) for n in found if n.startswith(f"{kind}-") and n.split("-")[1].isdigit()]
        return f"{self.folder}/{kind}-{max(numbers)}" if numbers else None

    def _replace(self, df: DataFrame, kind: str) -> None:
        """Write df beside the current folder, then put it in place by one rename to the next number; the one before stays for its readers until the next time."""
        top, fs = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        now = self._folder(kind)
        number = int(now.rsplit("-", 1)[1]) + 1 if now else 1
        temporary = f"{self.folder}/new-{kind}.{uuid.uuid4().hex}"
        df.write.parquet(temporary)
        if not fs.rename(path(temporary), path(f"{self.folder}/{kind}-{number}")):
            raise OSError(f"{kind} can't be put in place")
        if number > 2:
            fs.delete(path(f"{self.folder}/{kind}-{number - 2}"), True)

    def events(self) -> DataFrame:
        path = self._folder("log")
        return self.spark.read.schema(EVENTS).parquet(path) if path else self.spark.createDataFrame([], EVENTS)

    def offsets(self) -> DataFrame:
        path = self._folder("offsets")
        return self.spark.read.schema(OFFSETS).parquet(path) if path else self.spark.createDataFrame([], OFFSETS)

    # capture

    def head(self) -> int:
        """The largest seq; 0 for an empty log."""
        return max(self.events().agg(F.max("seq")).first()[0] or 0, self._floor())

    def _floor(self) -> int:
        return self.offsets().agg(F.max("offset")).first()[0] or 0

    def capture(self, table: str, op: str, before: DataFrame | None, after: DataFrame | None, columns: list[str], key: list[str] | None = None) -> None:
        """Append one event a row. before and after meet on key for an update."""
        image = lambda df, name: df.select(*[F.col(c) for c in key or []], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))
        if op == "update" and key:
            rows = image(after, "after").join(image(before, "before"), key, "left").select("before", "after")
        elif op == "update":
            rows = after.select(F.lit(None).cast("string").alias("before"), F.to_json(F.struct(*columns)).alias("after"))
        elif op == "insert":
            rows = after.select(F.lit(None).cast("string").alias("before"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("after"))
        else:
            rows = before.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("before"), F.lit(None).cast("string").alias("after"))
        self.append(rows, table, op)

    def append(self, rows: DataFrame, table: str, op: str, xid: str | None = None) -> None:
        """Append rows (before, after) with the next seq numbers: partition counts first, then places in partitions."""
        path = f"{self.folder}/work-{uuid.uuid4().hex}"
        rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
        rows = self.spark.read.parquet(path)
        parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        base = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
        numbered = rows.withColumn("_n", place).join(F.broadcast(base), F.col("_part") == F.col("_p"))
        seq = F.lit(self.head()) + F.col("_base") + F.col("_n")
        now = int(time.time() * 1000)
        out = numbered.select(seq.cast("long").alias("seq"), F.lit(xid or uuid.uuid4().hex).alias("xid"), F.lit(table).alias("table_name"), F.lit(op).alias("op"), "before", "after", F.lit(now).cast("long").alias("ts_ms"))
        out.sortWithinPartitions("seq").write.mode("append").parquet(self._folder("log") or f"{self.folder}/log-1")

    # consumption

    def poll(self, consumer: str, limit: int) -> DataFrame:
        """Events after the consumer's offset (unknown: 0), ascending, at most limit. Reads only: until ack they come again."""
        row = self.offsets().where(F.col("consumer") == consumer).first()
        return poll_after(self.events(), row["offset"] if row else 0, limit)

    def ack(self, consumer: str, seq: int) -> None:
        """Set the consumer's offset; registers the consumer."""
        rest = [(r["consumer"], r["offset"]) for r in self.offsets().where(F.col("consumer") != consumer).collect()]  # one row a consumer
        self._replace(self.spark.createDataFrame([*rest, (consumer, seq)], OFFSETS).coalesce(1), "offsets")

    def vacuum(self) -> int:
        """Drop events that every consumer has acknowledged; without consumers nothing. Returns their number."""
        least = self.offsets().agg(F.min("offset")).first()[0]
        if least is None:
            return 0
        old = self.events()
        gone = old.where(F.col("seq") <= least).count()
        if gone:
            self._replace(old.where(F.col("seq") > least), "log")
        return gone

    def forget_after(self, seq: int) -> None:
        """Remove events after seq: those of a transaction that failed."""
        if self.head() > seq:
            self._replace(self.events().where(F.col("seq") <= seq), "log")

    def lag(self) -> DataFrame:
        return lag(self.offsets(), self.events())

    def stream(self, max_files: int = 1000) -> DataFrame:
        """A streaming read of the log; its checkpoint is the offset."""
        return self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(self._folder("log") or f"{self.folder}/log-1")


def poll_after(events: DataFrame, seq: int, limit: int) -> DataFrame:
    """Events after seq, ascending, at most limit."""
    return events.where(F.col("seq") > seq).orderBy("seq").limit(limit)


def subscribe(log: EventLog, consumer: str | None = None, from_seq: int | None = None, table: str | None = None, limit: int = 100, kind: str = "native") -> DataFrame:
    """The next events for a subscriber, formatted, ascending: after a durable consumer's offset, else after from_seq, else after what there is now.

    Reads only; a durable consumer acknowledges the last seq it has handled.
    """
    if consumer is not None:
        row = log.offsets().where(F.col("consumer") == consumer).first()
        start = row["offset"] if row else from_seq or 0
    else:
        start = log.head() if from_seq is None else from_seq
    rows = log.events() if table is None else log.events().where(F.col("table_name") == table)
    return formatted(poll_after(rows, start, limit), kind).orderBy("seq")


def lag(offsets: DataFrame, events: DataFrame, now_ms: int | None = None) -> DataFrame:
    """consumer, offset, max_seq, lag_events, oldest_ts_ms of what is unread, and lag_seconds if now_ms is given; by consumer."""
    top = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))
    # events fall into the intervals between offsets; an interval's oldest event is unread by every consumer whose offset lies before it
    cuts = offsets.agg(F.sort_array(F.collect_set("offset")).alias("cuts"))  # a number a consumer
    placed = events.select("seq", "ts_ms").crossJoin(cuts).select(F.size(F.filter("cuts", lambda x: x < F.col("seq"))).alias("interval"), "ts_ms")
    first = placed.groupBy("interval").agg(F.min("ts_ms").alias("ts_ms"))
    own = offsets.crossJoin(cuts).select("consumer", F.array_position("cuts", F.col("offset")).alias("own"))
    oldest = own.join(first, F.col("interval") >= F.col("own")).groupBy("consumer").agg(F.min("ts_ms").alias("oldest_ts_ms"))
    out = offsets.crossJoin(top).join(oldest, "consumer", "left")
    out = out.withColumn("lag_events", F.greatest(F.lit(0), F.col("max_seq") - F.col("offset")))
    out = out.select("consumer", "offset", "max_seq", "lag_events", "oldest_ts_ms")
    if now_ms is not None:
        out = out.withColumn("lag_seconds", (F.lit(now_ms) - F.col("oldest_ts_ms")) / 1000)
    return out.orderBy("consumer")


def formatted(events: DataFrame, kind: str = "native") -> DataFrame:
    """seq and the event as JSON: native, debezium or supabase; another kind is native."""
    payload = F.coalesce(F.col("after"), F.col("before"))
    raw = lambda c: F.try_parse_json(c)
    if kind == "debezium":
        code = F.when(F.col("op") == "insert", "c").when(F.col("op") == "update", "u").otherwise("d")
        source = F.struct(F.col("seq"), F.col("xid").alias("txId"), F.col("table_name").alias("table"))
        body = F.struct(F.struct(raw("before").alias("before"), raw("after").alias("after"), code.alias("op"), F.col("ts_ms"), source.alias("source")).alias("payload"))
    elif kind == "supabase":
        body = F.struct(F.upper("op").alias("type"), F.col("table_name").alias("table"), F.lit("public").alias("schema"), raw("after").alias("record"), raw("before").alias("old_record"), F.col("ts_ms").alias("commit_timestamp_ms"))
    else:
        source = F.struct(F.col("seq"), F.col("xid").alias("txId"), F.col("table_name").alias("table"), F.lit("public").alias("schema"))
        body = F.struct(F.col("op"), raw(payload).alias("payload"), raw("before").alias("before"), raw("after").alias("after"), F.col("ts_ms"), source.alias("source"))
    return events.select("seq", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def projected(image: str, columns: list[str]) -> Column:
    """An image with only the named members."""
    return F.to_json(F.map_filter(F.from_json(F.col(image), "map<string,string>"), lambda k, v: k.isin(*columns)))


def visible(events: DataFrame, policies: dict[str, tuple[str, list[str] | None]]) -> DataFrame:
    """Events a subscriber may see. policies: table -> (predicate in SQL over `img`, a map of the image, columns or None for all).

    The image is AFTER for insert and update, BEFORE for delete. Tables without a policy show nothing.
    """
    image = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
    rows = events.withColumn("img", F.from_json(image, "map<string,string>"))
    allowed = F.lit(False)
    for name, (predicate, _) in policies.items():
        allowed = F.when(F.col("table_name") == name, F.coalesce(F.expr(predicate), F.lit(False))).otherwise(allowed)
    rows = rows.where(allowed)
    for side in ("before", "after"):
        cut = F.col(side)
        for name, (_, columns) in policies.items():
            if columns is not None:
                cut = F.when(F.col("table_name") == name, projected(side, columns)).otherwise(cut)
        rows = rows.withColumn(side, cut)
    return rows.drop("img")


@dataclass
class Route:
    """A sink with its filter: tables and ops (empty: all), columns (None: all)."""

    name: str
    sink: Callable[[list[dict]], None]
    tables: list[str] = field(default_factory=list)
    ops: list[str] = field(default_factory=list)
    columns: list[str] | None = None

    def select(self, events: DataFrame) -> DataFrame:
        if self.tables:
            events = events.where(F.col("table_name").isin(*self.tables))
        if self.ops:
            events = events.where(F.col("op").isin(*self.ops))
        if self.columns is not None:
            for side in ("before", "after"):
                events = events.withColumn(side, projected(side, self.columns))
        return events


def dispatch(log: EventLog, route: Route, limit: int = 100, attempts: int = 3, wait: float = 0.05, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One cycle: poll, filter, deliver with retries, dead-letter what fails, then acknowledge. At least once."""
    batch = log.poll(route.name, limit)
    rows = [r.asDict() for r in route.select(batch).orderBy("seq").collect()]  # at most limit
    last = batch.agg(F.max("seq")).first()[0]
    dead = []
    for row in rows:
        for k in range(attempts):
            try:
                route.sink([row])
                break
            except Exception as e:  # a sink may raise anything; the event must not be lost
                if k + 1 == attempts:
                    dead.append((row["seq"], route.name, json.dumps(row, default=str), str(e), attempts))
                else:
                    sleep(wait * 2**k)
    if dead:
        schema = "seq bigint, consumer string, event string, error string, attempts int"
        log.spark.createDataFrame(dead, schema).write.mode("append").parquet(f"{log.folder}/dead")
    if last is not None:
        log.ack(route.name, last)
    return {"polled": 0 if last is None else len(rows), "dead": len(dead), "acked": last}


def webhook_targets(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """seq and url of every delivery; hooks: url, table (or *), ops (array; empty: all)."""
    ops = F.when(F.size("ops") == 0, F.array(*[F.lit(o) for o in OPS])).otherwise(F.col("ops"))
    h = hooks.select("url", F.col("table").alias("_table"), F.explode(F.array_distinct(ops)).alias("_op"))
    same = F.col("_op") == F.col("op")
    named = events.join(h.where("_table <> '*'"), same & (F.col("_table") == F.col("table_name")))
    return named.select("seq", "url").unionAll(events.join(h.where("_table = '*'"), same).select("seq", "url"))


def signature(secret: str, body: str) -> str:
    """The HMAC-SHA256 of a delivery's body, in hexadecimal."""
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def latest(events: DataFrame, key: Column) -> DataFrame:
    """The last event of each key."""
    last = F.max_by(F.struct(*events.columns), F.col("seq"))
    return events.groupBy(key.alias("_key")).agg(last.alias("_e")).select("_e.*")


def apply_changes(target: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """target after all events of its table: inserts and updates put the after image, deletes remove the key."""
    schema = target.schema
    image = F.coalesce(F.col("after"), F.col("before"))
    rows = events.withColumn("_key", F.get_json_object(image, f"$.{key}"))
    # an update that changes the key also removes the old one
    moved = rows.where((F.col("op") == "update") & F.col("before").isNotNull()).withColumn("_key", F.get_json_object("before", f"$.{key}")).withColumn("after", F.lit(None).cast("string"))
    moved = moved.withColumn("seq", F.col("seq") - F.lit(0.5))
    both = rows.withColumn("seq", F.col("seq").cast("double")).unionByName(moved)
    last = both.groupBy("_key").agg(F.max_by(F.struct("op", "after"), "seq").alias("e"))
    kept = target.join(last.select("_key"), F.col(key).cast("string") == F.col("_key"), "left_anti")
    put = last.where("e.op <> 'delete' and e.after is not null").select(F.from_json("e.after", schema).alias("r")).select("r.*")
    return kept.unionByName(put)


def apply_stream(source: DataFrame, path: str, key: str, checkpoint: str):
    """Apply a stream of events to a Parquet table, a version a batch: path/v=N with the batch's number. Returns the query."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = spark.read.parquet(f"{path}/v={number - 1}")
        apply_changes(before, df, key).write.mode("overwrite").parquet(f"{path}/v={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str = "seq", time_column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark's delay, as at-least-once delivery requires."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key])


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All of a finite stream's output, written as Parquet under folder and read back; nothing is gathered in the driver.

    In complete mode each batch holds the whole result, and the last one counts.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark, schema = stream.sparkSession, stream.schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path)) if fs.exists(path) else []
    if not numbers:
        return spark.createDataFrame([], schema)
    chosen = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(schema).parquet(*[f"{folder}/out/batch={k}" for k in chosen])
