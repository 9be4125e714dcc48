"""Tables that can be written: versioned Parquet folders with constraints, writes and an event log.

A table is a folder: folders of Parquet files, and _state with one numbered JSON text for each version:
its list of files and the metadata. The highest number is the current one. A new number is put in place by one
rename in Hadoop's file system, so a crash leaves the version before, and of two writers the later fails. An insert adds files;
an update, delete or upsert finds the files with affected rows and rewrites only these; keys
are checked by joining new rows with the key columns. Constraints are checked before the
new number is written. One writer at a time; readers see whole versions. vacuum() deletes what no current version reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """A write breaks a constraint."""


@dataclass
class Spec:
    """A table's columns (name -> SQL type) and rules."""

    columns: dict[str, str]
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    serial: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    #: name -> [column, parent table, parent column]; lists of columns if there are several
    foreign: dict[str, list] = field(default_factory=dict)
    dims: dict[str, int] = field(default_factory=dict)
    json_columns: list[str] = field(default_factory=list)
    enums: dict[str, list[str]] = field(default_factory=dict)
    primary: list[str] = field(default_factory=list)
    events: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in self.columns.items()])


class Store:
    """Tables under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # files

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        """Write a file whole under a name that must be new."""
        fs, temporary = self._fs(path), f"{path}.{uuid.uuid4().hex}"
        out = fs.create(self._path(temporary))
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(self._path(path)) or not fs.rename(self._path(temporary), self._path(path)):
            raise OSError(f"{path} can't be put in place: another writer was first")

    def _get(self, path: str) -> str | None:
        fs = self._fs(path)
        if not fs.exists(self._path(path)):
            return None
        stream = fs.open(self._path(path))
        text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        return text

    # metadata

    def _number(self, name: str) -> int:
        """The number of the latest state; 0 if there is none."""
        top = self._path(f"{self.folder}/{name}/_state")
        fs = self._fs(self.folder)
        found = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return max((int(n[:-5]) for n in found if n.endswith(".json")), default=0)

    def _latest(self, name: str) -> dict | None:
        """The current state; None if there is no such table or it was dropped."""
        number = self._number(name)
        state = json.loads(self._get(f"{self.folder}/{name}/_state/{number:012d}.json")) if number else None
        return None if state is None or state.get("gone") else state

    def _set_state(self, name: str, state: dict) -> None:
        number = self._number(name) + 1
        self._put(f"{self.folder}/{name}/_state/{number:012d}.json", json.dumps(state))

    def names(self) -> list[str]:
        fs, top = self._fs(self.folder), self._path(self.folder)
        found = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in found if not n.startswith("_") and self._latest(n) is not None)

    def _state(self, name: str) -> dict:
        state = self._latest(name)
        if state is None:
            raise KeyError(f"no table {name}")
        return state

    def spec(self, name: str) -> Spec:
        return Spec(**self._state(name)["spec"])

    def set_spec(self, name: str, spec: Spec) -> None:
        self._set_state(name, self._state(name) | {"spec": asdict(spec)})

    def create(self, name: str, spec: Spec, rows: DataFrame | None = None) -> None:
        if self._latest(name) is not None:
            raise ValueError(f"table {name} exists")
        files = [] if rows is None else self._write(name, 1, _coerced(rows, spec))
        self._set_state(name, {"version": 1, "serial": {}, "dropped": [], "files": files, "spec": asdict(spec)})

    def snapshot(self) -> dict[str, dict]:
        """The states of all tables, for restore()."""
        out: dict = {n: self._state(n) for n in self.names()}
        out[""] = {"head": self._log().head()}
        return out

    def restore(self, before: dict[str, dict]) -> None:
        """Every table as in a snapshot; later ones are dropped, later events removed."""
        for name in {*before, *self.names()} - {""}:
            now, old = self._latest(name), before.get(name)
            if now != old:
                self._set_state(name, old if old is not None else {"gone": True})
        self._log().forget_after(before[""]["head"])

    def vacuum(self) -> int:
        """Delete files that no current version reads, and what statements kept beside the tables. For when nothing reads earlier results. Returns the number of folders."""
        fs, gone = self._fs(self.folder), 0
        for table in fs.listStatus(self._path(self.folder)) if fs.exists(self._path(self.folder)) else []:
            name = table.getPath().getName()
            if name == "_work":
                gone += int(fs.delete(table.getPath(), True))
            elif not name.startswith("_"):
                state = self._latest(name)
                used = {f.split("/")[0] for f in state["files"]} if state else set()
                for x in fs.listStatus(table.getPath()):
                    if x.getPath().getName() not in used | {"_state"}:
                        gone += int(fs.delete(x.getPath(), True))
        return gone

    def _write(self, name: str, version: int, df: DataFrame) -> list[str]:
        """Write rows as files of a version; returns the files' names under the table's folder."""
        place = f"v{version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{name}/{place}")
        top = f"{self.folder}/{name}/{place}"
        found = [x.getPath().getName() for x in self._fs(top).listStatus(self._path(top))]
        return [f"{place}/{f}" for f in sorted(found) if f.endswith(".parquet")]

    def drop(self, name: str, if_exists: bool = False) -> None:
        """The table is gone; vacuum() deletes its files."""
        if self._latest(name) is None:
            if if_exists:
                return
            raise KeyError(f"no table {name}")
        self._set_state(name, {"gone": True})

    def add_column(self, name: str, column: str, kind: str, default=None) -> None:
        """Older rows read the default. Files are rewritten only for a default, or for the name of a dropped column."""
        spec, state = self.spec(name), self._state(name)
        if column in spec.columns:
            raise ValueError(f"column {column} exists")
        old = self.read(name)
        spec.columns[column] = kind
        if default is not None:
            spec.defaults[column] = default
        if default is not None or column in state["dropped"]:
            self._commit(name, keep=[], add=old.withColumn(column, F.lit(default).cast(kind)), spec=spec)
        else:
            self.set_spec(name, spec)

    def drop_column(self, name: str, column: str, if_exists: bool = False) -> None:
        """Metadata only: files keep the column, reads don't name it."""
        spec, state = self.spec(name), self._state(name)
        if column not in spec.columns:
            if if_exists:
                return
            raise KeyError(f"no column {column}")
        del spec.columns[column]
        spec.defaults.pop(column, None)
        spec.not_null = [c for c in spec.not_null if c != column]
        spec.unique = [u for u in spec.unique if column not in u]
        state |= {"dropped": sorted({*state["dropped"], column}), "spec": asdict(spec)}
        self._set_state(name, state)

    def read(self, name: str) -> DataFrame:
        """The current version."""
        state = self._state(name)
        return self._read(name, state["files"], Spec(**state["spec"]))

    def _read(self, name: str, files: list[str], spec: Spec) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], spec.schema())
        return self.spark.read.schema(spec.schema()).parquet(*[f"{self.folder}/{name}/{f}" for f in files])

    def _touched(self, name: str, rows) -> list[str]:
        """Files of the current version with rows that rows(df) leaves."""
        state = self._state(name)
        if not state["files"]:
            return []
        df = self._read(name, state["files"], Spec(**state["spec"]))
        df = rows(df.withColumn("_file", F.col("_metadata.file_path")))
        return sorted("/".join(r["_file"].split("/")[-2:]) for r in df.select("_file").distinct().collect())  # file names, as the pointer holds them

    def _commit(self, name: str, keep: list[str] | None = None, add: DataFrame | None = None, spec: Spec | None = None, serial: dict | None = None) -> None:
        """A new version: the kept files (None: all) and those of the added rows."""
        state = self._state(name)
        spec = spec or Spec(**state["spec"])
        version = state["version"] + 1
        files = list(state["files"] if keep is None else keep)
        if add is not None:
            files += self._write(name, version, add.select(*spec.columns))
        new = {"version": version, "serial": state["serial"] | (serial or {}), "files": files, "spec": asdict(spec)}
        self._set_state(name, state | new)

    # writes: each returns the affected rows

    # guard: called with the pairs (new, old) of a write before it commits, and may raise. hook: changes the pairs (_row, new, old) of BEFORE triggers

    def insert(
        self, name: str, rows: DataFrame, conflict: list[str] | None = None, update: dict[str, Column] | None = None, where: Column | None = None, nothing: bool = False,
        using: Column | None = None, guard=None, update_guard=None, hook=None,
    ) -> DataFrame:
        """Add rows (some of the columns). conflict names the key of an upsert: rows whose key exists update it (update:
        column -> expression over `old` and `new`) if where holds, or are left out if nothing. A null key never conflicts. Of rows with one key in one
        statement the later win, as if they had come one after another; for nothing the first. A row that is updated must meet `using`."""
        state, spec = self._state(name), self.spec(name)
        new, serial = _filled(rows, spec, state["serial"])
        new = self.keep(_coerced(new, spec), name)
        if hook:
            none = F.lit(None).cast(new.schema).alias("old")
            pairs = self.keep(new.select(F.monotonically_increasing_id().alias("_row"), F.struct(*new.columns).alias("new"), none), name)
            new = self.keep(_coerced(hook(pairs).select("new.*"), spec), name)
        self._check_rows(new, spec)
        old = self.read(name)
        if nothing and not conflict:
            conflict = spec.primary or (spec.unique[0] if spec.unique else None)
        if not conflict:
            self._check_unique(new, old, spec)
            self._check_foreign(new, spec)
            self._guarded(guard, new)
            self._commit(name, add=new, serial=serial)
            self._events(name, spec, "insert", None, new)
            return new
        whole = F.lit(True)
        for k in conflict:
            whole &= F.col(k).isNotNull()
        numbered = new.withColumn("_at", F.monotonically_increasing_id())
        pick = Window.partitionBy(*conflict).orderBy("_at" if nothing else F.desc("_at"))
        one = numbered.where(whole).withColumn("_k", F.row_number().over(pick)).where("_k = 1").drop("_k").unionByName(numbered.where(~whole)).drop("_at")
        one = self.keep(one, name)
        fresh = self.keep(one.alias("n").join(old.select(*conflict).alias("o"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in conflict], "left_anti"), name)
        files, changed_old, changed_new, added = None, None, None, fresh
        if not nothing:
            keys = one.select(*conflict).where(whole)
            touched = self._touched(name, lambda df: df.join(keys, conflict, "left_semi"))
            if touched:
                both = self._read(name, touched, spec).alias("old").join(one.alias("new"), [F.col(f"old.{k}") == F.col(f"new.{k}") for k in conflict], "left")
                hit = F.coalesce(F.col(f"new.{conflict[0]}").isNotNull() & (F.lit(True) if where is None else where), F.lit(False))
                columns = [F.when(hit, update[c]).otherwise(F.col(f"old.{c}")).cast(spec.columns[c]).alias(c) if c in update else F.col(f"old.{c}").alias(c) for c in spec.columns]
                marked = self.keep(both.select(*columns, hit.alias("_hit"), F.struct("old.*").alias("_old")), name)
                changed_new, changed_old = marked.where("_hit").select(*spec.columns), marked.where("_hit").select("_old.*")
                self._check_rows(changed_new, spec)
                if using is not None and changed_old.where(~F.coalesce(using, F.lit(False))).limit(1).count():
                    raise PermissionError(f"a row of {name} that conflicts is not the caller's to update")
                if update_guard:
                    update_guard(marked.where("_hit").select(F.struct(*spec.columns).alias("new"), F.col("_old").alias("old")))
                files = [f for f in self._state(name)["files"] if f not in set(touched)]
                added = marked.select(*spec.columns).unionByName(fresh)
        self._check_unique(added, self._read(name, files, spec) if files is not None else old, spec)
        self._check_foreign(one, spec)
        self._guarded(guard, fresh)
        self._commit(name, keep=files, add=added, serial=serial)
        self._events(name, spec, "insert", None, fresh)
        if changed_new is not None:
            self._events(name, spec, "update", changed_old, changed_new, spec.primary or conflict)
        return fresh if changed_new is None else fresh.unionByName(changed_new)

    @staticmethod
    def _guarded(guard, new: DataFrame) -> None:
        if guard:
            guard(new.select(F.struct(*new.columns).alias("new"), F.lit(None).cast(new.schema).alias("old")))

    def update(self, name: str, values: dict[str, Column], where: Column | None = None, guard=None, hook=None) -> DataFrame:
        """Set columns to expressions over the old row where the predicate is true."""
        spec = self.spec(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        touched = self._touched(name, lambda df: df.where(hit))
        old = self._read(name, touched, spec)
        marked = old.select(*[F.when(hit, v).otherwise(F.col(c)).cast(spec.columns[c]).alias(c) if (v := values.get(c)) is not None else F.col(c) for c in spec.columns], hit.alias("_hit"), F.struct("*").alias("_old"))
        marked = self.keep(marked, name)
        if hook:
            marked = self.keep(marked.withColumn("_row", F.monotonically_increasing_id()), name)
            made = hook(marked.where("_hit").select("_row", F.struct(*spec.columns).alias("new"), F.col("_old").alias("old")))
            made = _coerced(made.select("_row", "new.*"), Spec({"_row": "bigint"} | spec.columns)).select(F.col("_row").alias("_r"), F.struct(*spec.columns).alias("_made"))
            joined = marked.join(made, F.col("_row") == F.col("_r"), "left")
            took = F.col("_hit") & F.col("_r").isNotNull()
            marked = self.keep(joined.select(*[F.when(took, F.col("_made")[c]).when(F.col("_hit"), F.col("_old")[c]).otherwise(F.col(c)).alias(c) for c in spec.columns], took.alias("_hit"), "_old"), name)
        new, before = marked.where("_hit").select(*spec.columns), marked.where("_hit").select("_old.*")
        self._check_rows(new, spec)
        files = [f for f in self._state(name)["files"] if f not in set(touched)]
        after, rest = marked.select(*spec.columns), self._read(name, files, spec)
        self._check_unique(after, rest, spec, None if hook else set(values))
        self._check_foreign(new, spec)
        self._check_children(name, before, after, rest, set(spec.columns) if hook else set(values))
        if guard:
            guard(marked.where("_hit").select(F.struct(*spec.columns).alias("new"), F.col("_old").alias("old")))
        self._commit(name, keep=files, add=after)
        self._events(name, spec, "update", before, new, spec.primary)
        return new

    def delete(self, name: str, where: Column | None = None, guard=None, hook=None) -> DataFrame:
        """Rows for which the predicate is true go; unknown is not true."""
        spec = self.spec(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        touched = self._touched(name, lambda df: df.where(hit))
        old = self._read(name, touched, spec)
        files = [f for f in self._state(name)["files"] if f not in set(touched)]
        if hook:
            marked = self.keep(old.select("*", hit.alias("_hit"), F.monotonically_increasing_id().alias("_row")), name)
            none = F.lit(None).cast(old.schema).alias("new")
            agreed = hook(marked.where("_hit").select("_row", none, F.struct(*spec.columns).alias("old"))).select(F.col("_row").alias("_r"))
            marked = self.keep(marked.join(agreed, F.col("_row") == F.col("_r"), "left").withColumn("_hit", F.col("_hit") & F.col("_r").isNotNull()), name)
            gone, kept = marked.where("_hit").select(*spec.columns), marked.where("not _hit").select(*spec.columns)
        else:
            gone, kept = self.keep(old.where(hit), name), old.where(~hit)
        self._check_children(name, gone, kept, self._read(name, files, spec))
        if guard:
            guard(gone.select(F.lit(None).cast(gone.schema).alias("new"), F.struct(*spec.columns).alias("old")))
        self._commit(name, keep=files, add=kept)
        self._events(name, spec, "delete", gone, None)
        return gone

    def truncate(self, name: str) -> int:
        """Empty the table; returns the number of rows it had."""
        n = self.read(name).count()
        self._commit(name, keep=[])
        return n

    # constraints

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written beside the tables and read again, so that a plan over the old version doesn't outlive it."""
        path = f"{self.folder}/_work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _check_rows(self, rows: DataFrame, spec: Spec) -> None:
        bad = violations(rows, spec).first()
        if bad:
            raise ConstraintError(bad["rule"])

    def _check_unique(self, rows: DataFrame, rest: DataFrame, spec: Spec, changed: set[str] | None = None) -> None:
        """No key twice among rows, nor in rows and the rest, which is read for the key's columns alone. changed: only rules over these."""
        for u in spec.unique + ([spec.primary] if spec.primary else []):
            if changed is not None and not changed & set(u):
                continue
            clash = rest.select(*u).join(rows.select(*u), u, "left_semi")  # null components never match
            if duplicates(rows, u).limit(1).count() or clash.limit(1).count():
                raise ConstraintError(f"unique ({', '.join(u)})")

    def _check_foreign(self, rows: DataFrame, spec: Spec) -> None:
        for rule, (column, parent, key) in spec.foreign.items():
            if orphans(rows, column, self.read(parent), key).limit(1).count():
                raise ConstraintError(f"foreign key {rule}")

    def _log(self):
        from ..streaming.events import EventLog

        return EventLog(self.spark, f"{self.folder}/_events")

    def _check_children(self, name: str, before: DataFrame, after: DataFrame, rest: DataFrame, changed: set[str] | None = None) -> None:
        """RESTRICT: no child may lose its parent. before: old affected rows; after and rest: what stays; changed: only keys of these columns."""
        for other in self.names():
            for rule, (column, parent, key) in self.spec(other).foreign.items():
                columns, keys = _listed(column), _listed(key)
                if parent == name and (changed is None or set(keys) & changed):
                    lost = before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").join(rest.select(*keys), keys, "left_anti")
                    lost = lost.toDF(*[f"_lost{k}" for k in range(len(keys))])
                    same = [F.col(c) == F.col(f"_lost{k}") for k, c in enumerate(columns)]
                    if self.read(other).join(lost, same, "left_semi").limit(1).count():
                        raise ConstraintError(f"foreign key {rule} of {other}")

    # events

    def _events(self, name: str, spec: Spec, op: str, before: DataFrame | None, after: DataFrame | None, key: list[str] | None = None) -> None:
        if spec.events:
            self._log().capture(name, op, before, after, list(spec.columns), key)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; a null component takes a row out of the rule."""
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _listed(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def orphans(rows: DataFrame, column: str | list[str], parents: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose foreign key has no null and no parent."""
    columns, keys = _listed(column), _listed(key)
    p = parents.select(*[F.col(k).alias(f"_parent{j}") for j, k in enumerate(keys)]).distinct()
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.join(p, [F.col(c) == F.col(f"_parent{j}") for j, c in enumerate(columns)], "left_anti")


def violations(rows: DataFrame, spec: Spec) -> DataFrame:
    """Rows that break a not-null, check, enum, dimension or JSON rule, with the rule's name. A check that is unknown
    because a comparison meets null fails, as comparisons are two-valued there; a check on a null value alone passes."""
    rules = [(F.col(c).isNull(), f"not null {c}") for c in dict.fromkeys([*spec.not_null, *spec.primary])]
    rules += [(~F.coalesce(F.expr(sql), F.lit(False)), f"check {n}") for n, sql in spec.checks.items()]
    rules += [(F.col(c).isNotNull() & ~F.col(c).isin(*v), f"enum {c}") for c, v in spec.enums.items()]
    rules += [(F.col(c).isNotNull() & (F.size(c) != d), f"dimension {c}") for c, d in spec.dims.items()]
    rules += [(F.col(c).isNotNull() & F.try_parse_json(F.col(c)).isNull(), f"json {c}") for c in spec.json_columns]
    if not rules:
        return rows.withColumn("rule", F.lit("")).limit(0)
    verdict = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])
    return rows.withColumn("rule", verdict).where("rule is not null")


def _filled(rows: DataFrame, spec: Spec, serial: dict) -> tuple[DataFrame, dict]:
    """All columns: missing ones null, then serials, then defaults for every null. Also the serials' next numbers."""
    unknown = [c for c in rows.columns if c not in spec.columns]
    if unknown:
        raise KeyError(f"no column {unknown[0]}")
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in spec.columns.items()])
    after = {}
    for c in spec.serial:
        base = serial.get(c, 1)
        at = F.row_number().over(Window.partitionBy(F.col(c).isNull()).orderBy(F.monotonically_increasing_id()))
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(base - 1) + at))
        after[c] = base + (rows.agg(F.max(c)).first()[0] or 0) - base + 1
    for c, v in spec.defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(spec.columns[c])))
    return rows, after


def _coerced(rows: DataFrame, spec: Spec) -> DataFrame:
    from ..functions.exprs import exact_decimal

    out = []
    for c, k in spec.columns.items():
        kind = T._parse_datatype_string(k)
        out.append((exact_decimal(F.col(c), kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else F.col(c).cast(k)).alias(c))
    return rows.select(*out)
