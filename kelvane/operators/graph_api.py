"""The graph-shaped data API: text with nested fields over tables, foreign keys, edges and vectors, and mutations.

Every read and write is a statement of the engine for the caller's principal, so grants and policies hold as for SQL.
A root field becomes one DataFrame; a forward relation is a struct or null, a reverse one and `edges` are arrays.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dialect import literal
from .resource import BadRequest, ForeignKey, arguments, condition, ordered

WORD = re.compile(r'[\s,]*(?:#[^\n]*[\s,]*)*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\$?[A-Za-z_]\w*|[{}()\[\]:!=]|$)')
EDGE = "struct<from_id:bigint,to_id:bigint,edge_type:string,props:string>"


@dataclass
class Field:
    """name(args) { fields } under an alias."""

    name: str
    alias: str
    args: dict[str, object] = field(default_factory=dict)
    fields: list[Field] = field(default_factory=list)


class Parser:
    """`query { ... }`, `mutation { ... }` or `{ ... }`, with variables."""

    def __init__(self, text: str, variables: dict | None = None):
        self.words, at = [], 0
        while True:
            m = WORD.match(text, at)
            if m is None:
                raise BadRequest(f"not understood: {text[at : at + 30]!r}")
            at = m.end()
            if not m[1]:
                break
            self.words.append(m[1])
        self.at, self.variables = 0, variables or {}

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def take(self, word: str | None = None) -> str:
        found = self.peek()
        if not found or word is not None and found != word:
            raise BadRequest(f"{word or 'more'} expected, found {found or 'the end'}")
        self.at += 1
        return found

    def document(self) -> tuple[str, list[Field]]:
        kind = "query"
        if self.peek() in ("query", "mutation"):
            kind = self.take()
            if self.peek() not in ("{", "("):
                self.take()
            if self.peek() == "(":
                while self.take() != ")":
                    pass
        return kind, self.fields()

    def fields(self) -> list[Field]:
        out = []
        self.take("{")
        while self.peek() != "}":
            name = alias = self.take()
            if not re.fullmatch(r"[A-Za-z_]\w*", name):
                raise BadRequest(f"not a field: {name}")
            if self.peek() == ":":
                self.take()
                name = self.take()
            f = Field(name, alias)
            if self.peek() == "(":
                self.take()
                while self.peek() != ")":
                    key = self.take()
                    self.take(":")
                    f.args[key] = self.value()
                self.take()
            if self.peek() == "{":
                f.fields = self.fields()
            out.append(f)
        self.take()
        return out

    def value(self) -> object:
        word = self.take()
        if word == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
            self.take()
            return out
        if word == "{":
            found = {}
            while self.peek() != "}":
                key = self.take()
                self.take(":")
                found[key.strip('"')] = self.value()
            self.take()
            return found
        if word.startswith("$"):
            if word[1:] not in self.variables:
                raise BadRequest(f"variable {word} has no value")
            return self.variables[word[1:]]
        if word in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word]
        return json.loads(word) if word[0] in '"-0123456789' else word


@dataclass
class GraphApi:
    """keys: the foreign keys that relation fields follow; edges: the name of the relation of edges."""

    engine: object
    keys: list[ForeignKey] = field(default_factory=list)
    edges: str = "edges"

    def run(self, text: str, variables: dict | None = None, principal=None) -> dict[str, DataFrame]:
        """A DataFrame for each root field, by alias."""
        kind, fields = Parser(text, variables).document()
        return {f.alias: (self._mutation if kind == "mutation" else self._root)(f, principal) for f in fields}

    # reads

    def _rows(self, table: str, principal) -> DataFrame:
        if table not in self.engine.names():
            raise BadRequest(f"no field {table}")
        return self.engine.sql(f"SELECT * FROM `{table}`", principal=principal)

    def _root(self, f: Field, principal) -> DataFrame:
        if f.name.startswith("near_"):
            return self._near(f, principal)
        return self._selected(f.name, self._page(self._rows(f.name, principal), f.args), f.fields, principal)

    @staticmethod
    def _filtered(df: DataFrame, args: dict) -> DataFrame:
        for column, raw in arguments(df, {k: v for k, v in args.items() if k not in ("orderBy", "limit", "offset")}).items():
            column = column.rstrip("\0")
            df = df.where(F.col(column).isNotNull()) if raw == "not.null" else df.where(condition(df, column, raw))
        return df

    def _page(self, df: DataFrame, args: dict) -> DataFrame:
        df = ordered(self._filtered(df, args), args.get("orderBy"))
        df = df.offset(int(args["offset"])) if args.get("offset") else df
        return df.limit(int(args["limit"])) if args.get("limit") is not None else df

    def _near(self, f: Field, principal) -> DataFrame:
        """near_<table>(vector, k), or near_<table>_<column> where a table has several vectors."""
        for table in sorted(self.engine.names(), key=len, reverse=True):
            rest = f.name.removeprefix(f"near_{table}")
            if rest != f.name and (not rest or rest.startswith("_")):
                break
        else:
            raise BadRequest(f"no field {f.name}")
        vectors = [x.name for x in self.engine.relation(table).schema.fields if x.dataType.simpleString() in ("array<float>", "array<double>")]
        column = rest[1:] or (vectors[0] if len(vectors) == 1 else "")
        if column not in vectors:
            raise BadRequest(f"no field {f.name}")
        vector, k = f.args.get("vector"), f.args.get("k")
        if not isinstance(vector, list) or not vector or any(isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or abs(x) == float("inf") for x in vector):
            raise BadRequest("vector is a list of finite numbers")
        if not isinstance(k, int) or k < 0:
            raise BadRequest("k is a number of at least 0")
        df = self.engine.sql(f"SELECT * FROM `{table}` WHERE NEAR({column}, $1, {k})", [vector], principal)
        return self._selected(table, df, f.fields, principal)

    def _selected(self, table: str, df: DataFrame, fields: list[Field], principal, lead: list[str] = ()) -> DataFrame:
        """The asked fields of df's rows, after the columns in lead."""
        if not fields:
            raise BadRequest(f"{table} needs fields")
        out = [F.col(c) for c in lead]
        for n, f in enumerate(fields):
            if f.name in df.columns:
                out.append(F.col(f"`{f.name}`").alias(f.alias))
                continue
            name = f"_f{n}"
            df = self._edges(table, df, f, name, principal) if f.name == "edges" else self._related(table, df, f, name, principal)
            out.append(F.col(name).alias(f.alias))
        return df.select(*out)

    def _related(self, table: str, df: DataFrame, f: Field, name: str, principal) -> DataFrame:
        from .resource import relation

        key, forward = relation(self.keys, table, f.name)
        other, mine, theirs = (key.parent, key.column, key.key) if forward else (key.child, key.key, key.column)
        rows = self._filtered(self._rows(other, principal), f.args).withColumn("_k", F.col(theirs))
        if forward:
            side = self._selected(other, rows, f.fields, principal, ["_k"])
            side = side.select(F.col("_k").alias(f"{name}_k"), F.struct(*[c for c in side.columns if c != "_k"]).alias(name))
            return df.join(side, F.col(mine) == F.col(f"{name}_k"), "left").drop(f"{name}_k")
        order, _, way = (f.args.get("orderBy") or "").partition(".")
        if order and (order not in rows.columns or way not in ("", "asc", "desc")):
            raise BadRequest(f"unknown order {f.args['orderBy']}")
        by = F.col(order or "_k").desc() if way == "desc" else F.col(order or "_k").asc()
        first, most = int(f.args.get("offset") or 0), f.args.get("limit")
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_k").orderBy(by)))
        rows = rows.where((F.col("_at") > first) & (F.lit(True) if most is None else F.col("_at") <= first + int(most)))
        side = self._selected(other, rows, f.fields, principal, ["_k", "_at"])
        item = F.struct("_at", F.struct(*[c for c in side.columns if c not in ("_k", "_at")]).alias("r"))
        side = side.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["r"]).alias(name)).withColumnRenamed("_k", f"{name}_k")
        empty = F.array().cast(side.schema[name].dataType)
        return df.join(side, F.col(mine) == F.col(f"{name}_k"), "left").withColumn(name, F.coalesce(F.col(name), empty)).drop(f"{name}_k")

    def _edges(self, table: str, df: DataFrame, f: Field, name: str, principal) -> DataFrame:
        """edges(type, direction) of rows of a table with one integer key."""
        spec = None if table in self.engine.others else self.engine.store.spec(table)
        primary = spec.primary if spec else [c for c in df.columns[:1]]
        if len(primary) != 1:
            raise BadRequest(f"{table} has no edges")
        end = "to_id" if f.args.get("direction") == "IN" else "from_id"
        rows = self._rows(self.edges, principal)
        if f.args.get("type") is not None:
            rows = rows.where(F.col("edge_type") == F.lit(f.args["type"]))
        unknown = [x.name for x in f.fields if x.name not in ("from_id", "to_id", "edge_type", "props")]
        if unknown or not f.fields:
            raise BadRequest(f"edges have no field {', '.join(unknown) or '(none asked)'}")
        item = F.struct(*[F.col(x.name).alias(x.alias) for x in f.fields])
        side = rows.groupBy(F.col(end).alias(f"{name}_k")).agg(F.sort_array(F.collect_list(item)).alias(name))
        empty = F.array().cast(side.schema[name].dataType)
        return df.join(side, F.col(primary[0]) == F.col(f"{name}_k"), "left").withColumn(name, F.coalesce(F.col(name), empty)).drop(f"{name}_k")

    # mutations

    def _mutation(self, f: Field, principal) -> DataFrame:
        """insert_<t>(values), update_<t>(set, filters) and delete_<t>(filters); the fields are those of the affected rows."""
        verb, _, table = f.name.partition("_")
        if verb not in ("insert", "update", "delete") or table not in self.engine.store.names():
            raise BadRequest(f"no field {f.name}")
        spec = self.engine.store.spec(table)
        plain = {x.name for x in f.fields if x.name in spec.columns}
        relations = [x for x in f.fields if x.name not in spec.columns]
        needed = list(spec.columns) if relations else [c for c in spec.columns if c in plain]
        if not needed:
            raise BadRequest(f"{f.name} needs fields")
        given = f.args.get({"insert": "values", "update": "set"}.get(verb, ""), {})
        unknown = [c for c in given if c not in spec.columns]
        if unknown or verb != "delete" and not given:
            raise BadRequest(f"unknown column {unknown[0]}" if unknown else f"{f.name} needs at least one column")
        if verb == "insert":
            text = f"INSERT INTO {table} ({', '.join(given)}) VALUES ({', '.join(map(literal, given.values()))})"
        else:
            filters = self._where(table, {k: v for k, v in f.args.items() if k != "set"})
            head = "UPDATE {} SET {}".format(table, ", ".join(f"{c} = {literal(v)}" for c, v in given.items())) if verb == "update" else f"DELETE FROM {table}"
            text = head + (f" WHERE {filters}" if filters else "")
        rows = self.engine.sql(f"{text} RETURNING {', '.join(needed)}", principal=principal)
        return self._selected(table, rows, f.fields, principal)

    def _where(self, table: str, args: dict) -> str:
        """Filter arguments as SQL text."""
        marks, parts = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "like": "LIKE", "ilike": "ILIKE"}, []
        df = self.engine.store.read(table)
        for name, value in args.items():
            column, raw = next(iter(arguments(df, {name: value}).items()))
            op = raw.partition(".")[0]
            if op in ("is", "not"):
                parts.append(f"{column} IS {'NULL' if op == 'is' else 'NOT NULL'}")
            elif op == "in":
                parts.append(f"{column} IN ({', '.join(map(literal, value)) or 'NULL'})")
            else:
                parts.append(f"{column} {marks[op]} {literal(value)}")
        return " AND ".join(parts)
