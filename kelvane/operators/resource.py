"""The data API as DataFrame rewrites: filters, selection, order, embedding by foreign keys, counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import like

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "like", "ilike", "in", "is")
SUFFIXES = {"_neq": "neq", "_gte": "gte", "_gt": "gt", "_lte": "lte", "_lt": "lt", "_ilike": "ilike", "_like": "like", "_in": "in", "_is_null": "is"}


class BadRequest(ValueError):
    """A request that names an unknown column, operator or relation."""


def condition(df: DataFrame, column: str, raw: str) -> Column:
    """One filter `column=op.value`."""
    if column not in df.columns:
        raise BadRequest(f"unknown column {column}")
    op, dot, value = raw.partition(".")
    if not dot or op not in OPS:
        raise BadRequest(f"unknown operator in {raw!r}")
    c, kind = F.col(column), df.schema[column].dataType
    cast = lambda v: F.lit(v).cast(kind)
    if op == "is":
        if value not in ("null", "true", "false"):
            raise BadRequest(f"is takes null, true or false, not {value}")
        return c.isNull() if value == "null" else c == F.lit(value == "true")
    if op == "in":
        if not re.fullmatch(r"\(.*\)", value, re.S):
            raise BadRequest("in takes (a,b,...)")
        return c.isin(*[cast(v.strip()) for v in value[1:-1].split(",") if v.strip()]) if value[1:-1].strip() else F.lit(False)
    if op in ("like", "ilike"):
        return like(c.cast("string"), value, op == "ilike")
    return {"eq": c == cast(value), "neq": c != cast(value), "gt": c > cast(value), "gte": c >= cast(value), "lt": c < cast(value), "lte": c <= cast(value)}[op]


def filtered(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that meet all filters."""
    for column, raw in filters.items():
        df = df.where(condition(df, column, raw))
    return df


def ordered(df: DataFrame, order: str | None) -> DataFrame:
    """`a.asc,b.desc`."""
    keys = []
    for part in (order or "").split(","):
        if part.strip():
            column, _, way = part.strip().partition(".")
            if column not in df.columns or way not in ("", "asc", "desc"):
                raise BadRequest(f"unknown order {part}")
            keys.append(F.col(column).desc() if way == "desc" else F.col(column).asc())
    return df.orderBy(*keys) if keys else df


@dataclass
class ForeignKey:
    """child.column refers to parent.key."""

    child: str
    column: str
    parent: str
    key: str


def parse_select(text: str) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Plain columns and embedded (name, columns) of `id,customer(id,name)`."""
    plain, embedded = [], []
    for m in re.finditer(r"\s*([\w*]+)\s*(?:\(([^()]*)\))?\s*(?:,|$)", text):
        if m[2] is None:
            plain.append(m[1])
        else:
            embedded.append((m[1], [x.strip() for x in m[2].split(",") if x.strip()] or ["*"]))
    return plain, embedded


def relation(keys: list[ForeignKey], base: str, name: str) -> tuple[ForeignKey, bool]:
    """The foreign key that an embedded name means, and whether it is forward. The name is a table, the key's column, or that without _id."""
    forward = [k for k in keys if k.child == base and name in (k.parent, k.column, k.column.removesuffix("_id"))]
    reverse = [k for k in keys if k.parent == base and name == k.child]
    found = [(k, True) for k in forward] + [(k, False) for k in reverse]
    if len(found) != 1:
        raise BadRequest(f"{name} is {'ambiguous' if found else 'no relation'} of {base}")
    return found[0]


def collection(
    tables: dict[str, DataFrame],
    base: str,
    keys: list[ForeignKey] | None = None,
    select: str = "*",
    filters: dict[str, str] | None = None,
    order: str | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """A table read: filters, selection with embedding, order, page. A forward relation is a struct or null, a reverse one an array.

    Filters and orders `name.column` are those of an embedded relation; they apply before it is joined.
    """
    filters = filters or {}
    df = filtered(tables[base], {k: v for k, v in filters.items() if "." not in k})
    df = ordered(df, ",".join(p for p in (order or "").split(",") if p.count(".") < 2 and p.partition(".")[0] in tables[base].columns) or None)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    plain, embedded = parse_select(select)
    plain = list(dict.fromkeys(x for c in plain or (["*"] if not embedded else []) for x in (df.columns if c == "*" else [c])))
    unknown = [c for c in plain if c not in df.columns]
    if unknown:
        raise BadRequest(f"unknown column {unknown[0]}")
    out = list(plain)
    for name, columns in embedded:
        key, forward = relation(keys or [], base, name)
        other = filtered(tables[key.parent if forward else key.child], {k.split(".", 1)[1]: v for k, v in filters.items() if k.startswith(name + ".")})
        columns = [x for c in columns for x in (other.columns if c == "*" else [c])]
        if [c for c in columns if c not in other.columns]:
            raise BadRequest(f"unknown column in {name}")
        sort = [p.removeprefix(name + ".") for p in (order or "").split(",") if p.startswith(name + ".")]
        if forward:
            side = other.select(F.col(key.key).alias("_k"), F.struct(*columns).alias(name))
            df = df.join(side, F.col(key.column) == F.col("_k"), "left").drop("_k")
        else:
            sort_column, _, way = (sort[0] if sort else "").partition(".")
            lead = [F.col(sort_column).alias("_o")] if sort_column else []
            items = F.sort_array(F.collect_list(F.struct(*lead, *columns)), way != "desc")
            if lead:
                items = F.transform(items, lambda s: F.struct(*[s[c].alias(c) for c in columns]))
            side = other.groupBy(F.col(key.column).alias("_k")).agg(items.alias(name))
            empty = F.array().cast(side.schema[name].dataType)
            df = df.join(side, F.col(key.key) == F.col("_k"), "left").withColumn(name, F.coalesce(F.col(name), empty)).drop("_k")
        out.append(name)
    return df.select(*out)


def content_range(df: DataFrame, total: int, offset: int = 0) -> str:
    """`from-to/total`, or `*/total` for an empty page."""
    n = df.count()
    return f"{offset}-{offset + n - 1}/{total}" if n else f"*/{total}"


def arguments(df: DataFrame, args: dict[str, object]) -> dict[str, str]:
    """Filters of a root field's arguments: `column` for equality or `column_suffix`."""
    out = {}
    for name, value in args.items():
        column, op = name, "eq"
        if name not in df.columns:
            for suffix, o in SUFFIXES.items():
                if name.endswith(suffix) and name.removesuffix(suffix) in df.columns:
                    column, op = name.removesuffix(suffix), o
                    break
            else:
                raise BadRequest(f"unknown argument {name}")
        if op == "is":
            raw = "is.null" if value else "not.null"
        elif op == "in":
            raw = "in.(" + ",".join(map(str, value)) + ")"
        else:
            raw = f"{op}.{value}"
        out[column + "\0" * (column in out)] = raw
    return out


def root_field(tables: dict[str, DataFrame], base: str, args: dict[str, object] | None = None, columns: list[str] | None = None, order_by: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A root field of the graph-shaped API: filters by suffix, order, page, columns."""
    df = tables[base]
    for column, raw in arguments(df, args or {}).items():
        column = column.rstrip("\0")
        df = df.where(F.col(column).isNotNull()) if raw == "not.null" else df.where(condition(df, column, raw))
    df = ordered(df, order_by)
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def upsert(engine, table: str, rows: list[dict], on_conflict: str | None = None, resolution: str | None = None, principal=None) -> DataFrame:
    """Insert rows of an API request; resolution: merge-duplicates, ignore-duplicates or None (a conflict is an error). Returns the affected rows.

    All rows have the same columns. on_conflict names the key (`a,b`); without it the primary key.
    """
    from .dialect import literal

    if not rows or any(r.keys() != rows[0].keys() for r in rows):
        raise BadRequest("rows have the same columns, and there is at least one")
    spec = engine.store.spec(table)
    columns = list(rows[0])
    unknown = [c for c in columns if c not in spec.columns]
    if unknown:
        raise BadRequest(f"unknown column {unknown[0]}")
    target = [c.strip() for c in on_conflict.split(",")] if on_conflict else spec.primary
    if resolution not in (None, "merge-duplicates", "ignore-duplicates") or on_conflict and resolution is None:
        raise BadRequest("resolution is merge-duplicates or ignore-duplicates")
    if resolution and not target or [c for c in target if c not in spec.columns]:
        raise BadRequest("no such conflict target")
    text = f"INSERT INTO {table} ({', '.join(columns)}) VALUES " + ", ".join("(" + ", ".join(literal(r[c]) for c in columns) + ")" for r in rows)
    if resolution:
        rest = [c for c in columns if c not in target]
        merge = resolution == "merge-duplicates" and rest
        text += f" ON CONFLICT ({', '.join(target)}) DO " + ("UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in rest) if merge else "NOTHING")
    return engine.sql(f"{text} RETURNING *", principal=principal)
