"""One-hop graph patterns over an edges table (from_id, to_id, edge_type, props)."""

from __future__ import annotations

import operator
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PATTERN = re.compile(
    r"""\s*match\s*\(\s*(\w+)\s*\)\s*-\s*\[\s*(?::\s*(\w+)\s*)?\]\s*->\s*\(\s*(\w+)\s*\)\s*(?:where\s+(?P<where>.*?)\s+)?return\s+(?P<items>[\w\s,.]+?)\s*;?\s*$""",
    re.I | re.S,
)
_TERM = re.compile(r"""\s*([\w.]+)\s*(<=|>=|!=|<>|=|<|>)\s*('(?:[^']|'')*'|"[^"]*"|-?\d+)\s*(?:(and)\s+|$)""", re.I)
_OPS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


class CypherError(ValueError):
    """A pattern outside the supported form."""


def cypher(edges: DataFrame, text: str) -> DataFrame:
    """MATCH (a)-[:TYPE]->(b) [WHERE ... AND ...] RETURN ...: a filter and a projection that Catalyst pushes into the scan.

    [] is any type. WHERE compares a, b or type with integers and strings. RETURN takes a, b, type and
    props, named from_id, to_id, edge_type and props. Keywords ignore case, types don't.
    """
    m = _PATTERN.match(text)
    if not m:
        raise CypherError(f"not a one-hop pattern: {text!r}")
    a, kind, b = m[1], m[2], m[3]
    if a == b:
        raise CypherError(f"both ends are called {a}")
    names = {a: "from_id", b: "to_id", "type": "edge_type"}
    out = edges if kind is None else edges.where(F.col("edge_type") == kind)
    rest = m["where"]
    while rest:
        t = _TERM.match(rest)
        if not t:
            raise CypherError(f"not a comparison joined by AND: {rest!r}")
        if t[1] not in names:
            raise CypherError(f"unknown name {t[1]} in WHERE")
        raw = t[3]
        value = raw[1:-1].replace("''", "'") if raw[0] in "'\"" else int(raw)
        out = out.where(_OPS[t[2]](F.col(names[t[1]]), F.lit(value)))
        rest = rest[t.end() :]
        if t[4] and not rest:
            raise CypherError("WHERE ends in AND")
    returned = names | {"props": "props"}
    items = [x.strip() for x in m["items"].split(",")]
    if any(x not in returned for x in items):
        raise CypherError(f"RETURN takes {', '.join(returned)}, not {m['items']!r}")
    return out.select(*[returned[x] for x in items])


def edges_from(edges: DataFrame, node: int) -> DataFrame:
    """All edges that leave a node."""
    return edges.where(F.col("from_id") == node)


def edges_to(edges: DataFrame, node: int) -> DataFrame:
    """All edges that enter a node."""
    return edges.where(F.col("to_id") == node)


def create_edges(edges: DataFrame, rows: list[tuple]) -> DataFrame:
    """edges with the rows (from_id, to_id, edge_type, props) added."""
    return edges.unionByName(edges.sparkSession.createDataFrame(rows, edges.select("from_id", "to_id", "edge_type", "props").schema), allowMissingColumns=True)


def delete_edges(edges: DataFrame, from_id: int, to_id: int, edge_type: str) -> DataFrame:
    """edges without those of a type between two nodes."""
    same = (F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("edge_type") == edge_type)
    return edges.where(~F.coalesce(same, F.lit(False)))


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """from_id, via_id, to_id over two edge types: a self-join of edges on the middle node."""
    a = edges.where(F.col("edge_type") == first).select("from_id", F.col("to_id").alias("via_id"))
    b = edges.where(F.col("edge_type") == second).select(F.col("from_id").alias("_via"), "to_id")
    return a.join(b, F.col("via_id") == F.col("_via")).select("from_id", "via_id", "to_id")


def related(rows: DataFrame, key: str, edges: DataFrame, edge_type: str, direction: str = "out") -> DataFrame:
    """Each row with its edges of a type: direction out (from the key) or in (to it)."""
    if direction not in ("out", "in"):
        raise ValueError("direction is out or in")
    end = "from_id" if direction == "out" else "to_id"
    return rows.join(edges.where(F.col("edge_type") == edge_type), F.col(key) == F.col(end))
