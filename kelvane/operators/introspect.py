"""Statistics, plans and catalogue views."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDS = 8


def table_stats(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, distinct, min, max and BOUNDS equi-depth bounds (as text). One pass, partial aggregates."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, c in enumerate(plain):
        aggs += [F.count(c).alias(f"v{k}"), F.count_distinct(c).alias(f"d{k}"), F.min(c).cast("string").alias(f"lo{k}"), F.max(c).cast("string").alias(f"hi{k}")]
        if c in numeric:
            aggs.append(F.transform(F.percentile_approx(c, [i / BOUNDS for i in range(1, BOUNDS + 1)], 10_000), lambda x: x.cast("string")).alias(f"b{k}"))
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.col("_n").alias("row_count"), (F.col("_n") - F.col(f"v{k}")).alias("nulls"), F.col(f"d{k}").alias("distinct_count"),
                F.col(f"lo{k}").alias("min"), F.col(f"hi{k}").alias("max"), (F.col(f"b{k}") if c in numeric else F.lit(None).cast("array<string>")).alias("bounds"),
            )
            for k, c in enumerate(plain)
        ]
    )
    return one.select(F.inline(rows))


def explain(df: DataFrame, analyze: bool = False) -> DataFrame:
    """A line an operator, `label (est_rows=N)`; analyze also runs the query and adds its rows and time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    lines = []

    def walk(node, depth: int) -> None:
        count = node.stats().rowCount()
        rows = count.get().toString() if count.isDefined() else "unknown"
        lines.append("  " * depth + f"{node.nodeName()} (est_rows={rows})")
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k), depth + 1)

    walk(plan, 0)
    if analyze:
        began = time.time()
        n = df.count()
        lines.append(f"actual_rows={n}")
        lines.append(f"execution_time_ms={(time.time() - began) * 1000:.1f}")
    return df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(lines)], "line int, plan string").orderBy("line").select("plan")


#: Introspection relations, by the names that SQL text uses, with their columns.
CATALOGUE = {
    "information_schema.tables": "table_catalog string, table_schema string, table_name string, table_type string",
    "information_schema.columns": "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position bigint, column_default string, is_nullable string, data_type string",
    "information_schema.table_constraints": "constraint_catalog string, constraint_schema string, constraint_name string, table_catalog string, table_schema string, table_name string, constraint_type string",
    "information_schema.key_column_usage": "constraint_catalog string, constraint_schema string, constraint_name string, table_catalog string, table_schema string, table_name string, column_name string, ordinal_position bigint, position_in_unique_constraint bigint",
    "information_schema.referential_constraints": "constraint_catalog string, constraint_schema string, constraint_name string, unique_constraint_catalog string, unique_constraint_schema string, unique_constraint_name string, match_option string, update_rule string, delete_rule string",
    "kelvane_catalog.indexes": "table_name string, index_name string, column_name string, index_type string, is_unique boolean",
    "kelvane_catalog.subscription_lag": "consumer string, `offset` bigint, max_seq bigint, lag_events bigint, oldest_unconsumed_ts_ms bigint, lag_seconds double",
    "kelvane_catalog.roles": "name string",
    "kelvane_catalog.grants": "role string, table_name string, operation string, columns string",
    "kelvane_catalog.policies": "name string, table_name string, operation string, using_expr string, with_check_expr string, enforced boolean, target_roles string",
    "kelvane_catalog.role_members": "role string, member string",
    "kelvane_catalog.users": "name string, is_superuser boolean",
    "kelvane_catalog.sessions": "session_id string, username string, created_at bigint, expires_at bigint, revoked boolean",
}
HERE = ("kelvane", "public")


def _type(kind: str) -> str:
    return {"bigint": "INT", "int": "INT", "string": "TEXT", "double": "FLOAT", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}.get(kind, kind.upper())


def _constraints(name: str, spec):
    """(name, type, columns, foreign key's parent and keys) of a table's constraints."""
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    if spec.primary:
        yield f"{name}_pkey", "PRIMARY KEY", spec.primary, None
    for u in spec.unique:
        yield f"{name}_{'_'.join(u)}_key", "UNIQUE", u, None
    for c in spec.checks:
        yield c, "CHECK", [], None
    for f, (column, parent, key) in spec.foreign.items():
        yield f, "FOREIGN KEY", listed(column), (parent, listed(key))


def relation_view(engine, name: str, principal=None) -> DataFrame:
    """An introspection relation as a principal sees it: tables on which it has a right; rules and users are for superusers, its own sessions for each."""
    spark, access = engine.spark, engine.access
    restricted = principal is not None and access is not None and not access.superuser(principal)
    kind = name.partition(".")[2]
    if kind == "subscription_lag":
        if restricted:
            return spark.createDataFrame([], CATALOGUE[name])
        from ..streaming.events import lag

        log = engine.store._log()
        found = lag(log.offsets(), log.events(), int(time.time() * 1000))
        return found.select("consumer", "offset", "max_seq", "lag_events", F.col("oldest_ts_ms").alias("oldest_unconsumed_ts_ms"), "lag_seconds")
    tables = [t for t in engine.names() if not restricted or access.visible(principal, t)]
    specs = {t: engine.store.spec(t) for t in tables if t not in engine.others}
    rows: list[tuple] = []
    if kind == "tables":
        rows = [(*HERE, t, "BASE TABLE" if t in specs else "VIEW") for t in tables]
    elif kind == "columns":
        for t in tables:
            have = access.columns(principal, t, "SELECT") if restricted else "*"
            spec = specs.get(t)
            for k, f in enumerate(engine.relation(t).schema.fields):
                if have == "*" or f.name in have:
                    default = None if spec is None or f.name not in spec.defaults else str(spec.defaults[f.name])
                    need = spec is not None and f.name in (*spec.not_null, *spec.primary)
                    rows.append((*HERE, t, f.name, k + 1, default, "NO" if need else "YES", _type(f.dataType.simpleString())))
    elif kind == "table_constraints":
        rows = [(*HERE, c, *HERE, t, what) for t, s in specs.items() for c, what, _, _ in _constraints(t, s)]
    elif kind == "key_column_usage":
        rows = [(*HERE, c, *HERE, t, column, k + 1, k + 1 if parent else None) for t, s in specs.items() for c, _, columns, parent in _constraints(t, s) for k, column in enumerate(columns)]
    elif kind == "referential_constraints":
        for t, s in specs.items():
            for c, _, _, parent in _constraints(t, s):
                if parent:
                    target = engine.store.spec(parent[0])
                    unique = f"{parent[0]}_pkey" if parent[1] == target.primary else f"{parent[0]}_{'_'.join(parent[1])}_key"
                    rows.append((*HERE, c, *HERE, unique, "NONE", "NO ACTION", "RESTRICT"))
    elif kind == "indexes":
        rows = [(x["table"], n, c, x["kind"], x["unique"]) for n, x in sorted(engine.indexes.items()) if x["table"] in tables for c in x["columns"]]
    elif kind == "sessions" and access is not None:
        rows = [x for x in access.sessions if not restricted or x[1] == principal.user]
    elif access is not None and not restricted:
        if kind == "roles":
            rows = [(r,) for r in sorted(access.roles | {r for v in access.members.values() for r in v})]
        elif kind == "role_members":
            rows = [(r, m) for m, v in sorted(access.members.items()) for r in sorted(v)]
        elif kind == "users":
            rows = [(u, u in access.superusers) for u in sorted(access.users | access.superusers)]
        elif kind == "grants":
            rows = [(w, t, p, "ALL" if c == "*" else ",".join(sorted(c))) for (w, t, p), c in sorted(access.grants.items())]
        elif kind == "policies":
            rows = [(p.name, t, "ALL" if p.op == "*" else p.op, p.using, p.check, bool(access.users | access.superusers), ",".join(sorted(p.roles)) or "*") for t, v in sorted(access.policies.items()) for p in v]
    return spark.createDataFrame(rows, CATALOGUE[name])


def columns_view(spark: SparkSession, tables: dict[str, DataFrame], visible: set[str] | None = None) -> DataFrame:
    """information_schema.columns: only tables with some grant, if visible is given."""
    rows = []
    for name, df in sorted(tables.items()):
        if visible is None or name in visible:
            rows += [(name, f.name, k + 1, re.sub(r"timestamp_ntz", "timestamp", f.dataType.simpleString()), "YES" if f.nullable else "NO") for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def tables_view(spark: SparkSession, tables: dict[str, DataFrame], visible: set[str] | None = None) -> DataFrame:
    """information_schema.tables."""
    return spark.createDataFrame([("public", n, "BASE TABLE") for n in sorted(tables) if visible is None or n in visible], "table_schema string, table_name string, table_type string")


def constraints_view(spark: SparkSession, specs: dict) -> DataFrame:
    """information_schema.table_constraints of stored tables."""
    rows = []
    for name, s in sorted(specs.items()):
        rows += [(name, f"{name}_pkey", "PRIMARY KEY")] * bool(s.primary)
        rows += [(name, f"{name}_{'_'.join(u)}_key", "UNIQUE") for u in s.unique]
        rows += [(name, c, "CHECK") for c in s.checks]
        rows += [(name, f, "FOREIGN KEY") for f in s.foreign]
    return spark.createDataFrame(rows, "table_name string, constraint_name string, constraint_type string")


def policies_view(spark: SparkSession, access) -> DataFrame:
    """Row policies."""
    rows = [(t, p.op, p.using, p.check, list(p.roles)) for t, v in sorted(access.policies.items()) for p in v]
    return spark.createDataFrame(rows, "table_name string, op string, using_sql string, check_sql string, roles array<string>")


def grants_view(spark: SparkSession, access) -> DataFrame:
    """Grants, a row for each column list."""
    rows = [(w, t, p, ["*"] if c == "*" else sorted(c)) for (w, t, p), c in sorted(access.grants.items())]
    return spark.createDataFrame(rows, "grantee string, table_name string, privilege string, columns array<string>")
