"""Writes, security, data API and introspection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import introspect, resource
from ..operators.engine import Engine
from ..operators.security import Access, Policy, Principal
from ..operators.store import Spec, duplicates, orphans, violations
from ..session import work_folder
from .base import query

c, lit = F.col, F.lit


def _folder(t) -> str:
    return work_folder(t.spark, "kelvane-tables")


def _accounts(t, **options):
    """An engine with a table of customers: id, nation, balance."""
    e = Engine(t.spark, _folder(t))
    spec = Spec({"id": "bigint", "nation": "bigint", "balance": "double", "note": "string"}, primary=["id"], defaults={"note": "new"}, **options)
    e.store.create("accounts", spec, t.customer.select(c("c_custkey").alias("id"), c("c_nationkey").alias("nation"), c("c_acctbal").alias("balance"), lit("old").alias("note")))
    return e


_A = "SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_acctbal AS balance, 'old' AS note FROM customer"


@query(f"{_A} UNION ALL SELECT 9000001, 1, 5.5, 'new' UNION ALL SELECT 9000002, NULL, NULL, 'x'")
def insert_values(t):
    e = _accounts(t)
    e.sql("INSERT INTO accounts (id, nation, balance, note) VALUES (9000001, 1, 5.5, NULL), (9000002, NULL, NULL, 'x')")
    return e.store.read("accounts")


@query("SELECT 9000001::BIGINT AS id, 'new' AS note")
def insert_returning(t):
    return _accounts(t).sql("INSERT INTO accounts (id, balance) VALUES ($1, 2.5) RETURNING id, note", [9000001])


@query(f"SELECT * FROM ({_A}) UNION ALL SELECT 9000001, 1, 1.0, 'new'")
def upsert_nothing(t):
    e = _accounts(t)
    e.sql("INSERT INTO accounts (id, nation, balance) VALUES (1, 1, 1.0), (9000001, 1, 1.0) ON CONFLICT (id) DO NOTHING")
    return e.store.read("accounts")


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, CASE WHEN c_custkey IN (1, 2) THEN round(c_acctbal + 10, 2) ELSE c_acctbal END AS balance, CASE WHEN c_custkey IN (1, 2) THEN 'ten' ELSE 'old' END AS note FROM customer UNION ALL SELECT 9000001, 3, 10, 'ten'")
def upsert_update(t):
    e = _accounts(t)
    e.sql("INSERT INTO accounts VALUES (1, 3, 10, 'ten'), (2, 3, 10, 'ten'), (9000001, 3, 10, 'ten') ON CONFLICT (id) DO UPDATE SET balance = balance + EXCLUDED.balance, note = EXCLUDED.note")
    return e.store.read("accounts").withColumn("balance", F.when(c("id").isin(1, 2), F.round("balance", 2)).otherwise(c("balance")))


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, CASE WHEN c_nationkey = 3 THEN round(c_acctbal * 2 + 1, 2) ELSE c_acctbal END AS balance, CASE WHEN c_nationkey = 3 THEN 'upd' ELSE 'old' END AS note FROM customer")
def update_case(t):
    e = _accounts(t)
    e.sql("UPDATE accounts SET balance = balance * 2 + 1, note = 'upd' WHERE nation = 3")
    return e.store.read("accounts").withColumn("balance", F.when(c("nation") == 3, F.round("balance", 2)).otherwise(c("balance")))


@query(f"SELECT * FROM ({_A}) WHERE NOT (nation = 4 AND balance < 100)")
def delete_where(t):
    e = _accounts(t)
    e.sql("DELETE FROM accounts WHERE nation = 4 AND balance < 100")
    return e.store.read("accounts")


@query("SELECT count(*)::BIGINT AS count FROM customer")
def truncate(t):
    return _accounts(t).sql("TRUNCATE accounts")


@query("SELECT c_custkey AS id, c_acctbal AS balance, 'old' AS note, 7::BIGINT AS extra FROM customer")
def alter_columns(t):
    e = _accounts(t)
    e.sql("ALTER TABLE accounts ADD COLUMN extra INT DEFAULT 7")
    e.sql("ALTER TABLE accounts DROP COLUMN nation")
    return e.store.read("accounts")


@query("SELECT 1::BIGINT AS id, 'a' AS kind, 1::BIGINT AS n UNION ALL SELECT 2, NULL, 5")
def create_table_types(t):
    e = Engine(t.spark, _folder(t))
    e.sql("CREATE TYPE kind AS ENUM ('a', 'b')")
    e.sql("CREATE DOMAIN small AS INT CHECK (VALUE < 10)")
    e.sql("CREATE TABLE things (id SERIAL PRIMARY KEY, kind kind, n small DEFAULT 1)")
    e.sql("INSERT INTO things (kind, n) VALUES ('a', NULL), (NULL, 5)")
    return e.store.read("things")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey > 100)")
def fk_violations(t):
    return orphans(t.lineitem, "l_orderkey", t.orders.where("o_orderkey > 100"), "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(t):
    return duplicates(t.orders, ["o_custkey", "o_orderstatus"])


@query("SELECT c_custkey, 'check balance' AS rule FROM customer WHERE NOT (c_acctbal >= 0)")
def check_violations(t):
    return violations(t.customer, Spec({}, checks={"balance": "c_acctbal >= 0"}, not_null=["c_custkey"])).select("c_custkey", "rule")


@query(f"WITH a AS ({_A}) SELECT op, count(*)::BIGINT AS n FROM (SELECT 'update' AS op FROM a WHERE nation = 2 UNION ALL SELECT 'delete' FROM a WHERE nation = 3) GROUP BY op")
def cdc_capture(t):
    from ..streaming.events import EventLog

    e = _accounts(t, events=True)
    e.sql("UPDATE accounts SET balance = 0.0 WHERE nation = 2")
    e.sql("DELETE FROM accounts WHERE nation = 3")
    log = EventLog(t.spark, f"{e.folder}/_events")
    return log.events().groupBy("op").agg(F.count(lit(1)).alias("n"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def ndjson_load(t):
    from ..sources.ndjson import read_ndjson

    folder = _folder(t)
    t.nation.select("n_nationkey", "n_name").write.json(folder)
    return read_ndjson(t.spark, folder, "n_nationkey bigint, n_name string")


@query("SELECT 7::BIGINT AS id, 20000::BIGINT AS n")
def large_object(t):
    from ..sources.objects import objects, put_object

    folder = _folder(t)
    put_object(t.spark, folder, 7, b"x" * 20_000)
    return objects(t.spark, folder).select("id", F.octet_length("data").cast("long").alias("n"))


@query("SELECT c_custkey AS n FROM customer WHERE c_nationkey = 5")
def trigger_audit(t):
    e = _accounts(t)
    e.sql("CREATE TABLE audit (n INT)")
    e.functions["log"] = lambda engine, new, old: engine.store.insert("audit", old.select(c("id").alias("n")))
    e.sql("CREATE TRIGGER a AFTER DELETE ON accounts FOR EACH ROW EXECUTE FUNCTION log")
    e.sql("DELETE FROM accounts WHERE nation = 5")
    return e.store.read("audit")


@query("SELECT round(sum(CASE WHEN c_nationkey = 2 THEN c_acctbal + 100 ELSE c_acctbal END), 2) AS total FROM customer")
def rpc_function(t):
    from ..operators import jobs

    e = _accounts(t)
    functions = jobs.Functions(e)
    functions.put(jobs.Function("pay", ["amount", "nation"], ["UPDATE accounts SET balance = balance + $1 WHERE nation = $2", "SELECT round(sum(balance), 2) AS total FROM accounts"]))
    return functions.call("pay", {"amount": 100, "nation": 2})


@query("SELECT 1::BIGINT AS a UNION ALL SELECT 2")
def migrations(t):
    from ..operators import jobs

    e = Engine(t.spark, _folder(t))
    jobs.migrate(e, {"1.sql": "CREATE TABLE m (a INT)", "2.sql": "INSERT INTO m VALUES (1); INSERT INTO m VALUES (2)"}, {})
    return e.store.read("m")


# data API

KEYS = [resource.ForeignKey("orders", "o_custkey", "customer", "c_custkey"), resource.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey")]


def _tables(t):
    return {"orders": t.orders, "customer": t.customer, "nation": t.nation}


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'P') AND o_custkey <> 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def rest_filter(t):
    return resource.collection(_tables(t), "orders", select="o_orderkey,o_totalprice", filters={"o_totalprice": "gte.100000", "o_orderstatus": "in.(F,P)", "o_custkey": "neq.3"}, order="o_totalprice.desc,o_orderkey.asc", limit=20, offset=5)


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def rest_embed_forward(t):
    df = resource.collection(_tables(t), "orders", KEYS, "o_orderkey,customer(c_name,c_nationkey)")
    return df.select("o_orderkey", "customer.c_name", "customer.c_nationkey")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n, max(o_totalprice) AS top FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON o_custkey = c_custkey GROUP BY c_custkey")
def rest_embed_reverse(t):
    df = resource.collection(_tables(t), "customer", KEYS, "c_custkey,orders(o_orderkey,o_totalprice)", {"orders.o_totalprice": "gt.150000"}, "orders.o_totalprice.desc")
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"), F.try_element_at(c("orders"), lit(1))["o_totalprice"].alias("top"))


@query("SELECT '0-9/' || count(*) AS range FROM orders WHERE o_orderstatus = 'F'")
def rest_count_exact(t):
    whole = resource.collection(_tables(t), "orders", filters={"o_orderstatus": "eq.F"})
    page = resource.collection(_tables(t), "orders", filters={"o_orderstatus": "eq.F"}, limit=10)
    return t.spark.createDataFrame([(resource.content_range(page, whole.count()),)], "range string")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 500 AND c_nationkey IN (1, 2, 3) AND c_name ILIKE '%1%' ORDER BY c_acctbal LIMIT 15")
def graphql_root_field(t):
    return resource.root_field(_tables(t), "customer", {"c_acctbal_gt": 500, "c_nationkey_in": [1, 2, 3], "c_name_ilike": "%1%"}, ["c_custkey", "c_acctbal"], "c_acctbal.asc", 15)


# security


def _access() -> Access:
    a = Access()
    a.add_role("ann", "sales")
    a.grant("sales", "orders", "SELECT")
    a.grant("authenticated", "customer", "SELECT", ["c_custkey", "c_nationkey"])
    a.policies["orders"] = [Policy("SELECT", "o_orderstatus = 'O'"), Policy("SELECT", "o_custkey = CAST(auth.jwt() ->> 'customer' AS BIGINT)", roles=("sales",))]
    a.policies["customer"] = [Policy("SELECT", "c_nationkey < 5", roles=("nobody",))]
    return a


def _secured(t) -> Engine:
    e = Engine(t.spark, _folder(t), _access())
    for name, df in _tables(t).items():
        e.register(name, df)
    return e


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'O' OR o_custkey = 12")
def rls_policy(t):
    return _secured(t).sql("SELECT count(*) AS n FROM (SELECT * FROM orders) o", principal=Principal("ann", {"customer": 12}))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE false")
def rls_role_deny(t):
    return _access().view(t.customer, "customer", Principal("ann"))


@query("SELECT c_custkey, c_nationkey FROM customer")
def column_grant(t):
    a = _access()
    a.policies.pop("customer")
    return a.view(t.customer, "customer", Principal("bob"))


@query("SELECT 'ann' AS who, NULL::VARCHAR AS claim")
def session_identity(t):
    return _secured(t).sql("SELECT current_user AS who, CAST(auth.jwt() ->> 'absent' AS STRING) AS claim", principal=Principal("ann"))


# introspection


@query("SELECT * FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2)) x(table_name, column_name, ordinal_position)")
def info_columns(t):
    return introspect.columns_view(t.spark, {"region": t.region, "nation": t.nation}, {"region"}).select("table_name", "column_name", "ordinal_position")


@query("SELECT * FROM (SELECT 'o_custkey' AS column_name, count(*)::BIGINT AS row_count, (count(*) - count(o_custkey))::BIGINT AS nulls, count(DISTINCT o_custkey)::BIGINT AS distinct_count, min(o_custkey)::VARCHAR AS min, max(o_custkey)::VARCHAR AS max FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders)")
def table_stats(t):
    return introspect.table_stats(t.orders.select("o_custkey", "o_orderstatus")).drop("bounds")


@query()
def explain_plan(t):
    return introspect.explain(t.orders.where("o_orderkey < 10").select("o_orderkey"))


@query()
def explain_analyze(t):
    return introspect.explain(t.nation.where("n_regionkey = 1"), analyze=True)
