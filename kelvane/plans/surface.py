"""Queries through SQL text, rights, introspection, triggers, the graph-shaped API, consumers and the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import jobs, resource
from ..operators.engine import Engine
from ..operators.graph_api import GraphApi
from ..operators.security import Access, Denied, Policy, Principal
from ..operators.vector_index import VectorIndex
from ..session import work_folder
from ..streaming import events as ev
from .base import query
from .multimodel import _D, _V, _first
from .writes import _A, KEYS, _accounts, _secured

c, lit = F.col, F.lit


def _read_only(t) -> Engine:
    """An engine over the folder's own tables."""
    e = Engine(t.spark, work_folder(t.spark, "kelvane-tables"))
    for name in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier", "events", "documents", "embeddings"):
        e.register(name, getattr(t, name))
    return e


def _frame(t, rows: list[tuple], schema: str):
    return t.spark.createDataFrame(rows, schema)


# SQL text


@query("SELECT o_orderkey, (o_orderkey // 7)::BIGINT AS d, ((o_orderkey + 3) // 2 // 3)::BIGINT AS dd, o_totalprice / 2 AS h, o_orderkey / 2.0::DOUBLE AS f, '7/2' AS s FROM orders")
def sql_integer_division(t):
    return _read_only(t).sql("SELECT o_orderkey, o_orderkey / 7 AS d, (o_orderkey + 3) / 2 / 3 AS dd, o_totalprice / 2 AS h, o_orderkey / CAST(2 AS FLOAT) AS f, '7/2' AS s FROM orders")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS b, trunc(o_totalprice)::BIGINT AS i, o_orderkey::VARCHAR AS s FROM orders")
def sql_casts(t):
    text = "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'ON' ELSE 'n' END AS BOOL) AS b, CAST(o_totalprice AS INT) AS i, CAST(o_orderkey AS TEXT) AS s FROM orders"
    return _read_only(t).sql(text)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN 'x WHERE y, it''s (a)' ELSE 'old' END AS note FROM customer")
def sql_words_in_strings(t):
    e = _accounts(t)
    e.sql("UPDATE accounts SET note = 'x WHERE y, it''s (a)' WHERE id = 1 -- WHERE id = 2")
    return e.store.read("accounts").select("id", "note")


@query("SELECT range AS id, (range * 3)::BIGINT AS v FROM range(1, 3001)")
def sql_many_values(t):
    e = Engine(t.spark, work_folder(t.spark, "kelvane-tables"))
    e.sql("CREATE TABLE many (id INT PRIMARY KEY, v INT)")
    e.sql("INSERT INTO many VALUES " + ", ".join(f"({k}, {k} * 3)" for k in range(1, 3001)))
    return e.store.read("many")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY o_orderstatus")
def sql_names_in_any_case(t):
    return _read_only(t).sql('SELECT O.o_orderstatus, COUNT(*) AS n FROM ORDERS o GROUP BY o."o_orderstatus"'.replace('"', "`"))


@query("SELECT o_orderkey, 'low' AS kind FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT o_orderkey, 'high' FROM orders WHERE o_totalprice > 300000")
def sql_prepared(t):
    between = _read_only(t).prepare("SELECT o_orderkey, $3 AS kind FROM orders WHERE o_totalprice > $1 AND o_totalprice < $2")
    return between(-1e9, 2000.0, "low").unionAll(between(300000.0, 1e18, "high"))


@query("SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part")
def concurrent_reads(t):
    from concurrent.futures import ThreadPoolExecutor

    e = _read_only(t)
    with ThreadPoolExecutor(4) as pool:
        found = pool.map(lambda x: (x, e.relation(x).count()), ["customer", "orders", "lineitem", "part"])
    return _frame(t, list(found), "name string, n bigint")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_spilling(t):
    return t.lineitem.hint("merge").join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
def external_sort(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(x.c_acctbal) FROM customer x WHERE x.c_nationkey = customer.c_nationkey)")
def sql_correlated(t):
    return _read_only(t).sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(x.c_acctbal) FROM customer x WHERE x.c_nationkey = customer.c_nationkey)")


@query("SELECT * FROM (VALUES ('Project'), ('Filter'), ('LogicalRelation')) x(node)")
def explain_nodes(t):
    plan = _read_only(t).sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 5")
    return plan.select(F.regexp_extract("plan", r"^\s*(\w+).*\(est_rows=", 1).alias("node"))


@query("SELECT 'actual_rows=' || count(*) AS plan FROM orders WHERE o_totalprice > 100000")
def explain_analyze_rows(t):
    return _read_only(t).sql("EXPLAIN ANALYZE SELECT o_orderkey FROM orders WHERE o_totalprice > 100000").where("plan LIKE 'actual_rows=%'")


# introspection


def _described(t) -> Engine:
    e = Engine(t.spark, work_folder(t.spark, "kelvane-tables"))
    e.register("nation", t.nation)
    e.sql("CREATE TABLE shop (id INT PRIMARY KEY, city TEXT NOT NULL DEFAULT 'x', UNIQUE (city, id))")
    e.sql("CREATE TABLE sale (id SERIAL, shop INT REFERENCES shop (id), price FLOAT CHECK (price > 0))")
    e.sql("CREATE UNIQUE INDEX by_city ON shop (city)")
    e.sql("CREATE INDEX sale_shop ON sale USING BTREE (shop)")
    e.sql("CREATE INDEX gone ON sale (price)")
    e.sql("DROP INDEX gone")
    return e


@query("SELECT * FROM (VALUES ('nation', 'VIEW'), ('sale', 'BASE TABLE'), ('shop', 'BASE TABLE')) x(table_name, table_type)")
def info_tables(t):
    return _described(t).sql("SELECT table_name, table_type FROM INFORMATION_SCHEMA.tables ORDER BY table_name")


@query("SELECT * FROM (VALUES ('shop', 'id', 1, NULL, 'NO', 'INT'), ('shop', 'city', 2, 'x', 'NO', 'TEXT'), ('sale', 'id', 1, NULL, 'YES', 'INT'), ('sale', 'shop', 2, NULL, 'YES', 'INT'), ('sale', 'price', 3, NULL, 'YES', 'FLOAT')) x(table_name, column_name, ordinal_position, column_default, is_nullable, data_type)")
def info_columns_sql(t):
    return _described(t).sql("SELECT c.table_name, c.column_name, c.ordinal_position, c.column_default, c.is_nullable, c.data_type FROM information_schema.columns c JOIN information_schema.tables t ON c.table_name = t.table_name WHERE t.table_type = 'BASE TABLE'")


@query("SELECT * FROM (VALUES ('shop', 'shop_pkey', 'PRIMARY KEY', 'id', 1, NULL), ('shop', 'shop_city_id_key', 'UNIQUE', 'city', 1, NULL), ('shop', 'shop_city_id_key', 'UNIQUE', 'id', 2, NULL), ('shop', 'shop_city_key', 'UNIQUE', 'city', 1, NULL), ('sale', 'shop_fkey', 'FOREIGN KEY', 'shop', 1, 'shop_pkey'), ('sale', 'check_price', 'CHECK', NULL, NULL, NULL)) x(table_name, constraint_name, constraint_type, column_name, ordinal_position, parent)")
def info_constraints(t):
    return _described(t).sql(
        "SELECT t.table_name, t.constraint_name, t.constraint_type, k.column_name, k.ordinal_position, r.unique_constraint_name AS parent FROM information_schema.table_constraints t "
        "LEFT JOIN information_schema.key_column_usage k ON t.constraint_name = k.constraint_name LEFT JOIN information_schema.referential_constraints r ON r.constraint_name = t.constraint_name"
    )


@query("SELECT * FROM (VALUES ('shop', 'by_city', 'city', 'BTREE', true), ('sale', 'sale_shop', 'shop', 'BTREE', false)) x(table_name, index_name, column_name, index_type, is_unique)")
def info_indexes(t):
    return _described(t).sql("SELECT * FROM kelvane_catalog.indexes")


def _ruled(t) -> Engine:
    e = _accounts(t)
    for statement in (
        "CREATE ROLE clerk", "CREATE USER ann", "CREATE USER root SUPERUSER", "GRANT clerk TO ann", "GRANT SELECT, UPDATE (balance, note) ON accounts TO clerk", "GRANT INSERT ON accounts TO clerk",
        "CREATE POLICY own ON accounts FOR ALL TO clerk USING (nation = 3) WITH CHECK (nation = 3 AND balance < 1000000)",
    ):
        e.sql(statement)
    return e


@query("SELECT * FROM (VALUES ('grant', 'clerk', 'SELECT', 'ALL'), ('grant', 'clerk', 'UPDATE', 'balance,note'), ('grant', 'clerk', 'INSERT', 'ALL'), ('member', 'ann', 'clerk', NULL), ('user', 'ann', 'false', NULL), ('user', 'root', 'true', NULL), ('role', 'clerk', NULL, NULL), ('policy', 'own', 'clerk', 'nation = 3')) x(kind, a, b, c)")
def info_rights(t):
    return _ruled(t).sql(
        "SELECT 'grant' AS kind, role AS a, operation AS b, columns AS c FROM kelvane_catalog.grants UNION ALL SELECT 'member', member, role, NULL FROM kelvane_catalog.role_members "
        "UNION ALL SELECT 'user', name, CAST(is_superuser AS TEXT), NULL FROM kelvane_catalog.users UNION ALL SELECT 'role', name, NULL, NULL FROM kelvane_catalog.roles "
        "UNION ALL SELECT 'policy', name, target_roles, using_expr FROM kelvane_catalog.policies"
    )


# rights


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3")
def rls_any_case(t):
    e = _ruled(t)
    e.sql("SELECT count(*) FROM accounts").collect()  # what a superuser asked before is no one else's
    return e.sql("SELECT A.id FROM ACCOUNTS a WHERE a.id IN (SELECT id FROM Accounts)", principal=Principal("ann"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 5.0 ELSE c_acctbal END AS balance FROM customer")
def rls_update(t):
    e = _ruled(t)
    e.sql("UPDATE accounts SET balance = 5", principal=Principal("ann"))
    return e.store.read("accounts").select("id", "balance")


@query("""SELECT * FROM (VALUES ('upsert over a hidden row', true), ('update fails the check', true), ('update of another column', true), ('insert fails the check', true), ('returning a hidden column', true),
('where on a hidden column', true), ('truncate', true), ('drop', true), ('alter', true), ('create', true), ('grant', true), ('delete', true), ('a file', true), ('no grant', true), ('subquery in a write', true),
('own update', false), ('own insert', false), ('own upsert', false)) x(what, denied)""")
def rights_denied(t):
    e = _ruled(t)
    hidden, own = (t.customer.where(w).agg(F.min("c_custkey")).first()[0] for w in ("c_nationkey <> 3", "c_nationkey = 3"))
    e.sql("CREATE USER bob")
    e.sql("GRANT SELECT (id) ON accounts TO bob")
    e.sql("GRANT UPDATE (note) ON accounts TO bob")
    ann, bob, eve = Principal("ann"), Principal("bob"), Principal("eve")
    tried = [
        ("upsert over a hidden row", f"INSERT INTO accounts (id, nation, balance) VALUES ({hidden}, 3, 1) ON CONFLICT (id) DO UPDATE SET balance = EXCLUDED.balance", ann),
        ("update fails the check", "UPDATE accounts SET balance = 2000000", ann),
        ("update of another column", "UPDATE accounts SET nation = 3", ann),
        ("insert fails the check", "INSERT INTO accounts (id, nation, balance) VALUES (9000001, 4, 1)", ann),
        ("returning a hidden column", "UPDATE accounts SET note = 'x' WHERE id = 1 RETURNING balance", bob),
        ("where on a hidden column", "UPDATE accounts SET note = 'x' WHERE BALANCE > 0", bob),
        ("truncate", "TRUNCATE accounts", ann), ("drop", "DROP TABLE accounts", ann), ("alter", "ALTER TABLE accounts ADD COLUMN z INT", ann), ("create", "CREATE TABLE z (a INT)", ann),
        ("grant", "GRANT SELECT ON accounts TO eve", ann), ("delete", "DELETE FROM accounts", ann), ("a file", f"SELECT * FROM parquet.`{t.sf_dir}/customer.parquet`", ann),
        ("no grant", "SELECT 1 FROM Accounts", eve), ("subquery in a write", "UPDATE accounts SET balance = (SELECT max(balance) FROM accounts)", ann),
        ("own update", f"UPDATE accounts SET balance = 7 WHERE id = {own} RETURNING *", ann), ("own insert", "INSERT INTO accounts (id, nation, balance) VALUES (9000002, 3, 1)", ann),
        ("own upsert", f"INSERT INTO accounts (id, nation, balance) VALUES ({own}, 3, 1) ON CONFLICT (id) DO UPDATE SET balance = EXCLUDED.balance", ann),
    ]
    out = []
    for what, text, who in tried:
        try:
            e.sql(text, principal=who).collect()
            out.append((what, False))
        except (Denied, PermissionError, ValueError):
            out.append((what, True))
    return _frame(t, out, "what string, denied boolean")


@query("SELECT * FROM (VALUES ('anon', 'anon'), ('ann', 'authenticated'), ('ann', 'clerk'), ('ann', 'staff'), ('service', 'service_role')) x(who, role)")
def effective_roles(t):
    a = Access()
    a.add_role("ann", "clerk")
    a.add_role("clerk", "staff")
    asked = {"anon": Principal(), "ann": Principal("ann"), "service": Principal("x", {"role": "service_role"})}
    return _frame(t, [(k, r) for k, p in asked.items() for r in a.effective_roles(p)], "who string, role string")


@query("SELECT o_orderkey, 'o''neil' AS uid FROM orders WHERE o_orderstatus = 'O'")
def session_uid(t):
    e = _secured(t)
    e.access.grant("authenticated", "orders", "SELECT")
    e.access.policies["orders"] = [Policy("SELECT", "auth.uid() = 'o''neil' AND o_orderstatus = 'O'")]
    return e.sql("SELECT o_orderkey, auth.uid() AS uid FROM orders", principal=Principal("o'neil"))


# triggers, functions and transactions


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 2 AND c_acctbal >= 0 THEN 1.0 WHEN c_nationkey = 2 THEN c_acctbal ELSE c_acctbal END AS balance, CASE WHEN c_nationkey = 2 AND c_acctbal >= 0 THEN 'set before' ELSE 'old' END AS note FROM customer")
def trigger_before(t):
    e = _accounts(t)
    e.functions["veto_debts"] = lambda engine, new, old: new.join(old.where("balance >= 0").select("_row"), "_row").withColumn("note", lit("set before"))
    e.sql("CREATE TRIGGER b BEFORE UPDATE ON accounts FOR EACH ROW EXECUTE FUNCTION veto_debts")
    e.sql("UPDATE accounts SET balance = 1 WHERE nation = 2")
    return e.store.read("accounts").select("id", "balance", "note")


@query("SELECT c_custkey AS id, c_acctbal AS was, 0.0 AS now, 'from ' || c_custkey AS note FROM customer WHERE c_nationkey = 5")
def trigger_new_old(t):
    e = _accounts(t)
    e.sql("CREATE TABLE audit (id INT, was FLOAT, now FLOAT, note TEXT)")
    e.functions["log"] = "INSERT INTO audit VALUES (OLD.id, OLD.balance, NEW.balance, 'from ' || CAST(NEW.id AS TEXT))"
    e.sql("CREATE TRIGGER a AFTER UPDATE ON accounts FOR EACH ROW EXECUTE FUNCTION log")
    e.sql("UPDATE accounts SET balance = 0 WHERE nation = 5")
    return e.store.read("audit")


@query(f"SELECT id, balance FROM ({_A})")
def rpc_all_or_nothing(t):
    e = _accounts(t)
    functions = jobs.Functions(e)
    functions.put(jobs.Function("pay", ["amount"], ["UPDATE accounts SET balance = balance + $1", "INSERT INTO accounts (id) VALUES (1)"]))
    try:
        functions.call("pay", {"amount": 100})
    except ValueError:
        pass  # the second statement breaks the key, so the first is undone
    return e.store.read("accounts").select("id", "balance")


@query("SELECT event_id FROM events WHERE extract(minute FROM ts) % 15 = 0 AND extract(hour FROM ts) BETWEEN 8 AND 17 AND extract(dow FROM ts) BETWEEN 1 AND 5")
def cron_fits(t):
    return t.events.where(jobs.scheduled(c("ts"), "*/15 8-17 * * 1-5")).select("event_id")


# data API


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (1, 2) THEN 8.0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT 9000001, 8.0 UNION ALL SELECT 9000002, 9.0")
def rest_upsert(t):
    e = _accounts(t)
    resource.upsert(e, "accounts", [{"id": k, "balance": 8.0} for k in (1, 2, 9000001)], "id", "merge-duplicates")
    resource.upsert(e, "accounts", [{"id": k, "balance": 9.0} for k in (3, 9000002)], resolution="ignore-duplicates")
    return e.store.read("accounts").select("id", "balance")


@query("""SELECT c_custkey AS id, n_name AS nation, coalesce(k.n, 0)::BIGINT AS n, coalesce(k.top, -1) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, least(count(*), 2) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey) k ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def graphql_nested(t):
    text = "query { customer(c_acctbal_gt: 0) { id: c_custkey nation { n_name } orders(o_totalprice_gt: 1000, orderBy: \"o_totalprice.desc\", limit: 2) { o_orderkey price: o_totalprice } } }"
    df = GraphApi(_read_only(t), KEYS).run(text)["customer"]
    return df.select("id", c("nation.n_name").alias("nation"), F.size("orders").cast("long").alias("n"), F.coalesce(F.try_element_at(c("orders"), lit(1))["price"], lit(-1.0)).alias("top"))


@query("SELECT c_custkey, 1::BIGINT AS n, (1000000 + c_nationkey)::BIGINT AS to_id FROM customer")
def graphql_edges(t):
    e = _read_only(t)
    e.register("edges", t.customer.select(c("c_custkey").alias("from_id"), (c("c_nationkey") + 1_000_000).cast("long").alias("to_id"), lit("IN_NATION").alias("edge_type"), lit("{}").alias("props")))
    df = GraphApi(e).run('{ customer { c_custkey edges(type: "IN_NATION", direction: OUT) { to_id edge_type } } }')["customer"]
    return df.select("c_custkey", F.size("edges").cast("long").alias("n"), F.try_element_at(c("edges"), lit(1))["to_id"].alias("to_id"))


@query(f"SELECT vec_id, label FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), vec_id LIMIT 7")
def graphql_near(t):
    text = "query q($v: [Float!]!) { near_embeddings(vector: $v, k: 7) { vec_id label } }"
    return GraphApi(_read_only(t)).run(text, {"v": [float(x) for x in _first(t)]})["near_embeddings"]


@query(f"SELECT id, balance, note FROM ({_A}) WHERE nation <> 4 AND id <> 1 UNION ALL SELECT 1, 2.5, 'it''s set' UNION ALL SELECT 9000001, 3.5, 'new'")
def graphql_mutations(t):
    e = _accounts(t)
    e.sql("UPDATE accounts SET nation = 5 WHERE id = 1")
    api = GraphApi(e)
    api.run("mutation { insert_accounts(values: {id: 9000001, balance: 3.5, nation: 9}) { id } }")
    api.run('mutation m($n: String) { update_accounts(set: {balance: 2.5, note: $n}, id_in: [1]) { id balance } }', {"n": "it's set"})
    api.run("mutation { delete_accounts(nation: 4) { id } }")
    return e.store.read("accounts").select("id", "balance", "note")


# consumers


def _log_of_nations(t) -> ev.EventLog:
    log = ev.EventLog(t.spark, work_folder(t.spark, "kelvane-events"))
    log.capture("nation", "insert", None, t.nation.orderBy("n_nationkey").coalesce(1), t.nation.columns)
    log.capture("region", "insert", None, t.region.coalesce(1), t.region.columns)
    return log


_SEQS = "(SELECT range AS seq FROM range(1, 1 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)))"


@query(f"SELECT seq FROM {_SEQS} WHERE seq > 12 LIMIT 5")
def cdc_ack(t):
    log = _log_of_nations(t)
    log.ack("a", 4)
    log.ack("a", 12)
    return log.poll("a", 5).select("seq")


@query(f"SELECT seq FROM {_SEQS} WHERE seq > 4")
def cdc_vacuum(t):
    log = _log_of_nations(t)
    log.ack("a", 12)
    log.ack("b", 4)
    log.vacuum()
    return log.events().select("seq")


@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS head")
def cdc_head_of_log(t):
    return _frame(t, [(_log_of_nations(t).head(),)], "head bigint")


@query("SELECT (SELECT count(*) FROM nation) + row_number() OVER () AS seq, 'region' AS name FROM region")
def cdc_subscribe(t):
    log = _log_of_nations(t)
    log.ack("reader", 3)
    return ev.subscribe(log, "reader", table="region").select("seq", F.get_json_object("body", "$.source.table").alias("name"))


@query("SELECT consumer, off AS \"offset\", (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS max_seq, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - off AS lag_events FROM (VALUES ('a', 12::BIGINT), ('b', 4)) x(consumer, off)")
def info_subscription_lag(t):
    e = Engine(t.spark, work_folder(t.spark, "kelvane-tables"))
    e.sql("CREATE TABLE nation (n_nationkey INT, n_name TEXT)")
    e.sql("ALTER TABLE nation ENABLE EVENTS")
    e.store.insert("nation", t.nation.select("n_nationkey", "n_name"))
    e.store.insert("nation", t.region.select(c("r_regionkey").alias("n_nationkey"), c("r_name").alias("n_name")))
    e.store._log().ack("a", 12)
    e.store._log().ack("b", 4)
    return e.sql("SELECT consumer, `offset`, max_seq, lag_events FROM kelvane_catalog.subscription_lag")


# stored indexes


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_D}, ['for', 'license'])")
def search_stored_index(t):
    folder = work_folder(t.spark, "kelvane-index")
    text.write_index(t.documents, "doc_id", "text", folder)
    return text.search_index(t.spark, folder, "doc_id", "license for")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), 5) AS dist FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), vec_id LIMIT 10")
def near_indexed(t):
    index = VectorIndex.build(t.embeddings, work_folder(t.spark, "kelvane-index"), "embedding", "vec_id", lists=16)
    return index.search(_first(t), 10, probes=4, exact=True).select("vec_id", F.round("vec_distance", 5).alias("dist"))
