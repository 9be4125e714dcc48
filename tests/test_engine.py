"""Writes, constraints, dialect, security, events, jobs: hand-written expectations."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kelvane.functions import exprs, text, vector
from kelvane.operators import graph, introspect, jobs, resource
from kelvane.operators.engine import Engine, SqlError, bind, dialect, frames, split_top
from kelvane.operators.security import Access, Denied, Policy, Principal, bound
from kelvane.operators.store import ConstraintError
from kelvane.sources.ndjson import BadLoad, read_ndjson
from kelvane.sources.objects import delete_object, objects, pages, put_object
from kelvane.streaming import events as ev


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "tables"))
    e.sql("CREATE TABLE customers (id INT PRIMARY KEY, name TEXT NOT NULL)")
    e.sql("CREATE TABLE orders (id INT PRIMARY KEY, customer_id INT REFERENCES customers(id), total INT CHECK (total > 0))")
    e.sql("INSERT INTO customers VALUES (1, 'alice'), (2, 'bob'), (3, 'carol')")
    e.sql("INSERT INTO orders VALUES (10, 1, 100), (11, 1, 250), (12, 2, 75)")
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# SQL


def test_joins_and_aggregates(engine):
    left = engine.sql("SELECT c.name, coalesce(o.total, -1) FROM customers c LEFT JOIN orders o ON c.id = o.customer_id AND o.total > 90")
    assert rows(left) == [("alice", 100), ("alice", 250), ("bob", -1), ("carol", -1)]
    assert rows(engine.sql("SELECT name, count(*), sum(total) FROM customers c JOIN orders o ON c.id = o.customer_id GROUP BY name HAVING count(*) > 1")) == [("alice", 2, 350)]
    assert rows(engine.sql("SELECT name FROM customers WHERE id NOT IN (SELECT customer_id FROM orders)")) == [("carol",)]
    assert rows(engine.sql("WITH big AS (SELECT customer_id k FROM orders WHERE total > 80) SELECT DISTINCT name FROM customers JOIN big ON k = id")) == [("alice",)]


def test_ordered_window_sees_its_partition(engine):
    got = rows(engine.sql("SELECT id, sum(total) OVER (PARTITION BY customer_id ORDER BY id) FROM orders"))
    assert got == [(10, 350), (11, 350), (12, 75)]
    assert "ROWS BETWEEN" in frames("SELECT max(x) OVER (ORDER BY y)") and frames("SELECT max(x) OVER (ORDER BY y ROWS 1 PRECEDING)").count("ROWS") == 1


def test_parameters(spark, engine):
    assert rows(engine.sql("SELECT id FROM orders WHERE total > $2 AND customer_id = $1 AND '$3' = '$3'", [1, 150])) == [(11,)]
    with pytest.raises(SqlError):
        bind(spark, "SELECT $2", [1])
    again = engine.prepare("SELECT name FROM customers WHERE id = $1")
    assert rows(again(2)) == [("bob",)] and rows(again(3)) == [("carol",)]


def test_split_top_keeps_nesting():
    assert split_top("a, f(b, c), 'x,y', [1, 2]") == ["a", "f(b, c)", "'x,y'", "[1, 2]"]


def test_like_has_no_escape(spark):
    df = spark.createDataFrame([("a\\b",), ("a%b",), ("axb",), (None,)], "s string")
    assert [r[0] for r in df.where(exprs.like(F.col("s"), "a\\b")).collect()] == ["a\\b"]
    assert df.where(exprs.like(F.col("s"), "A%B", True)).count() == 3
    df.createOrReplaceTempView("likes")
    assert [r[0] for r in spark.sql(dialect(r"SELECT s FROM likes WHERE s LIKE 'a\b'")).collect()] == ["a\\b"]


def test_json_members(spark):
    df = spark.createDataFrame([('{"a": "x", "b": {"c": 1}, "n": null, "d.e": 2}',), (None,)], "j string")
    got = df.select(*[exprs.json_get_text(F.col("j"), k).alias(k) for k in ("a", "b", "n", "d.e", "zz")], exprs.json_get(F.col("j"), "zz"), exprs.json_get(F.col("j"), "a")).collect()
    assert tuple(got[0]) == ("x", '{"c":1}', "null", "2", None, "null", '"x"') and set(got[1]) == {None}
    df.createOrReplaceTempView("js")
    assert [tuple(r) for r in spark.sql(dialect("SELECT j ->> 'a', j -> 'b' ->> 'c' FROM js")).collect()] == [("x", "1"), (None, None)]


def test_casts(spark):
    df = spark.createDataFrame([(" Yes ",), ("off",), (None,)], "s string")
    assert [r[0] for r in df.select(exprs.cast_bool(F.col("s"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.sql("SELECT 'maybe' AS s").select(exprs.cast_bool(F.col("s"))).collect()
    with pytest.raises(Exception, match="excess"):
        spark.sql("SELECT 1.234 AS d").select(exprs.exact_decimal(F.col("d"), 5, 2)).collect()
    assert spark.range(1).select(exprs.int_div("-7", "2")).first()[0] == -3
    assert spark.sql("SELECT CAST(NULL AS BOOLEAN) b").select(exprs.two_valued(F.col("b"))).first()[0] is False


def test_timeout_passes_results_through(engine):
    assert engine.sql("SELECT count(*) AS n FROM orders", timeout=60).first()["n"] == 3


# writes


def test_constraints(engine):
    for bad in (
        "INSERT INTO customers VALUES (1, 'again')", "INSERT INTO customers VALUES (4, NULL)", "INSERT INTO customers VALUES (5, 'x'), (5, 'y')", "INSERT INTO orders VALUES (13, 9, 5)",
        "INSERT INTO orders VALUES (13, 1, 0)", "INSERT INTO orders VALUES (13, 1, NULL)", "DELETE FROM customers WHERE id = 1", "UPDATE customers SET id = 7 WHERE id = 2", "UPDATE orders SET customer_id = 8 WHERE id = 10",
    ):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    assert engine.store.read("customers").count() == 3 and engine.store.read("orders").count() == 3
    engine.sql("INSERT INTO orders VALUES (13, NULL, 5)")
    engine.sql("DELETE FROM customers WHERE id = 3")


def test_returning_and_counts(engine):
    assert rows(engine.sql("UPDATE orders SET total = total + 1 WHERE customer_id = 1 RETURNING id, total")) == [(10, 101), (11, 251)]
    assert engine.sql("DELETE FROM orders WHERE total < 90").first()[0] == 1
    assert rows(engine.sql("INSERT INTO customers VALUES (9, 'ann') RETURNING *")) == [(9, "ann")]


def test_upserts(engine):
    engine.sql("INSERT INTO customers VALUES (1, 'x'), (8, 'h'), (8, 'i') ON CONFLICT (id) DO NOTHING")
    assert (8, "h") in rows(engine.store.read("customers")) and (1, "alice") in rows(engine.store.read("customers"))
    engine.sql("INSERT INTO customers VALUES (1, 'x'), (2, 'y'), (9, 'z') ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name WHERE id < 2")
    assert rows(engine.store.read("customers")) == [(1, "x"), (2, "bob"), (3, "carol"), (8, "h"), (9, "z")]


def test_types(spark, engine):
    engine.sql("CREATE TYPE mood AS ENUM ('sad', 'glad')")
    engine.sql("CREATE DOMAIN pct AS INT CHECK (VALUE >= 0 AND VALUE <= 100)")
    engine.sql("CREATE TABLE t (id SERIAL, m mood, p pct, v VECTOR(2), j JSON, d DECIMAL(5,2) DEFAULT 1.5)")
    engine.sql("INSERT INTO t (m, p, v, j) VALUES ('sad', 5, [1, 2], '{}'), (NULL, NULL, NULL, NULL)")
    assert [(r["id"], r["m"], str(r["d"])) for r in engine.store.read("t").orderBy("id").collect()] == [(1, "sad", "1.50"), (2, None, "1.50")]
    for bad in ("INSERT INTO t (m) VALUES ('bad')", "INSERT INTO t (p) VALUES (101)", "INSERT INTO t (v) VALUES ([1, 2, 3])", "INSERT INTO t (j) VALUES ('{')"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    engine.sql("INSERT INTO t (m) VALUES ('glad')")
    assert engine.store.read("t").agg(F.max("id")).first()[0] == 3
    engine.sql("DROP TYPE mood")
    engine.sql("DROP TABLE t")
    assert "t" not in engine.names()


def test_triggers_and_functions(engine):
    engine.sql("CREATE TABLE audit (n INT)")
    engine.functions["log"] = lambda e, new, old: e.store.insert("audit", (new if new is not None else old).select(F.col("id").alias("n")))
    engine.sql("CREATE TRIGGER a AFTER DELETE ON orders FOR EACH ROW EXECUTE FUNCTION log")
    engine.sql("DELETE FROM orders WHERE id = 12")
    assert rows(engine.store.read("audit")) == [(12,)]
    f = jobs.Functions(engine)
    f.put(jobs.Function("raise_all", ["by", "whom"], ["UPDATE orders SET total = total + $1 WHERE customer_id = $2", "SELECT sum(total) AS s FROM orders"]))
    assert f.call("raise_all", {"by": 10, "whom": 1}).first()["s"] == 370
    with pytest.raises(ValueError):
        f.call("raise_all", {"by": 1})


def test_cron():
    at = datetime(2024, 3, 3, 4, 30)  # a Sunday
    assert jobs.Cron("30 4 * * *").fits(at) and jobs.Cron("*/15 4 * * 7").fits(at) and jobs.Cron("30 4 1 * 0").fits(at)
    assert not jobs.Cron("30 4 1 * *").fits(at) and not jobs.Cron("31 4 * * *").fits(at)
    for bad in ("* * * *", "60 * * * *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            jobs.Cron(bad)


def test_migrations(engine):
    done = {}
    files = {"1.sql": "CREATE TABLE m (a INT); INSERT INTO m VALUES (1)"}
    assert jobs.migrate(engine, files, done) == ["1.sql"] and jobs.migrate(engine, files, done) == []
    with pytest.raises(ValueError):
        jobs.migrate(engine, {"1.sql": "SELECT 1"}, done)
    assert engine.store.read("m").count() == 1


# vectors, text, graph


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 0.0]), (4, None)], "id bigint, v array<float>")
    assert [(r["id"], r["vec_distance"]) for r in vector.near(df, "v", [0, 0], 2).collect()] == [(1, 0.0), (3, 1.0)]
    assert [r["vec_distance"] for r in vector.near(df, "v", [1, 0], 3, "cosine", tie="id").collect()] == [0.0, pytest.approx(0.4), 1.0]
    for bad in ([], [float("nan")]):
        with pytest.raises(ValueError):
            vector.near(df, "v", bad, 1)
    got = vector.knn_join(df.where("id < 3"), df, "id", "id", "v", 2, chunk=1).orderBy("id", "rank").collect()
    assert [(r["id"], r["near_id"]) for r in got] == [(1, 1), (1, 3), (2, 2), (2, 3)]


def test_near_in_sql(engine, spark):
    engine.register("vecs", spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [3.0, 4.0], "a"), (3, [1.0, 0.0], "b")], "id bigint, v array<float>, k string"))
    assert [tuple(r) for r in engine.sql("SELECT id, vec_distance FROM vecs WHERE NEAR(v, [0, 0], 2) AND k = 'a'").collect()] == [(1, 0.0), (2, 5.0)]
    assert [r[0] for r in engine.sql("SELECT id FROM vecs WHERE NEAR(v, $1, 1)", [[1.0, 0.1]]).collect()] == [3]


def test_text(spark, engine):
    df = spark.createDataFrame([(1, "(Hello), World's end"), (2, "hello"), (3, None), (4, "")], "id bigint, t string")
    assert df.where("id = 1").select(text.tokenize(F.col("t"))).first()[0] == ["hello", "world's", "end"]
    assert [r["id"] for r in df.where(text.match(F.col("t"), "HELLO end")).collect()] == [1]
    assert df.where(text.match(F.col("t"), " ")).count() == 0 and df.where(text.match(F.col("t"), "x").isNull()).count() == 1
    assert rows(text.search(text.postings(df, "id", "t"), "id", "hello")) == [(1,), (2,)]
    engine.register("notes", df)
    assert rows(engine.sql("SELECT id FROM notes WHERE MATCH(t, 'hello') AND id < 9")) == [(1,), (2,)]


def test_cypher(spark):
    e = spark.createDataFrame([(1, 2, "KNOWS", '{"w":1}'), (2, 3, "KNOWS", "{}"), (1, 3, "Likes", "{}")], "from_id bigint, to_id bigint, edge_type string, props string")
    assert rows(graph.cypher(e, "MATCH (a)-[:KNOWS]->(b) WHERE a >= 1 AND type = 'KNOWS' RETURN b, props")) == [(2, '{"w":1}'), (3, "{}")]
    assert rows(graph.cypher(e, "match (a)-[]->(b) return type")) == [("KNOWS",), ("KNOWS",), ("Likes",)]
    for bad in ("MATCH (a)-[:X]->(b)", "MATCH (a)-[]->(a) RETURN a", "MATCH (a)-[]->(b) WHERE a.x = 1 RETURN a", "MATCH (a)-[]->(b) WHERE a = 1 OR b = 2 RETURN a", "MATCH (a)-[]->(b) RETURN c"):
        with pytest.raises(graph.CypherError):
            graph.cypher(e, bad)
    assert rows(graph.two_hops(e, "KNOWS", "KNOWS")) == [(1, 2, 3)]


# events


def test_event_log(spark, tmp_path):
    log = ev.EventLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([(k, f"n{k}") for k in range(10)], "id bigint, name string")
    assert log.head() == 0 and log.poll("c", 5).count() == 0 and log.vacuum() == 0
    log.capture("t", "insert", None, df.repartition(3), ["id", "name"])
    log.capture("t", "delete", df.where("id < 2"), None, ["id", "name"])
    assert sorted(r["seq"] for r in log.events().collect()) == list(range(1, 13)) and log.head() == 12
    assert [r["seq"] for r in log.poll("c", 4).collect()] == [1, 2, 3, 4]
    log.ack("c", 4)
    log.ack("d", 2)
    assert [r["seq"] for r in log.poll("c", 2).collect()] == [5, 6]
    assert [(r["consumer"], r["lag_events"]) for r in log.lag().collect()] == [("c", 8), ("d", 10)]
    assert log.vacuum() == 2 and log.events().count() == 10 and log.head() == 12
    target = spark.createDataFrame([], "id bigint, name string")
    assert sorted(r["id"] for r in ev.apply_changes(target, log.events(), "id").collect()) == sorted(json.loads(r["after"])["id"] for r in log.events().where("op = 'insert'").collect() if json.loads(r["after"])["id"] > 1)


def test_dispatch_retries_and_dead_letters(spark, tmp_path):
    log = ev.EventLog(spark, str(tmp_path / "log"))
    log.capture("t", "insert", None, spark.range(4).coalesce(1), ["id"])
    seen, waits = [], []

    def sink(batch):
        seen.append(batch[0]["seq"])
        if batch[0]["seq"] == 2 or (batch[0]["seq"] == 3 and seen.count(3) < 2):
            raise OSError("down")

    report = ev.dispatch(log, ev.Route("r", sink), limit=3, sleep=waits.append)
    assert report == {"polled": 3, "dead": 1, "acked": 3} and seen.count(2) == 3 and seen.count(3) == 2 and waits == [0.05, 0.1, 0.05]
    assert spark.read.parquet(f"{log.folder}/dead").first()["seq"] == 2
    assert ev.dispatch(log, ev.Route("r", sink))["polled"] == 1


def test_captured_writes_and_formats(engine, spark):
    spec = engine.store.spec("orders")
    spec.events = True
    engine.store.set_spec("orders", spec)
    engine.sql("UPDATE orders SET total = 5 WHERE id = 10")
    log = ev.EventLog(spark, f"{engine.folder}/_events")
    e = log.events().first()
    assert (json.loads(e["before"])["total"], json.loads(e["after"])["total"]) == (100, 5)
    native, debezium, other = (json.loads(ev.formatted(log.events(), k).first()["body"]) for k in ("native", "debezium", "supabase"))
    assert native["payload"]["total"] == 5 and debezium["payload"]["op"] == "u" and other["type"] == "UPDATE" and other["old_record"]["total"] == 100


def test_stream_apply(spark, tmp_path):
    log = ev.EventLog(spark, str(tmp_path / "log"))
    spark.createDataFrame([(1, "a")], "id bigint, name string").write.parquet(f"{tmp_path}/t/v=-1")
    log.capture("t", "insert", None, spark.createDataFrame([(2, "b"), (3, "c")], "id bigint, name string"), ["id", "name"])
    log.capture("t", "delete", spark.createDataFrame([(1, "a")], "id bigint, name string"), None, ["id", "name"])
    ev.apply_stream(log.stream(), f"{tmp_path}/t", "id", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/t/v=0")) == [(2, "b"), (3, "c")]


def test_signature():
    # the widely published example of HMAC-SHA256
    assert ev.signature("key", "The quick brown fox jumps over the lazy dog") == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"


# data API and security


def test_resource(spark):
    tables = {
        "orders": spark.createDataFrame([(1, 10, 5.0, None), (2, 10, 7.0, "x"), (3, 99, 9.0, "y")], "id bigint, customer_id bigint, total double, note string"),
        "customer": spark.createDataFrame([(10, "ann"), (11, "bob")], "id bigint, name string"),
    }
    keys = [resource.ForeignKey("orders", "customer_id", "customer", "id")]
    got = resource.collection(tables, "orders", keys, "id,customer(name)", order="id.asc").collect()
    assert [(r["id"], r["customer"] and r["customer"]["name"]) for r in got] == [(1, "ann"), (2, "ann"), (3, None)]
    got = resource.collection(tables, "customer", keys, "id,orders(id,total)", {"orders.total": "gt.5"}, "orders.total.desc").orderBy("id").collect()
    assert [(r["id"], [o["id"] for o in r["orders"]]) for r in got] == [(10, [2]), (11, [])]
    assert resource.collection(tables, "orders", filters={"note": "is.null"}).count() == 1
    assert resource.content_range(resource.collection(tables, "orders", limit=2, offset=1), 3, 1) == "1-2/3"
    for bad in ({"zz": "eq.1"}, {"id": "foo.1"}, {"id": "is.maybe"}):
        with pytest.raises(resource.BadRequest):
            resource.collection(tables, "orders", filters=bad)
    with pytest.raises(resource.BadRequest):
        resource.relation(keys + [resource.ForeignKey("orders", "agent_id", "customer", "id")], "orders", "customer")
    assert resource.root_field(tables, "orders", {"total_gte": 7, "note_is_null": False}, ["id"]).count() == 2


def test_security(engine):
    a = Access()
    a.add_role("ann", "clerk")
    a.add_role("clerk", "staff")
    a.grant("staff", "orders", "SELECT", ["id"])
    a.grant("clerk", "orders", "SELECT", ["total"])
    a.grant("staff", "orders", "UPDATE", ["total"])
    a.policies["orders"] = [Policy("*", "customer_id = CAST(auth.jwt() ->> 'c' AS BIGINT)", roles=("staff",))]
    engine.access = a
    assert rows(engine.sql("SELECT * FROM (SELECT * FROM orders) o", principal=Principal("ann", {"c": 1}))) == [(10, 100), (11, 250)]
    assert rows(engine.sql("SELECT * FROM orders", principal=Principal("ann"))) == []
    with pytest.raises(Denied):
        engine.sql("SELECT * FROM orders", principal=Principal("eve"))
    with pytest.raises(Denied):
        engine.sql("UPDATE orders SET customer_id = 2", principal=Principal("ann", {"c": 1}))
    engine.sql("UPDATE orders SET total = 1", principal=Principal("ann", {"c": 2}))
    assert rows(engine.sql("SELECT total FROM orders", principal=Principal(None, {"role": "service_role"}))) == [(1,), (100,), (250,)]
    assert a.effective_roles(Principal()) == {"anon"}
    assert bound("x = current_user AND y = 'current_user' AND z = auth.uid()", Principal("o'b")) == "x = 'o\\'b' AND y = 'current_user' AND z = 'o\\'b'"


# sources and introspection


def test_ndjson(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text('{"id": 1, "v": [1, 2.5], "s": "x"}\n\n{"id": 2}\n')
    assert [(r["id"], r["v"], r["s"]) for r in read_ndjson(spark, str(p)).orderBy("id").collect()] == [(1, [1.0, 2.5], "x"), (2, None, None)]
    for bad in ('{"id": 1}\n{"other": 2}\n', '{"id": 1}\nnot json\n', '{"a b": 1}\n', ""):
        p.write_text(bad)
        with pytest.raises(BadLoad):
            read_ndjson(spark, str(p)).collect()


def test_objects_and_pages(spark, tmp_path):
    data = bytes(range(256)) * 100
    put_object(spark, str(tmp_path / "lob"), 7, data)
    assert bytes(objects(spark, str(tmp_path / "lob")).first()["data"]) == data
    assert delete_object(spark, str(tmp_path / "lob"), 7)
    assert [len(p) for p in pages(spark.range(10), 4)] == [4, 4, 2]


def test_introspection(spark, engine):
    stats = {r["column_name"]: r for r in engine.sql("ANALYZE orders").collect()}
    assert stats["total"]["distinct_count"] == 3 and stats["total"]["min"] == "75" and len(stats["total"]["bounds"]) == 8
    plan = [r[0] for r in engine.sql("EXPLAIN ANALYZE SELECT * FROM orders WHERE total > 90").collect()]
    assert "actual_rows=2" in plan and plan[-1].startswith("execution_time_ms=")
    assert {r["constraint_type"] for r in introspect.constraints_view(spark, {n: engine.store.spec(n) for n in engine.store.names()}).collect()} == {"PRIMARY KEY", "CHECK", "FOREIGN KEY"}
