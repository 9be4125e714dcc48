"""SQL text, rights, transactions, the graph-shaped API and the vector index: hand-written and brute-force expectations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvane.functions import exprs
from kelvane.operators.dialect import dialect, integer_division, members
from kelvane.operators.engine import Engine
from kelvane.operators.graph_api import GraphApi, Parser
from kelvane.operators.joins import not_in
from kelvane.operators.lexer import Reader, SqlError, lex, split_top
from kelvane.operators.resource import BadRequest, ForeignKey, upsert
from kelvane.operators.security import Access, Denied, Policy, Principal
from kelvane.operators.store import ConstraintError
from kelvane.operators.vector_index import VectorIndex
from kelvane.streaming import events as ev


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "tables"))
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, owner TEXT, note TEXT, n INT)")
    e.sql("INSERT INTO t VALUES (1, 'ann', 'a', 7), (2, 'bob', 'b', 8), (3, 'ann', 'c', NULL)")
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# text


def test_tokens():
    assert [t.text for t in lex("a->>'it''s' -- x\n/* y */ <= \"q\"\"r\" $12 1.5e-3 ::")] == ["a", "->>", "'it''s'", "<=", '"q""r"', "$12", "1.5e-3", "::"]
    assert split_top("a, 'x,y' /* , */, f(b, [c, d])") == ["a", "'x,y' /* , */", "f(b, [c, d])"]
    for bad in ("select 'x", 'a "b', "`c"):
        with pytest.raises(SqlError):
            lex(bad)
    r = Reader("SET a = 'WHERE' , b = (SELECT 1 WHERE x) WHERE c")
    r.needs("SET")
    assert r.until(("WHERE",)) == "a = 'WHERE' , b = (SELECT 1 WHERE x)" and r.takes("WHERE") and r.rest() == "c"


def test_nothing_in_strings_is_rewritten(spark):
    text = "SELECT 'a -> ''b'' LIKE ''c'' CAST(1 AS TEXT) 7/2 sum(x) OVER (ORDER BY y) $1' AS s, 'a\\nb' AS t"
    got = spark.sql(integer_division(dialect(text), spark.sql)).first()
    assert got["s"] == "a -> 'b' LIKE 'c' CAST(1 AS TEXT) 7/2 sum(x) OVER (ORDER BY y) $1" and got["t"] == "a\\nb"


@pytest.mark.parametrize(
    ("text", "want"),
    [("7/2", 3), ("-7/2", -3), ("7/2/2", 1), ("7/2.0D", 3.5), ("(7/2) * 2", 6), ("7 / (9/4)", 3), ("CAST(7 AS FLOAT)/2", 3.5), ("1.5D/2", 0.75), ("8/CAST(2 AS DOUBLE)", 4.0), ("abs(-9)/2", 4)],
)
def test_integer_division(engine, text, want):
    got = engine.sql(f"SELECT {text} AS x").first()["x"]
    assert got == want and isinstance(got, type(want))


def test_integer_division_in_writes(engine):
    engine.sql("UPDATE t SET n = n / 2 WHERE id / 2 = 1")
    assert rows(engine.sql("SELECT id, coalesce(n, -1) FROM t")) == [(1, 7), (2, 4), (3, -1)]
    engine.sql("INSERT INTO t (id, n) VALUES (4, 9/2), (2, 5) ON CONFLICT (id) DO UPDATE SET n = (n + EXCLUDED.n) / 2")
    assert dict(rows(engine.sql("SELECT id, coalesce(n, -1) FROM t"))) == {1: 7, 2: 4, 3: -1, 4: 4}


def test_casts_in_text(engine):
    assert engine.sql("SELECT CAST(' On ' AS BOOL), CAST('n' AS BOOLEAN), CAST(5 AS BOOL), CAST(0.0D AS BOOL), CAST(NULL AS BOOL), CAST(true AS BOOL)").first() == (True, False, True, False, None, True)
    assert engine.sql("SELECT CAST(2.9D AS INT), CAST(' 12 ' AS INT), CAST(7 AS TEXT), CAST('1.5' AS FLOAT), CAST(3 AS DECIMAL(5, 2))").first()[:4] == (2, 12, "7", 1.5)
    with pytest.raises(Exception, match="not a boolean"):
        engine.sql("SELECT CAST('maybe' AS BOOL)").collect()


def test_members_nest(spark):
    df = spark.createDataFrame([('{"a": {"b''x": [1], "c.d": "e\\\\f"}}',), (None,)], "j string")
    df.createOrReplaceTempView("nested_members")
    got = spark.sql(dialect("SELECT j -> 'a' ->> 'c.d' AS x, (j) -> 'a' AS y FROM nested_members")).collect()
    assert got[0]["x"] == "e\\f" and json.loads(got[0]["y"])["c.d"] == "e\\f" and got[1] == (None, None)
    assert members("auth.jwt() ->> 'c'") == "auth.jwt() ->> 'c'"


def test_exact_decimals_are_never_rounded(spark):
    made = lambda v, kind, p, s: spark.sql(f"SELECT CAST('{v}' AS {kind}) AS v").select(exprs.exact_decimal(F.col("v"), p, s).alias("d")).first()["d"]
    assert str(made("1.500", "string", 5, 1)) == "1.5" and str(made("0", "double", 5, 2)) == "0.00" and str(made("1.123456789012345678901234567", "string", 38, 27)) == "1.123456789012345678901234567"
    assert made("1E7", "double", 10, 1) == 10_000_000
    for v, kind, s in (("1.00000000000000000000000001", "string", 20), ("0.001", "double", 2), ("1e-20", "double", 5), ("0.125", "decimal(20,10)", 2)):
        with pytest.raises(Exception, match="excess"):
            made(v, kind, 38, s)


def test_not_in(spark):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "a bigint"), spark.createDataFrame([(2,)], "b bigint")
    assert rows(not_in(left, "a", right, "b")) == [(1,)]
    assert not_in(left, "a", right.unionAll(spark.createDataFrame([(None,)], "b bigint")), "b").count() == 0
    assert not_in(left, "a", right.limit(0), "b").count() == 3


# rights


def ruled(engine):
    for text in (
        "CREATE USER ann", "CREATE USER root SUPERUSER", "GRANT SELECT ON t TO ann", "GRANT UPDATE (note) ON t TO ann", "GRANT INSERT ON t TO ann", "GRANT DELETE ON t TO ann",
        "CREATE POLICY own ON t USING (owner = current_user) WITH CHECK (owner = auth.uid() AND note <> 'bad')",
    ):
        engine.sql(text)
    return Principal("ann")


def test_rows_by_any_name(engine):
    ann = ruled(engine)
    engine.sql("SELECT * FROM t").collect()
    for text in ("SELECT id FROM T", "SELECT x.id FROM `T` x", "WITH y AS (SELECT * FROM t) SELECT id FROM y", "SELECT id FROM (SELECT * FROM t) z", "SELECT id FROM t WHERE id IN (SELECT id FROM T)", "WITH t AS (SELECT * FROM t) SELECT id FROM t"):
        assert rows(engine.sql(text, principal=ann)) == [(1,), (3,)], text
    assert engine.sql("SELECT id FROM T", principal=Principal("root")).count() == 3
    for text in ("SELECT * FROM other", "SELECT * FROM default.t", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM json.`/etc/hosts`", "FROM t INSERT OVERWRITE DIRECTORY '/tmp/x' USING json SELECT *"):
        with pytest.raises((Denied, SqlError)):
            engine.sql(text, principal=ann).collect()
    with pytest.raises(Denied):
        engine.sql("SELECT 1 FROM T", principal=Principal("eve"))
    assert rows(engine.sql("WITH t AS (SELECT 5 AS id) SELECT id FROM t", principal=Principal("eve"))) == [(5,)]


def test_writes_are_checked(engine):
    ann = ruled(engine)
    engine.sql("UPDATE t SET note = 'z'", principal=ann)
    assert rows(engine.sql("SELECT id, note FROM t")) == [(1, "z"), (2, "b"), (3, "z")]
    for text in (
        "UPDATE t SET note = 'bad'", "UPDATE t SET n = 1", "INSERT INTO t (id, owner, note) VALUES (9, 'bob', 'x')", "INSERT INTO t (id, owner, note) VALUES (2, 'ann', 'x') ON CONFLICT (id) DO UPDATE SET note = EXCLUDED.note",
        "INSERT INTO t (id, owner, note) VALUES (9, 'ann', 'bad')", "TRUNCATE t", "DROP TABLE t", "CREATE INDEX i ON t (n)", "ALTER TABLE t DROP COLUMN n", "GRANT SELECT ON t TO eve", "CREATE POLICY p ON t USING (true)",
    ):
        with pytest.raises((Denied, PermissionError)):
            engine.sql(text, principal=ann)
    assert engine.sql("DELETE FROM t", principal=ann).first()[0] == 2 and rows(engine.sql("SELECT id FROM t")) == [(2,)]
    engine.sql("REVOKE DELETE ON t FROM ann")
    engine.sql("DROP POLICY own ON t")
    with pytest.raises(Denied):
        engine.sql("DELETE FROM t", principal=ann)


def test_hidden_columns(engine):
    a = engine.access = Access()
    a.grant("ann", "t", "SELECT", ["id"])
    a.grant("ann", "t", "UPDATE")
    a.grant("ann", "t", "DELETE")
    ann = Principal("ann")
    engine.sql("UPDATE t SET note = 'k' WHERE id = 1 RETURNING id", principal=ann)
    for text in ("UPDATE t SET note = 'x' WHERE OWNER = 'ann'", "UPDATE t SET note = owner", "DELETE FROM t WHERE n > 1", "UPDATE t SET note = 'x' WHERE id = 1 RETURNING note", "DELETE FROM t WHERE id = 1 RETURNING *", "UPDATE t SET note = (SELECT max(owner) FROM t)"):
        with pytest.raises(Denied):
            engine.sql(text, principal=ann)
    with pytest.raises(Exception, match="note"):
        engine.sql("SELECT note FROM t", principal=ann).collect()
    assert [r["table_name"] for r in engine.sql("SELECT table_name FROM information_schema.tables", principal=Principal("eve")).collect()] == []
    assert [r["column_name"] for r in engine.sql("SELECT column_name FROM information_schema.columns", principal=ann).collect()] == ["id"]
    assert engine.sql("SELECT * FROM kelvane_catalog.grants", principal=ann).count() == 0


# definitions and transactions


def test_indexes_and_foreign_keys(engine):
    with pytest.raises(ConstraintError):
        engine.sql("CREATE UNIQUE INDEX o ON t (owner)")
    engine.sql("CREATE UNIQUE INDEX notes ON t (note)")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO t VALUES (5, 'x', 'a', 1)")
    engine.sql("DROP INDEX notes")
    engine.sql("INSERT INTO t VALUES (5, 'x', 'a', 1)")
    engine.sql("CREATE TABLE p (a INT, b INT, PRIMARY KEY (a, b))")
    engine.sql("CREATE TABLE q (x INT, y INT, CONSTRAINT pair FOREIGN KEY (x, y) REFERENCES p (a, b))")
    engine.sql("INSERT INTO p VALUES (1, 2), (3, 4)")
    engine.sql("INSERT INTO q VALUES (1, 2), (NULL, 9)")
    for bad in ("INSERT INTO q VALUES (1, 4)", "DELETE FROM p WHERE a = 1", "UPDATE p SET b = 5 WHERE a = 1"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    engine.sql("DELETE FROM p WHERE a = 3")


def test_states_are_numbered_and_restored(engine, spark):
    first = engine.store.read("t")
    with pytest.raises(ZeroDivisionError):

        def work():
            engine.sql("DELETE FROM t WHERE id < 3")
            engine.sql("CREATE TABLE u (a INT)")
            engine.sql("DROP TABLE t")
            return 1 / 0

        engine.atomically(work)
    assert engine.names() == ["t"] and engine.store.read("t").count() == 3 and first.count() == 3
    engine.sql("UPDATE t SET n = 1 WHERE id = 1")
    assert engine.store.vacuum() > 0 and rows(engine.sql("SELECT id, coalesce(n, 0) FROM t")) == [(1, 1), (2, 8), (3, 0)]


def test_triggers_before_and_after(engine):
    engine.sql("CREATE TABLE log (id INT, was TEXT, now TEXT)")
    engine.functions["upper"] = lambda e, new, old: new.withColumn("note", F.upper("note")).where("n is null or n <> 8")
    engine.functions["keep_two"] = lambda e, new, old: old.where("id <> 2")
    engine.functions["log"] = "INSERT INTO log VALUES (coalesce(NEW.id, OLD.id), OLD.note, NEW.note)"
    for name, timing, event, f in (("a", "BEFORE", "INSERT", "upper"), ("b", "BEFORE", "UPDATE", "upper"), ("c", "BEFORE", "DELETE", "keep_two"), *((f"z{k}", "AFTER", k, "log") for k in ("INSERT", "UPDATE", "DELETE"))):
        engine.sql(f"CREATE TRIGGER {name} {timing} {event} ON t FOR EACH ROW EXECUTE FUNCTION {f}")
    engine.sql("INSERT INTO t VALUES (10, 'x', 'low', 1), (11, 'x', 'gone', 8)")
    engine.sql("UPDATE t SET note = 'new'")
    engine.sql("DELETE FROM t WHERE id IN (1, 2)")
    assert rows(engine.sql("SELECT id, note FROM t")) == [(2, "b"), (3, "NEW"), (10, "NEW")]
    assert rows(engine.sql("SELECT id, coalesce(was, '-'), coalesce(now, '-') FROM log")) == [(1, "NEW", "-"), (1, "a", "NEW"), (3, "c", "NEW"), (10, "-", "LOW"), (10, "LOW", "NEW")]


# data API


def test_upsert_requests(engine):
    with pytest.raises(ConstraintError):
        upsert(engine, "t", [{"id": 1, "note": "x"}])
    assert rows(upsert(engine, "t", [{"id": 1, "note": "it's"}, {"id": 9, "note": "y"}], "id", "merge-duplicates").select("id", "note")) == [(1, "it's"), (9, "y")]
    assert rows(upsert(engine, "t", [{"id": 1, "note": "z"}, {"id": 8, "note": "w"}], resolution="ignore-duplicates").select("id")) == [(8,)]
    for bad in (([{"zz": 1}], None, None), ([], None, None), ([{"id": 1}], "zz", "merge-duplicates"), ([{"id": 1}], "id", "other"), ([{"id": 1}, {"note": "x"}], None, None)):
        with pytest.raises(BadRequest):
            upsert(engine, "t", *bad)


def test_graph_text():
    kind, fields = Parser('query q($a: Int = 3) { x: t(n: -1.5, s: "a\\"b", l: [1, {k: null}], v: $a, d: IN) { id # c\n u { id } } }', {"a": 4}).document()
    assert kind == "query" and fields[0].name == "t" and fields[0].alias == "x" and fields[0].args == {"n": -1.5, "s": 'a"b', "l": [1, {"k": None}], "v": 4, "d": "IN"} and [f.name for f in fields[0].fields] == ["id", "u"]
    for bad in ("{ t ", "{ t(x: $no) { id } }", "{ 5 }", "{ t { id } ; }"):
        with pytest.raises(BadRequest):
            Parser(bad).document()


def test_graph_api(engine, spark):
    engine.sql("CREATE TABLE u (id INT PRIMARY KEY, t_id INT REFERENCES t (id), v VECTOR(2))")
    engine.sql("INSERT INTO u VALUES (1, 1, [0, 0]), (2, 1, [1, 0]), (3, NULL, [5, 5])")
    engine.register("edges", spark.createDataFrame([(1, 2, "KNOWS", "{}"), (3, 1, "KNOWS", "{}"), (1, 3, "LIKES", "{}")], "from_id bigint, to_id bigint, edge_type string, props string"))
    api = GraphApi(engine, [ForeignKey("u", "t_id", "t", "id")])
    got = {r["id"]: r for r in api.run("{ t { id u(orderBy: \"id.desc\") { k: id t { note } } edges(type: \"KNOWS\") { to_id } in: edges(direction: IN) { from_id } } }")["t"].collect()}
    assert [(x["k"], x["t"]["note"]) for x in got[1]["u"]] == [(2, "a"), (1, "a")] and got[2]["u"] == []
    assert [x["to_id"] for x in got[1]["edges"]] == [2] and [x["from_id"] for x in got[1]["in"]] == [3]
    assert [r["id"] for r in api.run("{ near_u(vector: [0.9, 0], k: 2) { id t { note } } }")["near_u"].collect()] == [2, 1]
    assert api.run("{ u(t_id_is_null: true) { id t { id } } }")["u"].first() == (3, None)
    for bad in ("{ t { zz } }", "{ zz { id } }", "{ t { edges { zz } } }", "{ near_u(vector: [], k: 1) { id } }", "{ near_u(vector: [1, 2], k: -1) { id } }", "{ t }", "mutation { insert_t(values: {}) { id } }", "mutation { insert_t(values: {zz: 1}) { id } }", "mutation { drop_t { id } }"):
        with pytest.raises(BadRequest):
            api.run(bad)
    done = api.run('mutation { a: insert_t(values: {id: 7, note: "n"}) { id note u { id } } b: update_t(set: {n: 5}, id_gte: 3) { id n } c: delete_u(id: 3) { id } }')
    assert done["a"].first() == (7, "n", []) and rows(done["b"]) == [(3, 5), (7, 5)] and rows(done["c"]) == [(3,)]
    engine.access = Access()
    engine.access.grant("ann", "t", "SELECT")
    engine.access.policies["t"] = [Policy("SELECT", "owner = current_user")]
    assert rows(api.run("{ t { id } }", principal=Principal("ann"))["t"]) == [(1,), (3,)]
    with pytest.raises(Denied):
        api.run("{ u { id } }", principal=Principal("ann"))


# events


def test_subscribe(spark, tmp_path):
    log = ev.EventLog(spark, str(tmp_path / "log"))
    log.capture("a", "insert", None, spark.range(3), ["id"])
    log.capture("b", "insert", None, spark.range(2), ["id"])
    assert [r["seq"] for r in ev.subscribe(log, from_seq=1, limit=3).collect()] == [2, 3, 4] and ev.subscribe(log).count() == 0
    log.ack("c", 2)
    assert [r["seq"] for r in ev.subscribe(log, "c", table="b").collect()] == [4, 5] and ev.subscribe(log, "new").count() == 5
    log.ack("d", 4)
    assert log.vacuum() == 2 and [r["seq"] for r in log.events().orderBy("seq").collect()] == [3, 4, 5]
    log.capture("a", "insert", None, spark.range(1), ["id"])
    assert log.head() == 6
    log.forget_after(5)
    assert log.head() == 5 and {(r["consumer"], r["lag_events"]) for r in log.lag().collect()} == {("c", 3), ("d", 1)}


def test_lag_by_brute_force(spark):
    rng = np.random.default_rng(5)
    events = [(k, int(rng.integers(0, 1000))) for k in range(1, 200)]
    offsets = [(f"c{k}", int(rng.integers(0, 260))) for k in range(12)] + [("twin", 50), ("other", 50)]
    df = spark.createDataFrame(events, "seq bigint, ts_ms bigint")
    got = {r["consumer"]: (r["lag_events"], r["oldest_ts_ms"]) for r in ev.lag(spark.createDataFrame(offsets, "consumer string, `offset` bigint"), df).collect()}
    assert got == {c: (max(0, 199 - o), min((t for s, t in events if s > o), default=None)) for c, o in offsets}


# vector index


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16)) * 4
    x = centers[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(9999, None)], "id bigint, v array<float>")
    index = VectorIndex.build(df, str(tmp_path / "index"), "v", "id", lists=40, sample=2000)
    queries, found = x[::300] + 0.1, 0
    x32 = x.astype(np.float32).astype(float)
    for q in queries:
        want = np.lexsort((np.arange(6000), np.linalg.norm(x32 - q, axis=1)))[:10].tolist()
        got = [r["id"] for r in index.search(q.tolist(), 10, probes=6).collect()]
        found += len(set(got) & set(want))
    assert found / (10 * len(queries)) >= 0.9
    for q in queries[:4]:
        want = np.lexsort((np.arange(6000), np.linalg.norm(x32 - q, axis=1)))[:10].tolist()
        assert [r["id"] for r in index.search(q.tolist(), 10, probes=1, exact=True).collect()] == want
    assert index.search(queries[0].tolist(), 7000, probes=1, exact=True).count() == 6000
    empty = VectorIndex.build(df.limit(0), str(tmp_path / "empty"), "v", "id")
    assert empty.search([0.0] * 16, 3).count() == 0
