"""Vector, text, graph and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import graph
from ..streaming import events as ev
from ..session import work_folder
from .base import query

c, lit = F.col, F.lit


# vectors: the query vector is that of vec_id 0


def _first(t) -> list[float]:
    return t.embeddings.where("vec_id = 0").select("embedding").first()[0]


_V = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COS = f"(1 - list_inner_product(embedding::DOUBLE[], {_V}::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product({_V}::DOUBLE[], {_V}::DOUBLE[]))))"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), 5) AS dist FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), vec_id LIMIT 10")
def near_l2(t):
    return vector.near(t.embeddings, "embedding", _first(t), 10, tie="vec_id").select("vec_id", F.round("vec_distance", 5).alias("dist"))


@query(f"SELECT vec_id, abs(round({_COS}, 5)) AS dist FROM embeddings ORDER BY {_COS}, vec_id LIMIT 10")
def near_cosine(t):
    return vector.near(t.embeddings, "embedding", _first(t), 10, "cosine", tie="vec_id").select("vec_id", F.abs(F.round("vec_distance", 5)).alias("dist"))


@query(f"SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), 5) AS dist FROM embeddings WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], {_V}::DOUBLE[]), vec_id LIMIT 5")
def near_filtered(t):
    return vector.near(t.embeddings, "embedding", _first(t), 5, where=c("label") == 3, tie="vec_id").select("vec_id", "label", F.round("vec_distance", 5).alias("dist"))


@query("""SELECT q.vec_id, b.vec_id AS near_vec_id, round(list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS dist,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), b.vec_id)::BIGINT AS rank
FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def knn_join(t):
    queries = t.embeddings.where("vec_id % 100 = 0")
    return vector.knn_join(queries, t.embeddings, "vec_id", "vec_id", "embedding", 5).select("vec_id", "near_vec_id", F.round("vec_distance", 4).alias("dist"), "rank")


# full text. On this corpus the two engines' white space and edges agree.

_TOK = r"list_distinct(list_filter(list_transform(regexp_split_to_array({x}, '\s+'), lambda w: lower(regexp_replace(w, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g'))), lambda w: w <> ''))"
_D = _TOK.format(x="text")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_D}, 'idiot')")
def match_one(t):
    return t.documents.where(text.match(c("text"), "IDIOT")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_D}, ['the', 'license', 'apache'])")
def match_all(t):
    return t.documents.where(text.match(c("text"), "The Apache, License")).select("doc_id")


@query(f"SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE list_contains({_D}, 'clown')")
def match_join(t):
    return t.documents.join(t.labels, "doc_id").where(text.match(c("text"), "clown")).select("doc_id", "quality")


@query(f"SELECT w AS token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({_D}) AS w FROM documents) GROUP BY w")
def inverted_index(t):
    return text.postings(t.documents, "doc_id", "text").groupBy("token").agg(F.count(lit(1)).alias("n"))


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_D}, ['for', 'license'])")
def search_fulltext(t):
    return text.search(text.postings(t.documents, "doc_id", "text"), "doc_id", "license for")


# graphs: customers are in nations, nations in regions, orders by customers

_E = """WITH edges AS (SELECT c_custkey AS from_id, 1000000 + c_nationkey AS to_id, 'IN_NATION' AS edge_type FROM customer
UNION ALL SELECT 1000000 + n_nationkey, 2000000 + n_regionkey, 'IN_REGION' FROM nation UNION ALL SELECT 3000000 + o_orderkey, o_custkey, 'BY' FROM orders) """


def _edges(t):
    e = lambda df, a, b, kind: df.select(a.cast("long").alias("from_id"), b.cast("long").alias("to_id"), lit(kind).alias("edge_type"), lit("{}").alias("props"))
    return (
        e(t.customer, c("c_custkey"), c("c_nationkey") + 1_000_000, "IN_NATION")
        .unionAll(e(t.nation, c("n_nationkey") + 1_000_000, c("n_regionkey") + 2_000_000, "IN_REGION"))
        .unionAll(e(t.orders, c("o_orderkey") + 3_000_000, c("o_custkey"), "BY"))
    )


@query(_E + "SELECT from_id, to_id FROM edges WHERE edge_type = 'IN_NATION'")
def cypher_type(t):
    return graph.cypher(_edges(t), "MATCH (a)-[:IN_NATION]->(b) RETURN a, b")


@query(_E + "SELECT to_id, edge_type FROM edges WHERE from_id = 5 AND to_id > 1000000")
def cypher_from(t):
    return graph.cypher(_edges(t), "match (x)-[]->(y) where x = 5 and y > 1000000 return y, type")


@query(_E + "SELECT from_id, to_id, edge_type FROM edges WHERE to_id <= 3")
def cypher_any(t):
    return graph.cypher(_edges(t), "MATCH (a)-[]->(b) WHERE b <= 3 RETURN a, b, type")


@query(_E + "SELECT from_id, to_id, edge_type FROM edges WHERE from_id = 7")
def edges_from(t):
    return graph.edges_from(_edges(t), 7).select("from_id", "to_id", "edge_type")


@query(_E + "SELECT from_id, to_id, edge_type FROM edges WHERE to_id = 7")
def edges_in(t):
    return graph.edges_to(_edges(t), 7).select("from_id", "to_id", "edge_type")


@query(_E + "SELECT a.from_id, a.to_id AS via_id, b.to_id FROM edges a JOIN edges b ON a.to_id = b.from_id WHERE a.edge_type = 'IN_NATION' AND b.edge_type = 'IN_REGION'")
def two_hop(t):
    return graph.two_hops(_edges(t), "IN_NATION", "IN_REGION")


@query(_E + "SELECT c_custkey, from_id FROM customer JOIN edges ON c_custkey = to_id WHERE edge_type = 'BY'")
def graph_related(t):
    return graph.related(t.customer.select("c_custkey"), "c_custkey", _edges(t), "BY", "in").select("c_custkey", "from_id")


@query(_E + "SELECT from_id, to_id FROM edges WHERE edge_type = 'IN_REGION' AND NOT (from_id = 1000003) UNION ALL SELECT 1, 2")
def edges_written(t):
    e = graph.create_edges(_edges(t), [(1, 2, "IN_REGION", "{}")])
    gone = t.nation.where("n_nationkey = 3").select("n_regionkey").first()[0] + 2_000_000
    return graph.cypher(graph.delete_edges(e, 1_000_003, gone, "IN_REGION"), "MATCH (a)-[:IN_REGION]->(b) RETURN a, b")


# change events: seq is event_id, the image is {"user_id", "event_type"}

_EV = """WITH log AS (SELECT event_id AS seq, event_type, user_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'insert' ELSE 'update' END AS op FROM events) """


def _log(t):
    op = F.when(c("event_type") == "error", "delete").when(c("event_type") == "signup", "insert").otherwise("update")
    image = F.to_json(F.struct("user_id", "event_type"))
    return t.events.select(
        c("event_id").alias("seq"), lit("1").alias("xid"), lit("users").alias("table_name"), op.alias("op"),
        F.when(op != "insert", image).alias("before"), F.when(op != "delete", image).alias("after"), F.unix_millis(c("ts").cast("timestamp")).alias("ts_ms"),
    )


@query(_EV + "SELECT seq, op FROM log WHERE seq > 100 ORDER BY seq LIMIT 50")
def cdc_poll(t):
    return ev.poll_after(_log(t), 100, 50).select("seq", "op")


@query(_EV + ", o AS (SELECT * FROM (VALUES ('a', 10), ('b', 500), ('z', 99999999)) x(consumer, off)) SELECT consumer, off::BIGINT AS \"offset\", (SELECT max(seq) FROM log)::BIGINT AS max_seq, greatest(0, (SELECT max(seq) FROM log) - off)::BIGINT AS lag_events FROM o")
def cdc_lag(t):
    offsets = t.spark.createDataFrame([("a", 10), ("b", 500), ("z", 99999999)], "consumer string, `offset` bigint")
    return ev.lag(offsets, _log(t)).select("consumer", "offset", "max_seq", "lag_events")


@query(_EV + "SELECT max(seq)::BIGINT AS head FROM log")
def cdc_head(t):
    return _log(t).agg(F.max("seq").alias("head"))


@query(_EV + "SELECT seq, CASE op WHEN 'insert' THEN 'c' WHEN 'update' THEN 'u' ELSE 'd' END AS op, CASE WHEN op <> 'delete' THEN event_type END AS kind FROM log")
def cdc_debezium(t):
    body = ev.formatted(_log(t), "debezium")
    return body.select("seq", F.get_json_object("body", "$.payload.op").alias("op"), F.get_json_object("body", "$.payload.after.event_type").alias("kind"))


@query(_EV + "SELECT seq, upper(op) AS kind, CASE WHEN op <> 'insert' THEN event_type END AS old FROM log")
def cdc_supabase(t):
    body = ev.formatted(_log(t), "supabase")
    return body.select("seq", F.get_json_object("body", "$.type").alias("kind"), F.get_json_object("body", "$.old_record.event_type").alias("old"))


@query(_EV + "SELECT seq, op, event_type AS kind FROM log")
def cdc_native(t):
    body = ev.formatted(_log(t), "other")
    return body.select("seq", F.get_json_object("body", "$.op").alias("op"), F.get_json_object("body", "$.payload.event_type").alias("kind"))


@query(_EV + "SELECT user_id, max(seq)::BIGINT AS seq, arg_max(op, seq) AS op FROM log GROUP BY user_id")
def cdc_latest_per_key(t):
    user = F.get_json_object(F.coalesce("after", "before"), "$.user_id").cast("long")
    return ev.latest(_log(t), user).select(F.get_json_object(F.coalesce("after", "before"), "$.user_id").cast("long").alias("user_id"), "seq", "op")


@query(_EV + "SELECT seq, event_type FROM log WHERE op IN ('insert', 'delete')")
def cdc_dispatch_filter(t):
    route = ev.Route("r", print, tables=["users"], ops=["insert", "delete"], columns=["event_type"])
    return route.select(_log(t)).select("seq", F.get_json_object(F.coalesce("after", "before"), "$.event_type").alias("event_type"))


@query(_EV + "SELECT seq, 'h1' AS url FROM log UNION ALL SELECT seq, 'h2' FROM log WHERE op = 'delete'")
def cdc_webhooks(t):
    hooks = t.spark.createDataFrame([("h1", "*", []), ("h2", "users", ["delete"]), ("h3", "others", [])], "url string, table string, ops array<string>")
    return ev.webhook_targets(_log(t), hooks)


@query(_EV + "SELECT seq, event_type FROM log WHERE event_type IN ('view', 'error')")
def cdc_subscriber_policy(t):
    seen = ev.visible(_log(t), {"users": ("img['event_type'] IN ('view', 'error')", ["event_type"])})
    return seen.select("seq", F.get_json_object(F.coalesce("after", "before"), "$.event_type").alias("event_type"))


@query(_EV + ", e AS (SELECT user_id, arg_max(op, seq) AS op, arg_max(event_type, seq) AS event_type FROM log GROUP BY user_id) SELECT user_id, event_type FROM e WHERE op <> 'delete' UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e)")
def cdc_apply(t):
    target = t.customer.select(c("c_custkey").alias("user_id"), lit("old").alias("event_type"))
    return ev.apply_changes(target, _log(t), "user_id")


# streams


def _stream(t):
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def stream_poll(t):
    return ev.finished(_stream(t).where("event_type = 'purchase'").select("event_id", "event_type"), work_folder(t.spark, "kelvane-streams"))


@query("SELECT event_id FROM events")
def stream_dedupe(t):
    twice = _stream(t).withColumn("ts", c("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(lit(1), lit(2))))
    return ev.finished(ev.deduplicated(twice, "event_id").select("event_id"), work_folder(t.spark, "kelvane-streams"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL", name="stream_tumbling_extra")
def stream_tumbling(t):
    rows = _stream(t).groupBy(F.window(c("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(lit(1)).alias("n"))
    return ev.finished(rows, work_folder(t.spark, "kelvane-streams"), "complete").select(c("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
