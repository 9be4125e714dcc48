"""Scans, predicates, joins, aggregates, windows, sorting, set operations, subqueries and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.windows import ranked, whole
from ..operators.joins import not_in
from .base import query

c, lit = F.col, F.lit


def n(x) -> F.Column:
    return F.count(lit(1)).alias(x)


def money(x, name: str):
    return F.round(F.sum(x), 2).alias(name)


@query("""SELECT n_name, count(*)::BIGINT AS cnt, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def revenue_by_nation(t):
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return rows.groupBy("n_name").agg(n("cnt"), money("l_extendedprice", "revenue")).orderBy(F.desc("revenue"), "n_name").limit(10)


# scans and sources


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan(t):
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def simple_select(t):
    return t.orders.where((c("o_totalprice") > 100000) & (c("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def index_lookup(t):
    return t.orders.where(c("o_orderkey") == 77)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 140")
def index_range(t):
    return t.orders.where((c("o_orderkey") >= 100) & (c("o_orderkey") < 140)).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 5")
def covering_scan(t):
    return t.orders.where(c("o_custkey") == 5).select("o_orderkey", "o_custkey")


@query("SELECT 1 + 1 AS two, 'x' AS x")
def select_without_from(t):
    return t.spark.sql("SELECT 1 + 1 AS two, 'x' AS x")


@query("SELECT k, total FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) d WHERE total > 500000")
def derived_table(t):
    inner = t.orders.groupBy(c("o_custkey").alias("k")).agg(money("o_totalprice", "total"))
    return inner.alias("d").where("d.total > 500000").select("d.k", "d.total")


@query("SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 25")
def parallel_count(t):
    return t.lineitem.where("l_quantity > 25").agg(n("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def cursor_page(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


# projection, filter and predicates


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag <> 'N'")
def filter_and(t):
    return t.lineitem.where((c("l_quantity") >= 10) & (c("l_discount") < 0.05) & (c("l_returnflag") != "N")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 3 OR l_tax > 0.07) AND NOT (l_linestatus = 'O')")
def filter_or_not(t):
    return t.lineitem.where(((c("l_quantity") < 3) | (c("l_tax") > 0.07)) & ~(c("l_linestatus") == "O")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def project_alias(t):
    return t.lineitem.select(c("l_orderkey").alias("k"), (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"))


@query("SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def qualified_star(t):
    return t.nation.alias("n").join(t.region.alias("r"), c("n_regionkey") == c("r_regionkey")).select("n.*", "r.r_name")


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def in_list(t):
    return t.nation.where(c("n_regionkey").isin(1, 3)).select("n_name")


@query("SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)")
def not_in_list(t):
    return t.nation.where(~c("n_regionkey").isin(1, 3)).select("n_name")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def is_null(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").where(c("o_orderkey").isNull()).select("c_custkey")


@query("SELECT count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
def is_not_null(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").where(c("o_orderkey").isNotNull()).agg(F.count("o_orderkey").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_'")
def like(t):
    return t.part.where(exprs.like(c("p_name"), "%1_")).select("p_partkey", "p_name")


@query("SELECT n_name FROM nation WHERE n_name ILIKE 'NaTion%1%'")
def ilike(t):
    return t.nation.where(exprs.like(c("n_name"), "NaTion%1%", ignore_case=True)).select("n_name")


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%2%'")
def not_like(t):
    return t.part.where(~exprs.like(c("p_name"), "%2%")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")
def bind_params(t):
    from ..operators.engine import bind

    t.orders.createOrReplaceTempView("orders")
    return bind(t.spark, "SELECT o_orderkey FROM orders WHERE o_custkey = $1 AND o_totalprice > $2", [7, 1000.0])


@query("SELECT o_orderkey, -o_totalprice AS minus, -(o_orderkey + 1) AS m2 FROM orders")
def unary_minus(t):
    return t.orders.select("o_orderkey", (-c("o_totalprice")).alias("minus"), (-(c("o_orderkey") + 1)).alias("m2"))


# joins


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t):
    return t.orders.join(t.customer, c("c_custkey") == c("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT a.n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 12) a FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) b ON n_regionkey = r_regionkey")
def join_full(t):
    return t.nation.where("n_nationkey < 12").join(t.region.where("r_regionkey > 1").hint("merge"), c("n_regionkey") == c("r_regionkey"), "full").select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.crossJoin(F.broadcast(t.region)).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation, region", name="join_comma")
def join_comma(t):
    t.nation.createOrReplaceTempView("nation")
    t.region.createOrReplaceTempView("region")
    return t.spark.sql("SELECT n_name, r_name FROM nation, region")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_nationkey < r_regionkey")
def join_theta(t):
    return t.nation.join(t.region, c("n_nationkey") < c("r_regionkey")).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey < r_regionkey")
def join_theta_outer(t):
    return t.nation.join(F.broadcast(t.region), c("n_nationkey") < c("r_regionkey"), "left").select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20")
def join_residual(t):
    return t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > c("c_acctbal") * 20), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND c_nationkey = 3")
def join_merge(t):
    return t.customer.where("c_nationkey = 3").join(t.orders.hint("merge"), c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND c_nationkey = 4")
def join_shuffle_hash(t):
    return t.customer.where("c_nationkey = 4").hint("shuffle_hash").join(t.orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_index_lookup(t):
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) USING (k)")
def join_using(t):
    return t.nation.select(c("n_regionkey").alias("k"), c("n_name").alias("a")).join(t.region.select(c("r_regionkey").alias("k"), c("r_name").alias("b")), ["k"]).select("k", "a", "b")


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 9) FULL JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation WHERE n_nationkey > 5) USING (k)")
def join_using_full(t):
    a, b = t.nation.where("n_nationkey < 9"), t.nation.where("n_nationkey > 5")
    return a.select(c("n_nationkey").alias("k"), c("n_name").alias("a")).join(b.select(c("n_nationkey").alias("k"), c("n_name").alias("b")), ["k"], "full").select("k", "a", "b")


@query("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)")
def join_natural(t):
    t.nation.select(c("n_regionkey").alias("k"), c("n_name").alias("a")).createOrReplaceTempView("nat_a")
    t.region.select(c("r_regionkey").alias("k"), c("r_name").alias("b")).createOrReplaceTempView("nat_b")
    return t.spark.sql("SELECT k, a, b FROM nat_a NATURAL JOIN nat_b")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_in(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_not_in(t):
    return not_in(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey")


# aggregates


@query("SELECT count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_global(t):
    return t.lineitem.agg(n("n"), money("l_quantity", "s"), F.round(F.avg("l_extendedprice"), 4).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS avg_disc,
count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_group(t):
    rows = t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(money("l_quantity", "sum_qty"), money(c("l_extendedprice") * (1 - c("l_discount")), "net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), n("n"))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(n("n")).where("n > 12")


@query("""SELECT o_orderstatus, count(DISTINCT o_custkey)::BIGINT AS n, sum(DISTINCT o_custkey)::BIGINT AS s, round(avg(DISTINCT o_custkey), 4) AS a, min(DISTINCT o_custkey) AS lo,
max(DISTINCT o_custkey) AS hi FROM orders GROUP BY o_orderstatus""")
def agg_distinct_each(t):
    k = c("o_custkey")
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct(k).alias("n"), F.sum_distinct(k).alias("s"), F.round(F.expr("avg(DISTINCT o_custkey)"), 4).alias("a"), F.min(k).alias("lo"), F.max(k).alias("hi"))


@query("SELECT count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    return t.orders.where("o_orderkey < 0").agg(n("n"), F.sum("o_orderkey").alias("s"), F.avg("o_totalprice").alias("a"))


@query("SELECT count(o_orderkey)::BIGINT AS with_order, count(*)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def agg_count_column(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").agg(F.count("o_orderkey").alias("with_order"), n("n"))


@query("SELECT (l_orderkey % 10)::BIGINT AS bucket, count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_orderkey % 10")
def group_by_expr(t):
    return t.lineitem.groupBy((c("l_orderkey") % 10).alias("bucket")).agg(n("n"), F.sum("l_linenumber").alias("s"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey AS k, count(*)::BIGINT AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey < 3) ON c_custkey = o_custkey GROUP BY o_orderkey")
def group_null_key(t):
    return t.customer.join(t.orders.where("o_orderkey < 3"), c("c_custkey") == c("o_custkey"), "left").groupBy(c("o_orderkey").alias("k")).agg(n("n"))


@query("SELECT count(*)::BIGINT AS n FROM lineitem")
def count_metadata(t):
    return t.lineitem.agg(n("n"))


# windows: aggregates cover the whole partition

ORDER = ["o_orderdate", "o_orderkey"]
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
FRAME = OVER + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _ranking(name: str, function: str, kind: str) -> None:
    spark_kind = {"BIGINT": "long", "DOUBLE": "double"}[kind]

    @query(f"SELECT o_orderkey, CAST({function} {OVER}) AS {kind}) AS v FROM orders", name=f"win_{name}")
    def run(t):
        return t.orders.select("o_orderkey", F.expr(function).over(ranked("o_custkey", order=ORDER)).cast(spark_kind).alias("v"))


def _whole_partition(name: str, sql: str, made) -> None:
    @query(f"SELECT o_orderkey, {sql} AS v FROM orders", name=f"win_{name}")
    def run(t):
        return t.orders.select("o_orderkey", made(whole("o_custkey", order=ORDER)).alias("v"))


_ranking("row_number", "row_number()", "BIGINT")
_ranking("rank", "rank()", "BIGINT")
_ranking("dense_rank", "dense_rank()", "BIGINT")
_ranking("lag", "lag(o_totalprice)", "DOUBLE")
_ranking("lag_n", "lag(o_totalprice, 3)", "DOUBLE")
_ranking("lead", "lead(o_totalprice)", "DOUBLE")
_ranking("lead_n", "lead(o_totalprice, 2)", "DOUBLE")
_whole_partition("sum", f"round(sum(o_totalprice) {FRAME}, 2)", lambda w: F.round(F.sum("o_totalprice").over(w), 2))
# an average of amounts in hundredths, free of the order in which they were added up
_whole_partition("avg", f"round(avg(o_totalprice) {FRAME} * count(*) {FRAME}, 2) / count(*) {FRAME}", lambda w: F.round(F.avg("o_totalprice").over(w) * F.count(lit(1)).over(w), 2) / F.count(lit(1)).over(w))
_whole_partition("count", f"(count(*) {FRAME})::BIGINT", lambda w: F.count(lit(1)).over(w))
_whole_partition("min", f"min(o_totalprice) {FRAME}", lambda w: F.min("o_totalprice").over(w))
_whole_partition("max", f"max(o_totalprice) {FRAME}", lambda w: F.max("o_totalprice").over(w))


# sorting, limits, set operations


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY 2, 1 LIMIT 20")
def order_position(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderkey, o_orderdate FROM orders ORDER BY 2, 1 LIMIT 20")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def order_nonprojected(t):
    return t.orders.orderBy("o_totalprice", "o_orderkey").limit(20).select("o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey < 40) ON c_custkey = o_custkey ORDER BY o_orderkey ASC NULLS FIRST, c_custkey LIMIT 30")
def order_nulls_smallest(t):
    return t.customer.join(t.orders.where("o_orderkey < 40"), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey").orderBy("o_orderkey", "c_custkey").limit(30)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(5).limit(10)


def _keys(t):
    return t.supplier.select(c("s_nationkey").alias("k")), t.customer.select(c("c_nationkey").alias("k"))


_S, _C = "SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer"
for _name, _f, _sql in (
    ("union_all", lambda a, b: a.unionAll(b), "UNION ALL"),
    ("union", lambda a, b: a.union(b).distinct(), "UNION"),
    ("intersect", lambda a, b: a.intersect(b), "INTERSECT"),
    ("intersect_all", lambda a, b: a.intersectAll(b), "INTERSECT ALL"),
    ("except", lambda a, b: a.subtract(b), "EXCEPT"),
    ("except_all", lambda a, b: a.exceptAll(b), "EXCEPT ALL"),
):
    query(f"{_S} {_sql} {_C}", name=_name)(lambda t, f=_f: f(*_keys(t)))


@query("(SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region) EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 5")
def setop_chain(t):
    return t.nation.select(c("n_nationkey").alias("k")).unionAll(t.region.select(c("r_regionkey").alias("k"))).subtract(t.supplier.where("s_suppkey < 5").select(c("s_nationkey").alias("k")))


# subqueries and CTE


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def scalar_subquery(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9D FROM orders)")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar(t):
    most = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("m"))
    return t.orders.join(most, (c("o_custkey") == c("k")) & (c("o_totalprice") == c("m"))).select("o_orderkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n FROM customer")
def subquery_in_projection(t):
    t.customer.createOrReplaceTempView("customer")
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")


_CTE = "WITH s AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT max(n) AS n FROM s) SELECT s.k, CAST(s.n AS BIGINT) AS n FROM s JOIN m ON s.n = m.n UNION ALL SELECT k, CAST(n AS BIGINT) AS n FROM s WHERE n < 3"


@query(_CTE)
def cte_multi_ref(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(_CTE)


# scalar expressions


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_searched(t):
    return t.orders.select("o_orderkey", F.when(c("o_totalprice") > 300000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low").alias("band"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def case_simple(t):
    return t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).alias("code"))


@query("SELECT c_custkey, coalesce(o_orderkey, -1)::BIGINT AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def coalesce(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", lit(-1)).alias("k"))


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation")
def nullif(t):
    return t.nation.select("n_nationkey", F.nullif("n_regionkey", lit(2)).alias("r"))


@query("SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, o_orderkey::DOUBLE AS f, o_orderkey::VARCHAR AS s FROM orders")
def cast_numbers(t):
    rows = t.orders
    return rows.select("o_orderkey", exprs.cast_int(c("o_totalprice"), "double").alias("i"), c("o_orderkey").cast("double").alias("f"), exprs.cast_text(c("o_orderkey")).alias("s"))


@query("SELECT v, CASE WHEN lower(trim(v)) IN ('true', 't', 'yes', 'y', 'on', '1') THEN true ELSE false END AS b FROM (VALUES ('true'), (' T '), ('on'), ('OFF'), ('0'), ('no')) x(v)")
def cast_boolean(t):
    rows = t.spark.createDataFrame([("true",), (" T ",), ("on",), ("OFF",), ("0",), ("no",)], "v string")
    return rows.select("v", exprs.cast_bool(c("v")).alias("b"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber * 2)::BIGINT AS a, (l_orderkey - 7)::BIGINT AS s, (l_orderkey // 7)::BIGINT AS d, (l_orderkey % 7)::BIGINT AS m FROM lineitem")
def arith(t):
    rows = t.lineitem
    return rows.select("l_orderkey", "l_linenumber", (c("l_orderkey") + c("l_linenumber") * 2).alias("a"), (c("l_orderkey") - 7).alias("s"), exprs.int_div("l_orderkey", "7").alias("d"), (c("l_orderkey") % 7).alias("m"))


@query("SELECT event_id, CAST(props->'k' AS VARCHAR) AS k FROM events")
def json_get(t):
    return t.events.select("event_id", exprs.json_get(c("props"), "k").alias("k"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT > 50")
def json_get_text(t):
    return t.events.select("event_id", exprs.json_get_text(c("props"), "k").cast("long").alias("k")).where("k > 50")


@query("SELECT event_id, (props->>'absent') IS NULL AS missing FROM events")
def json_missing(t):
    return t.events.select("event_id", exprs.json_get_text(c("props"), "absent").isNull().alias("missing"))
