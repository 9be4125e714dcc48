"""Registered queries whose work grows with their table."""

import numpy as np
import pytest

from kelvane.plans import catalogue

from .conftest import SF

QUERIES = catalogue.queries()


def test_knn_join_takes_a_hundredth_of_the_rows(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(3000, 4)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["knn_join"](spark, str(tmp_path)).collect()
    x = v.astype(float)
    want = set()
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want |= {(q, int(i), k + 1) for k, i in enumerate(np.lexsort((np.arange(3000), d))[:5])}
    assert len(got) == 150 and {(r["vec_id"], r["near_vec_id"], r["rank"]) for r in got} == want


ONE_A_ROW = {"cast_numbers": "orders", "arith": "lineitem", "json_missing": "events", "project_alias": "lineitem", "unary_minus": "orders", "cdc_debezium": "events", "cdc_supabase": "events", "cdc_native": "events", "rest_embed_forward": "orders"}


@pytest.mark.parametrize("name", sorted(ONE_A_ROW))
def test_every_row_of_the_table(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{ONE_A_ROW[name]}.parquet").count()


@pytest.mark.parametrize("name", ["union_all", "union", "intersect", "intersect_all", "except", "except_all"])
def test_set_operations_take_all_customers(spark, duck, name):
    want = duck.execute(f"SELECT s_nationkey AS k FROM supplier {name.upper().replace('_', ' ')} SELECT c_nationkey AS k FROM customer").fetchall()
    assert sorted(tuple(r) for r in QUERIES[name](spark, SF).collect()) == sorted(want)
