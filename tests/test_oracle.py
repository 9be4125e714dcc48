"""Every registered core query against DuckDB on the same tables."""

import math

import pytest

from kelvane.plans import catalogue

from .conftest import SF

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float) or hasattr(v, "as_integer_ratio"):
            f = float(v)
            return "None" if math.isnan(f) else f"{f:.6g}" if f != int(f) else str(int(f))
        return str(v)

    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, df.collect())
    if name not in ORACLE:
        assert got
        return
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(names, found.fetchall())
