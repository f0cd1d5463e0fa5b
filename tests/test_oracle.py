"""Every query with an SQL form gives the same rows as DuckDB."""

import math

import pytest

from pairloom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def clean(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def key(row):
    return tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=key)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and abs(a - b) <= 1e-6 * max(1.0, abs(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = table(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert all(len(a) == len(b) and all(same(x, y) for x, y in zip(a, b)) for a, b in zip(got, want))


def test_names_cover_each_other():
    assert set(SQL) <= set(QUERIES)
