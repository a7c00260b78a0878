"""Every query with oracle SQL equals DuckDB on the small scale factor."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as E

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_a_builder():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 50


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = duck.execute(ORACLE[key])
    ocols = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(ocols, want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["genre", "rank", "mid", "avg"]
    assert df.count() > 0
