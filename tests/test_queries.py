"""Registered queries against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from cubelark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.MADE))
def test_query_matches_sql(spark, duck, name):
    query, sql = registry.MADE[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_parameters_and_streams(spark):
    from cubelark.plans.catalogue import QUERIES
    from cubelark.plans.parameters import draw, stream

    assert all(set(draw(n, 1)) == set(QUERIES[n].params) for n in QUERIES)
    assert sorted(stream(3)) == sorted(stream(0)) and stream(3) != stream(0)


def test_streams_from_a_file(tmp_path):
    from cubelark.plans.parameters import read_streams, stream

    (tmp_path / "orders.txt").write_text(" ".join(map(str, range(22, 0, -1))) + "\n" + ", ".join(map(str, range(1, 23))) + "\n")
    orders = read_streams(str(tmp_path / "orders.txt"))
    assert stream(0, orders)[:2] == ["q22", "q21"] and stream(3, orders)[:2] == ["q1", "q2"]
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        read_streams(str(tmp_path / "bad.txt"))


def test_drawn_parameters_select_rows_somewhere(spark):
    from cubelark.plans.catalogue import QUERIES
    from cubelark.plans.parameters import draw

    for name in ("q9", "q13", "q16", "q20"):
        assert any(QUERIES[name].run(spark, SF, **draw(name, seed)).count() for seed in range(4))
