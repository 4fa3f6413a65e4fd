import pytest
from pyspark.sql import functions as F

from cubelark.operators import bloom
from cubelark.operators.predicates import Predicate, all_of, any_of
from cubelark.operators.relational import group_sum, join, project
from cubelark.sources.tables import jdbc, load_tables, read_tbl, refresh_delete, run_script, statements, table
from cubelark.schemas import SCHEMAS


def test_filter_is_a_disjunction_of_conjunctions(spark):
    rows = [("1995-01-01", "x", "9"), ("1996-12-31", "x", "9"), ("1995-11-11", "x", "9"), ("1997-01-01", "comm1", "1"), ("1994-12-31", "comm1", "Q"), ("no date", "x", "1")]
    df = spark.createDataFrame(rows, "shipdate string, comment string, quantity string")
    where = any_of(
        all_of(Predicate("shipdate", ">=", "1995-01-01", "date"), Predicate("shipdate", "<=", "1996-12-31", "date")),
        all_of(Predicate("comment", "=", "comm1"), Predicate("quantity", "=", "1")),
    )
    assert [r[0] for r in df.where(where).collect()] == ["1995-01-01", "1996-12-31", "1995-11-11", "1997-01-01"]
    assert df.where(any_of()).count() == 6


def test_projection_prefixes_and_rejects_unknown_names(spark):
    df = spark.createDataFrame([(1, 2)], "col1 int, col2 int")
    assert project(df, ["col1", "col2"], "1_").columns == ["1_col1", "1_col2"]
    with pytest.raises(ValueError):
        project(df, ["nope"])


def test_group_sum_of_the_small_fixture(spark):
    rows = [(0, 1, "a", 11111), (3, 1, "a", 11111), (1, 2, "b", 11123), (6, 2, "g", 11123), (7, 2, "g", 11123), (9, 2, "b", 21156)]
    df = spark.createDataFrame(rows, "id int, k1 int, k2 string, k3 int")
    got = {tuple(r)[:3]: r["s"] for r in group_sum(df, ["k1", "k2", "k3"], F.col("id"), "s").collect()}
    assert got == {(1, "a", 11111): 3, (2, "b", 11123): 1, (2, "g", 11123): 13, (2, "b", 21156): 9}


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "merge"])
def test_joins_agree(spark, strategy):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "k int, b string")
    assert sorted(map(tuple, join(a, b, "k", ["a"], ["b"], right_prefix="r_", strategy=strategy).collect())) == [("y", "p"), ("z", "p")]


@pytest.mark.parametrize("keys", [[1, 2, 3], [1, 2, 3, 44797], [58799], [0], [None, 5]])
def test_bloom_filter_has_no_false_negatives(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    left = bloom.probe(df, "k", bloom.or_bits(bloom.build_bits(df.limit(1), "k"), bloom.build_bits(df, "k")))
    assert sorted(r[0] for r in left.collect()) == sorted(k for k in keys if k is not None)


def test_bloom_filter_drops_other_bits_and_joins_exactly(spark):
    big = spark.createDataFrame([(k,) for k in (5, 5, 70)], "b long")
    small = spark.range(200).withColumnRenamed("id", "s")
    assert bloom.probe(small, "s", bloom.build_bits(big, "b")).count() == 2
    assert bloom.bloom_join(big, "b", small, "s", bits=11).count() == 3
    assert bloom.bloom_join(big, "b", small, "s", where=F.col("s") > 60).count() == 1
    many = spark.range(0, 60_000, 3).withColumnRenamed("id", "s")  # too many for the default length
    assert bloom.bloom_join(spark.range(60_000).withColumnRenamed("id", "b"), "b", many, "s").count() == 20_000
    assert bloom.probe(spark.range(60_000), "id", bloom.build_bits(many, "s", bits := bloom.bits_for(20_000)), bits).count() < 25_000


def test_bloom_bits_grow_with_the_keys_up_to_a_bound():
    sizes = [bloom.bits_for(n) for n in (0, 10, 6242, 10**5, 10**6, 10**9)]
    assert sizes[0] == sizes[1] == 99881 and sizes == sorted(sizes) and sizes[-1] <= bloom.MOST_BITS
    assert all(n % d for n in sizes for d in range(2, 2000))


def test_tbl_round_trip(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA|c|\n1|ASIA||\n")
    assert read_tbl(spark, str(tmp_path / "region.tbl"), SCHEMAS["region"]).columns == ["r_regionkey", "r_name", "r_comment"]
    load_tables(spark, {"region": str(tmp_path / "region.tbl")}, str(tmp_path))
    got = table(spark, str(tmp_path), "region")
    assert sorted(r["r_name"] for r in got.collect()) == ["AFRICA", "ASIA"]
    assert refresh_delete(got, spark.createDataFrame([(0,)], "r_regionkey long"), "r_regionkey").count() == 1
    assert run_script(spark, "select 1; select 2;") == 2


def test_scripts_split_outside_quotes_and_comments():
    script = "select 'a;b', 'it''s;'; -- no; end\nselect \"x;\"; /* ;; */ ; select `c;d`;;"
    assert [s.splitlines()[-1] for s in statements(script)] == ["select 'a;b', 'it''s;'", 'select "x;"', "select `c;d`"]


def test_jdbc_gathers_a_relation_by_predicates(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path / 'db'};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(20).selectExpr("id", "id % 3 as k").write.jdbc(url, "numbers", "overwrite", driver)
    got = jdbc(spark, url, "numbers", [f'"k" = {i}' for i in range(3)], driver)
    assert sorted(r["id"] for r in got.collect()) == list(range(20)) and got.rdd.getNumPartitions() == 3


def test_text_functions(spark):
    from cubelark.functions.strings import insert, length

    df = spark.createDataFrame([("Quadratic",), ("é",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(length(F.col("t")), insert(F.col("t"), 3, 4, "What"), insert(F.col("t"), 1, 1, "")).collect()]
    assert got == [(9, "QuWhattic", "uadratic"), (1, "é", ""), (0, "", ""), (None, None, None)]


def test_generated_tables_hold_together(spark):
    from cubelark.sources.generator import generated, refresh_set

    t = generated(spark, 0.001)
    assert {n: df.dtypes for n, df in t.items()} == {n: [(f.name, f.dataType.simpleString()) for f in kind] for n, kind in SCHEMAS.items()}
    line, offers = t["lineitem"], t["partsupp"]
    assert line.join(offers, (line.l_partkey == offers.ps_partkey) & (line.l_suppkey == offers.ps_suppkey), "left_anti").count() == 0
    assert offers.select("ps_partkey", "ps_suppkey").distinct().count() == 4 * t["part"].count()
    assert t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).count() == t["orders"].count() == 1500
    keys = [{r[0] for r in refresh_set(spark, 0.001, n)[0].select("o_orderkey").collect()} for n in (1, 2)]
    assert keys == [{1501, 1502}, {1503, 1504}]


def test_reports_say_when_there_is_more(spark, monkeypatch):
    from cubelark.sources import sinks

    monkeypatch.setattr(sinks, "MOST_SHOWN", 3)
    assert sinks.report(spark.range(5), 0).splitlines() == ["id", "0", "1", "2", "... more than 3 rows"]
    assert sinks.report(spark.range(3), 0).splitlines() == ["id", "0", "1", "2"] and len(sinks.report(spark.range(9), 4).splitlines()) == 5
