"""Registered queries of the engine, each with the SQL that any engine can answer it by."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import engine as cube
from .cube.model import LEVELS, CubeView, History, cuboid_name, cuboids, is_stored
from .cube.shell import Shell, random_walk
from .functions import strings
from .functions.dates import recode, year, year_month, year_prefix
from .operators import bloom
from .operators.predicates import Predicate, all_of, any_of
from .operators.relational import group_sum, join, project, share, volume, with_labels
from .plans.catalogue import PORTABLE, QUERIES
from .plans.shipping import q7, q8
from .schemas import SCHEMAS
from .sources.generator import generated, refresh_set
from .sources.sinks import dump_all, formatted, report, write_result
from .sources.tables import load_tables, numbers, partition_of, read_tbl, recreate_table, refresh_delete, refresh_insert, run_script, scratch, table, write_tbl

Query = Callable[[SparkSession, str], DataFrame]
MADE: dict[str, tuple[Query, str | None]] = {}

_VOLUME = "cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2)))"
_NATIONS = ("NATION_6", "NATION_7")


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        MADE[f.__name__] = (f, sql)
        return f

    return add


for _name, _q in QUERIES.items():
    MADE[f"tpch_{_name}"] = (_q.run, PORTABLE[_name].literal_sql())

MADE["plan_q7"] = (partial(q7, one=_NATIONS[0], two=_NATIONS[1]), PORTABLE["q7"].literal_sql())
MADE["plan_q8"] = (partial(q8, nation="NATION_6", region="AMERICA", kind="ECONOMY"), PORTABLE["q8"].literal_sql())
MADE["bloom_join_q7"] = (partial(q7, one=_NATIONS[0], two=_NATIONS[1], bloom=True), PORTABLE["q7"].literal_sql())
MADE["bloom_join_q8"] = (partial(q8, nation="NATION_6", region="AMERICA", kind="ECONOMY", bloom=True), PORTABLE["q8"].literal_sql())


@_query(
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem
where (cast(l_shipdate as date) >= date '1995-01-01' and cast(l_shipdate as date) <= date '1996-12-31') or (l_returnflag = 'R' and l_quantity = 1)"""
)
def op_select_dnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = any_of(
        all_of(Predicate("l_shipdate", ">=", "1995-01-01", "date"), Predicate("l_shipdate", "<=", "1996-12-31", "date")),
        all_of(Predicate("l_returnflag", "=", "R"), Predicate("l_quantity", "=", 1, "number")),
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return lines.where(where).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@_query("select n_nationkey as n1_n_nationkey, n_name as n1_n_name from nation")
def op_project_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], "n1_")


def _join(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "key")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "key")
    return join(supplier, nation, "key", ["s_suppkey"], ["n_name"], None, F.col("n_name").isin("NATION_3", "NATION_8", "NATION_12"), "", "n1_", strategy)


for _strategy in ("auto", "broadcast", "merge"):  # nation's size is fixed, so it may be broadcast
    MADE[f"op_join_{_strategy}"] = (partial(_join, strategy=_strategy), "select s_suppkey, n_name as n1_n_name from supplier join nation on n_nationkey = s_nationkey where n_name in ('NATION_3', 'NATION_8', 'NATION_12')")


@_query("select l_returnflag, cast(extract(year from l_shipdate) as bigint) as l_year, sum(" + _VOLUME + ") as revenue from lineitem where l_quantity >= 10 group by 1, 2")
def op_groupby_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag", year(F.col("l_shipdate")).alias("l_year")], volume(), "revenue", F.col("l_quantity") >= 10)


@_query("select l_returnflag, l_linestatus, l_linenumber, cast(sum(cast(l_quantity as bigint)) as bigint) as total from lineitem group by 1, 2, 3")
def op_groupby_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], F.col("l_quantity").cast("long"), "total")


@_query(
    """select o_orderpriority, round(cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(15,2)) else 0 end) as double)
  / cast(sum(cast(o_totalprice as decimal(15,2))) as double), 9) as part from orders group by 1"""
)
def op_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(15,2)")
    return share(table(spark, sf_dir, "orders"), ["o_orderpriority"], price, F.col("o_orderstatus") == "F", "part").withColumn("part", F.round("part", 9))


@_query("select c_custkey, n_name from customer left join (select * from nation where n_nationkey < 20) n on n_nationkey = c_nationkey")
def op_left_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return with_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), labels, "c_nationkey").select("c_custkey", "n_name")


@_query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def op_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@_query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def op_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    return table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@_query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def op_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@_query("select c_nationkey as nation from customer union all select s_nationkey from supplier")
def op_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey"))


@_query("select distinct l_returnflag, l_linestatus from lineitem")
def op_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@_query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def op_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_query("select range as number from range(1, 100001)")
def op_numbers_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark)


@_query(
    """select o_orderkey, cast(extract(year from o_orderdate) * 100 + extract(month from o_orderdate) as int) as year_month,
  cast(substring(cast(cast(o_orderdate as date) as varchar), 1, 4) as int) as year_prefix, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as status from orders"""
)
def op_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", year_month(day).alias("year_month"), year_prefix(day).alias("year_prefix"), recode(F.col("o_orderstatus"), 0, F=1, O=2).alias("status"))


@_query("select l_returnflag, string_agg(distinct l_linestatus, '' order by l_linestatus) as statuses, max(l_linenumber) as top from lineitem group by 1")
def op_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.concat_ws("", F.sort_array(F.collect_set("l_linestatus"))).alias("statuses")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(statuses, F.max("l_linenumber").alias("top"))


@_query("select cast(count(distinct (s_suppkey * 107 + 1009) % 99881) as bigint) as bits_set from supplier where s_nationkey in (6, 7)")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_nationkey in (6, 7)")
    halves = [s.where(f"s_suppkey % 2 = {i}") for i in (0, 1)]
    return bloom.bits_set(bloom.or_bits(*[bloom.build_bits(h, "s_suppkey") for h in halves]))


@_query("select p_partkey, p_brand from part where (p_partkey * 107 + 1009) % 99881 in (select (l_partkey * 107 + 1009) % 99881 from lineitem where l_quantity = 50) and p_size < 25")
def bloom_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50")
    return bloom.probe(table(spark, sf_dir, "part"), "p_partkey", bloom.build_bits(lines, "l_partkey"), where=F.col("p_size") < 25).select("p_partkey", "p_brand")


@_query("select supp_nation || '|' || cust_nation || '|' || l_year || chr(9) || revenue as line from (" + PORTABLE["q7"].literal_sql() + ") q")
def sink_q7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(q7(spark, sf_dir, *_NATIONS), ["supp_nation", "cust_nation", "l_year"], "revenue")


@_query("select part_no, count(*) as n_rows from (select cast(o_custkey % 8 as int) as part_no from lineitem join orders on o_orderkey = l_orderkey) group by 1")
def layout_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_of("lineitem", table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")).groupBy("part_no").agg(F.count("*").alias("n_rows"))


@_query("select o_orderkey, o_totalprice from orders union all select o_orderkey + 1000000000, o_totalprice from orders where o_orderkey % 1000 = 0")
def refresh_insert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return refresh_insert(o, o.where("o_orderkey % 1000 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


@_query("select o_orderkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from orders where o_orderkey % 1000 = 0)")
def refresh_delete_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return refresh_delete(o, o.where("o_orderkey % 1000 = 0"), "o_orderkey")


_ALL = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")


@_query(" union all ".join(f"select '{t}' as name, count(*) as n_rows from {t}" for t in _ALL))
def validator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows")) for t in _ALL]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@_query("select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'N' and l_linestatus <> 'F'")
def op_filter_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = any_of(all_of(Predicate("l_returnflag", "!=", "N"), Predicate("l_linestatus", "!=", "F")))
    return table(spark, sf_dir, "lineitem").where(where).select("l_orderkey", "l_linenumber")


@_query("select s_suppkey from supplier")
def op_filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(any_of()).select("s_suppkey")


@_query("select o_orderkey from orders where cast(o_orderdate as date) >= date '1996-01-01' and cast(o_orderdate as date) < date '1996-02-01'")
def op_filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return orders.where(any_of(all_of(Predicate("o_orderdate", ">=", "1996-01-01", "date"), Predicate("o_orderdate", "<", "1996-02-01", "date")))).select("o_orderkey")


@_query("select true as filter_refused, true as projection_refused")
def op_unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a filter on, and a projection to, a column that isn't there are refused."""
    nation, refused = table(spark, sf_dir, "nation"), []
    for use in (lambda: nation.where(Predicate("n_nope", "=", "x").to_column()).schema, lambda: project(nation, ["n_nope"])):
        try:
            use()
            refused.append(False)
        except (AnalysisException, ValueError):
            refused.append(True)
    return spark.range(1).select(F.lit(refused[0]).alias("filter_refused"), F.lit(refused[1]).alias("projection_refused"))


@_query("select p_partkey, cast(length(p_name) as bigint) as n_chars, case when length(p_name) >= 2 then substr(p_name, 1, 1) || '__' || substr(p_name, 5) else p_name end as changed from part")
def op_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.length(F.col("p_name")).alias("n_chars"), strings.insert(F.col("p_name"), 2, 3, "__").alias("changed"))


@_query("select cast(count(distinct (l_partkey * 107 + 1009) % 99881) as bigint) as bits_set from lineitem")
def bloom_bits_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.bits_set(bloom.build_bits(table(spark, sf_dir, "lineitem"), "l_partkey"))


@_query("select cast(k as bigint) as k from (values (0), (44797), (58799), (99881)) t(k)")
def bloom_hash_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose hash is the first and the last bit pass their own vector."""
    keys = spark.createDataFrame([(0,), (44797,), (58799,), (99881,)], "k long")
    return bloom.probe(keys, "k", bloom.or_bits(bloom.build_bits(keys.where("k < 50000"), "k"), bloom.build_bits(keys, "k")))


@_query("select r_regionkey, r_name from region")
def source_tbl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "region.tbl")
    write_tbl(table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit("none").alias("r_comment")), path)
    return read_tbl(spark, path, SCHEMAS["region"]).select("r_regionkey", "r_name")


@_query("select n_nationkey, n_name, n_regionkey from nation")
def source_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A `.tbl` file loaded twice: the second load replaces the first."""
    path = scratch(spark, "nation.tbl")
    write_tbl(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("none").alias("n_comment")), path)
    for _ in range(2):
        load_tables(spark, {"nation": path}, scratch(spark, "loaded"))
    return table(spark, scratch(spark, "loaded"), "nation").select("n_nationkey", "n_name", "n_regionkey")


@_query("select s_suppkey, s_name from supplier where s_nationkey < 5")
def source_recreate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, supplier = f"cubelark_{uuid.uuid4().hex}", table(spark, sf_dir, "supplier")
    recreate_table(supplier.limit(3), name)
    recreate_table(supplier.where("s_nationkey < 5").select("s_suppkey", "s_name"), name)
    return spark.table(name)


@_query("select 'a;b' as t, cast(3 as bigint) as n, 7 as v")
def source_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with a quoted separator, and a session variable."""
    script = """
create or replace temporary view cubelark_script as select 'a;b' as t, count(*) as n from range(3); -- no; end here
declare or replace variable cubelark_seven int default 5;
set variable cubelark_seven = cubelark_seven + 2;"""
    run_script(spark, script)
    return spark.sql("select t, n, cubelark_seven as v from cubelark_script")


@_query("select n_nationkey, n_name from nation where n_regionkey = 1")
def sink_result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as one text file over an older one, and read back."""
    path, nation = scratch(spark, "result"), table(spark, sf_dir, "nation")
    for rows in (nation, nation.where("n_regionkey = 1")):
        write_result(rows.select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey bigint, n_name string").option("sep", "|").csv(path)


@_query(
    " union all ".join(f"select '{t}' as name, count(*) as n_rows, count(*) as n_quoted from {t}" for t in _ALL)
    + " union all select 'partsupp', 4 * count(*), 4 * count(*) from part"
)
def sink_quoted_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the dumps of all eight tables, and those that begin and end with a quote."""
    path = scratch(spark, "dump")
    parts = [spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.count_if(F.col("value").rlike('^".*"$')).alias("n_quoted")) for name in dump_all(spark, sf_dir, path)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@_query("select 'r_regionkey|r_name' as line union all select r_regionkey || '|' || r_name from region")
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = report(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), 0)
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@_query("select * from (values ('region', 5), ('nation', 25), ('supplier', 20), ('customer', 300), ('part', 400), ('partsupp', 1600), ('orders', 3000), ('ordered', 3000), ('new orders', 3), ('new ordered', 3), ('old orders', 3)) t(name, n_rows)")
def generator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the generated tables and of a refresh set; lines are counted by their orders."""
    made = generated(spark, 0.002)
    orders, lines, old = refresh_set(spark, 0.002, 1)
    ordered = {"ordered": made.pop("lineitem").select("l_orderkey").distinct(), "new orders": orders, "new ordered": lines.select("l_orderkey").distinct(), "old orders": old}
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n_rows")) for name, df in (made | ordered).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# The cube.

_FACTS = f"""(select n_regionkey as c_region_id, c_nationkey as c_nation_id, l_partkey as product_id,
  cast(extract(year from o_orderdate) as int) as o_year, cast(extract(year from o_orderdate) * 100 + extract(month from o_orderdate) as int) as o_yearmonth,
  cast(o_orderdate as date) as o_date, {_VOLUME} as volume
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey) f"""
_MEASURES = "cast(sum(volume) as decimal(38,4)) as sum_volume, count(*) as count_volume"
_LABEL_SQL = {
    "c_region_id": ("c_region_name", "region", "r_regionkey", "r_name"),
    "c_nation_id": ("c_nation_name", "nation", "n_nationkey", "n_name"),
    "product_id": ("product_name", "part", "p_partkey", "p_name"),
}


def _view_sql(levels: tuple[str, ...], where: str = "true") -> str:
    keys = ", ".join(levels)
    rows = f"select {keys + ', ' if keys else ''}{_MEASURES} from {_FACTS} where {where}" + (f" group by {keys}" if keys else "")
    labels = [x for x in levels if x in _LABEL_SQL]
    shown = "".join(f", {_LABEL_SQL[x][3]} as {_LABEL_SQL[x][0]}" for x in labels)
    joins = "".join(f" left join {_LABEL_SQL[x][1]} on {_LABEL_SQL[x][2]} = v.{x}" for x in labels)
    return f"select v.*{shown} from ({rows}) v{joins}"


def _union_sql(wanted: list[tuple[str, ...]], measures: str) -> str:
    parts = []
    for w in wanted:
        shown = ", ".join(x if x in w else f"cast(null as {'date' if k.kind == 'date' else 'bigint' if k.kind == 'long' else 'int'}) as {x}" for x, k in LEVELS.items())
        parts.append(f"select '{'__'.join(w) or 'all'}' as cuboid, {shown}, {measures} from {_FACTS}" + (f" group by {', '.join(w)}" if w else ""))
    return " union all ".join(parts)


def _view(levels: tuple[str, ...]) -> CubeView:
    return CubeView({d.name: x for d in cube.BY_NAME.values() for x in levels if x in {y.name for y in d.levels}})


def _cuboid(spark: SparkSession, sf_dir: str, levels: tuple[str, ...]) -> DataFrame:
    return cube.query(spark, sf_dir, _view(levels))


for _levels in cuboids():
    MADE["cube_" + ("__".join(_levels) or "all")] = (partial(_cuboid, levels=_levels), _view_sql(_levels))

_STORED = [c for c in cuboids() if is_stored(c)]


@_query(_union_sql(_STORED, _MEASURES))
def cube_build_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.all_cuboids(cube.facts(spark, sf_dir), _STORED)


@_query(f"select cuboid, count(*) as n_rows, cast(sum(24{''.join(f' + case when {x} is not null then 8 else 0 end' for x in LEVELS)}) as bigint) as n_bytes from ({_union_sql(_STORED, _MEASURES)}) group by cuboid")
def cube_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.statistics(cube_build_stored(spark, sf_dir))


_COARSE = [(), ("c_region_id",), ("o_year",), ("c_region_id", "o_year"), ("c_nation_id", "o_yearmonth")]


@_query(_union_sql(_COARSE, "cast(sum(volume) as decimal(38,4)) as sum_volume, cast(cast(sum(volume) as decimal(38,4)) as double) / count(*) as avg_volume"))
def cube_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.averages(spark, sf_dir, _COARSE)


@_query(_union_sql(_COARSE, _MEASURES))
def cube_merge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cube.facts(spark, sf_dir)
    return cube.merge_delta(*[cube.all_cuboids(f.where(f"o_year {op} 1998"), _COARSE) for op in ("<", ">=")])


@_query(_union_sql(_STORED, "cast(sum(volume) as decimal(38,4)) as sum_volume, cast(cast(sum(volume) as decimal(38,4)) as double) / count(*) as avg_volume"))
def cube_averages_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.averages(spark, sf_dir, _STORED)


@_query(_union_sql(_STORED, _MEASURES))
def cube_merge_delta_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cube.facts(spark, sf_dir)
    return cube.merge_delta(*[cube.all_cuboids(f.where(f"o_year {op} 1998"), _STORED) for op in ("<", ">=")])


def _walk() -> History:
    """Drill product, drill time, dice 1995 to 1997, drill time, slice a month, drill location, roll product up."""
    h = History()
    h.go(h.view.drill_down("product"))
    h.go(h.view.drill_down("time"))
    h.go(h.view.dice({"time": (1995, 1997)}))
    h.go(h.view.drill_down("time"))
    h.go(h.view.slice("time", 199601))
    h.go(h.view.drill_down("customer_location"))
    h.go(h.view.roll_up("product"))
    return h


@_query(_view_sql(("c_region_id", "o_yearmonth"), "o_yearmonth = 199601"))
def cube_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.query(spark, sf_dir, _walk().view)


@_query(_view_sql(("o_year", "product_id"), "o_year between 1995 and 1997"))
def cube_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _walk()
    return cube.query(spark, sf_dir, h.past[3])


@_query(_view_sql(("o_yearmonth", "product_id")))
def cube_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.query(spark, sf_dir, _walk().past[4])


@_query(_view_sql(("c_region_id", "o_yearmonth", "product_id"), "o_yearmonth = 199601"))
def cube_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _walk()
    return cube.query(spark, sf_dir, h.undo())


@_query(_view_sql(("c_nation_id", "o_date"), "o_date between date '1996-01-01' and date '1996-03-31'") + " order by 1, 2 limit 20")
def cube_view_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(("c_nation_id", "o_date")).dice({"time": (dt.date(1996, 1, 1), dt.date(1996, 3, 31))})
    return cube.query(spark, sf_dir, view, limit=20)


_ALL_CUBOIDS = cuboids()


@_query(_union_sql(_ALL_CUBOIDS, "cast(sum(volume) as decimal(38,4)) as sum_volume, cast(cast(sum(volume) as decimal(38,4)) as double) / count(*) as avg_volume"))
def cube_averages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.averages(spark, sf_dir, _ALL_CUBOIDS)


_BUILT: dict[tuple[str, str], str] = {}


def _built(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a cube over these tables, built once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = scratch(spark, f"cube-{uuid.uuid4().hex}")
        cube.build(spark, sf_dir, path)
        _BUILT[key] = path
    return _BUILT[key]


def _routed(spark: SparkSession, sf_dir: str, view: CubeView) -> DataFrame:
    return cube.query(spark, sf_dir, view, _built(spark, sf_dir))


#: Views answered from a built cube; the last one isn't stored and goes to the facts.
for _levels in [(), ("product_id",), ("c_region_id", "o_year"), ("c_nation_id", "o_date"), ("c_nation_id", "product_id"), ("c_region_id", "o_year", "product_id"), ("o_yearmonth", "product_id")]:
    MADE["cube_routed_" + ("__".join(_levels) or "all")] = (partial(_routed, view=_view(_levels)), _view_sql(_levels))


@_query(" union all ".join(f"select '{cuboid_name(w)}' as cuboid, count(*) as n_rows, true as on_disk from (select 1 from {_FACTS}{' group by ' + ', '.join(w) if w else ' limit 1'}) c" for w in _STORED)
        + " union all select 'base', " + " + ".join(f"(select count(*) from {t})" for t in ("nation", "customer", "orders", "lineitem")) + ", true")
def cube_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stored cuboid and of the base tables; bytes of files differ from engine to engine, so only that there are any."""
    return cube.storage(spark, sf_dir, _built(spark, sf_dir)).select("cuboid", "n_rows", (F.col("n_bytes") > 0).alias("on_disk"))


@_query(_view_sql(("c_nation_id", "o_yearmonth"), "o_yearmonth between 199601 and 199606 and c_nation_id between 3 and 9"))
def cube_dice_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(("c_nation_id", "o_yearmonth")).dice({"time": (199601, 199606), "customer_location": (3, 9)})
    return _routed(spark, sf_dir, view)


def _regions(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    return {r[0]: r[1] for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()}  # 25 rows


@_query(_view_sql(("c_region_id", "o_yearmonth"), "o_yearmonth between 199602 and 199604 and c_region_id = 3"))
def cube_carried_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days become their months, a nation its region."""
    view = _view(("c_nation_id", "o_date")).dice({"time": (dt.date(1996, 2, 9), dt.date(1996, 4, 2)), "customer_location": (8, 8)})
    return _routed(spark, sf_dir, view.roll_up("time", True).roll_up("customer_location", True, _regions(spark, sf_dir)))


@_query(_view_sql(("o_date",), "o_date between date '1996-01-01' and date '1997-12-31'"))
def cube_carried_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years become their months, and those their days."""
    return _routed(spark, sf_dir, _view(("o_year",)).dice({"time": (1996, 1997)}).drill_down("time", True).drill_down("time", True))


#: Seed of a walk whose last view has two levels and a range.
WALK = 56


def _walked() -> CubeView:
    shell = Shell(None, "")
    for command in random_walk(9, seed=WALK):
        shell.step(command)
    return shell.history.view


def _where(view: CubeView) -> str:
    quoted = {d: [f"date '{x}'" if isinstance(x, dt.date) else str(x) for x in r] for d, r in view.ranges.items()}
    return " and ".join(f"{view.levels[d]} between {lo} and {hi}" for d, (lo, hi) in quoted.items()) or "true"


@_query(_view_sql(_walked().columns, _where(_walked())))
def cube_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that a random navigation ends in."""
    return _routed(spark, sf_dir, _walked())


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in MADE.items() if sql}
