"""A generator of the eight tables at any scale, and their refresh sets.

Every value is a hash of its row's key, so tables are made in parallel, need no
state, and are the same however many tasks make them. Keys, table sizes and domains are those
of the schema; texts are short stand-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parameters import MODES, NAME_WORDS, REGIONS, SEGMENTS, TYPES
from ..schemas import SCHEMAS

#: Rows at scale 1. An order has 1 to 7 lines, a part four suppliers.
BASE_ROWS = {"supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000}
#: First and last day of an order, and the share of the orders in a refresh set.
FIRST_DAY, DAYS, REFRESH = "1992-01-01", 2406, 0.001
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")


def _draw(what: str, upto: int | Column, *key: Column | str) -> Column:
    """A whole number from 0 below `upto`, by the row's key."""
    return F.pmod(F.xxhash64(F.lit(what), *key), F.lit(upto) if isinstance(upto, int) else upto)


def _one_of(what: str, values: tuple[str, ...], *key: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(what, len(values), *key) + 1).cast("int"))


def _money(what: str, low: int, high: int, *key: Column | str) -> Column:
    """An amount from `low` to `high`, in cents."""
    return ((_draw(what, high - low + 1, *key) + low) / 100).cast("decimal(15,2)")


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def _orders(keys: DataFrame, rows: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """orders and lineitem of the given order keys `id`."""
    o = keys.withColumn("day", F.date_add(F.lit(FIRST_DAY).cast("date"), _draw("day", DAYS, "id").cast("int")))
    line = o.withColumn("n", F.explode(F.sequence(F.lit(1), (_draw("lines", 7, "id") + 1).cast("int")))).select("id", "day", "n")
    key = ("id", "n")
    line = line.withColumn("part", _draw("part", rows["part"], *key) + 1).withColumn("quantity", _draw("quantity", 50, *key) + 1).withColumn("ship", F.date_add("day", (_draw("ship", 121, *key) + 1).cast("int")))
    line = line.withColumn("receipt", F.date_add("ship", (_draw("receipt", 30, *key) + 1).cast("int")))
    past = F.col("receipt") <= F.lit("1995-06-17").cast("date")
    lines = line.select(
        F.col("id").alias("l_orderkey"), F.col("part").alias("l_partkey"), _supplier(F.col("part"), _draw("of", 4, *key), rows["supplier"]).alias("l_suppkey"), F.col("n").alias("l_linenumber"),
        F.col("quantity").alias("l_quantity"), (F.col("quantity") * _price(F.col("part"))).alias("l_extendedprice"), _money("discount", 0, 10, *key).alias("l_discount"), _money("tax", 0, 8, *key).alias("l_tax"),
        F.when(past, _one_of("flag", ("R", "A"), *key)).otherwise("N").alias("l_returnflag"), F.when(F.col("ship") > F.lit("1995-06-17").cast("date"), "O").otherwise("F").alias("l_linestatus"),
        F.col("ship").alias("l_shipdate"), F.date_add("day", (_draw("commit", 61, *key) + 30).cast("int")).alias("l_commitdate"), F.col("receipt").alias("l_receiptdate"),
        _one_of("instruct", INSTRUCTIONS, *key).alias("l_shipinstruct"), _one_of("mode", MODES, *key).alias("l_shipmode"), _one_of("said", NAME_WORDS, *key).alias("l_comment"),
    )
    orders = o.select(
        F.col("id").alias("o_orderkey"), (_draw("customer", rows["customer"], "id") + 1).alias("o_custkey"), F.when(F.col("day") < F.lit("1995-03-17").cast("date"), "F").otherwise("O").alias("o_orderstatus"),
        _money("total", 100_000, 40_000_000, "id").alias("o_totalprice"), F.col("day").alias("o_orderdate"), _one_of("priority", PRIORITIES, "id").alias("o_orderpriority"),
        F.format_string("Clerk#%09d", _draw("clerk", 1000, "id") + 1).alias("o_clerk"), F.lit(0).alias("o_shippriority"), _one_of("said", NAME_WORDS, "id").alias("o_comment"),
    )
    return _typed(orders, "orders"), _typed(lines, "lineitem")


def _price(part: Column) -> Column:
    """A part's retail price by its key, a fixed rule of the schema."""
    return ((F.lit(90000) + F.pmod(F.floor(part / 10), F.lit(20001)) + 100 * F.pmod(part, F.lit(1000))) / 100).cast("decimal(15,2)")


def _supplier(part: Column, i: Column, suppliers: int) -> Column:
    """The part's i-th supplier, 0 to 3, a fixed rule of the schema; so few suppliers that it would repeat one are a quarter apart."""
    shift = F.floor((part - 1) / suppliers) if suppliers >= 80 else F.lit(0)
    return F.pmod(part + i * (F.lit(suppliers // 4) + shift), F.lit(suppliers)) + 1


def _sizes(scale: float) -> dict[str, int]:
    return {name: max(4, round(n * scale)) for name, n in BASE_ROWS.items()}


def generated(spark: SparkSession, scale: float) -> dict[str, DataFrame]:
    """All eight tables by name."""
    rows = _sizes(scale)

    def ids(name: str) -> DataFrame:
        return spark.range(1, rows[name] + 1)

    nation = spark.range(25).select(F.col("id").alias("n_nationkey"), F.format_string("NATION_%d", "id").alias("n_name"), (F.col("id") % 5).alias("n_regionkey"), F.lit("").alias("n_comment"))
    region = spark.range(5).select(F.col("id").alias("r_regionkey"), F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("id") + 1).cast("int")).alias("r_name"), F.lit("").alias("r_comment"))
    phone = F.format_string("%d-%03d-%04d", _draw("nation", 25, "id") + 10, _draw("area", 900, "id") + 100, _draw("line", 9000, "id") + 1000)
    supplier = ids("supplier").select(
        F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.format_string("Road %d", _draw("road", 983, "id")).alias("s_address"), _draw("nation", 25, "id").alias("s_nationkey"),
        phone.alias("s_phone"), _money("balance", -99_999, 999_999, "id").alias("s_acctbal"), F.when(_draw("said", 2000, "id") == 0, "Customer has Complaints").otherwise("").alias("s_comment"),
    )
    customer = ids("customer").select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.format_string("Street %d", _draw("street", 977, "id")).alias("c_address"), _draw("nation", 25, "id").alias("c_nationkey"),
        phone.alias("c_phone"), _money("balance", -99_999, 999_999, "id").alias("c_acctbal"), _one_of("segment", SEGMENTS, "id").alias("c_mktsegment"), F.lit("").alias("c_comment"),
    )
    part = ids("part").select(
        F.col("id").alias("p_partkey"), F.concat_ws(" ", _one_of("one", NAME_WORDS, "id"), _one_of("two", NAME_WORDS, "id")).alias("p_name"), F.format_string("Manufacturer#%d", _draw("maker", 5, "id") + 1).alias("p_mfgr"),
        F.format_string("Brand#%d", _draw("brand", 25, "id") + 1).alias("p_brand"), _one_of("type", TYPES, "id").alias("p_type"), (_draw("size", 50, "id") + 1).alias("p_size"),
        F.concat_ws(" ", _one_of("box", ("SM", "LG", "MED", "JUMBO", "WRAP"), "id"), _one_of("kind", ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM"), "id")).alias("p_container"),
        _price(F.col("id")).alias("p_retailprice"), F.lit("").alias("p_comment"),
    )
    offers = ids("part").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    partsupp = offers.select(
        F.col("id").alias("ps_partkey"), _supplier(F.col("id"), F.col("i"), rows["supplier"]).alias("ps_suppkey"), (_draw("stock", 9999, "id", "i") + 1).alias("ps_availqty"),
        _money("cost", 100, 100_000, "id", "i").alias("ps_supplycost"), F.lit("").alias("ps_comment"),
    )
    orders, lineitem = _orders(ids("orders"), rows)
    made = {"region": region, "nation": nation, "supplier": supplier, "customer": customer, "part": part, "partsupp": partsupp}
    return {name: _typed(df, name) for name, df in made.items()} | {"orders": orders, "lineitem": lineitem}


def refresh_set(spark: SparkSession, scale: float, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refresh set 1, 2, ...: new orders, their lines, and as many old orders' keys to delete."""
    rows = _sizes(scale)
    many = max(1, round(rows["orders"] * REFRESH))
    first = rows["orders"] + (number - 1) * many
    orders, lineitem = _orders(spark.range(first + 1, first + many + 1), rows)
    old = spark.range((number - 1) * many + 1, number * many + 1).select(F.col("id").alias("o_orderkey"))
    return orders, lineitem, old
