"""The eight tables of the sales schema, their types and keys."""

from __future__ import annotations

from pyspark.sql import types as T

WHOLE, TEXT, MONEY, DAY = T.LongType(), T.StringType(), T.DecimalType(15, 2), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: The tables' columns and types.
SCHEMAS = {
    "region": _schema(r_regionkey=WHOLE, r_name=TEXT, r_comment=TEXT),
    "nation": _schema(n_nationkey=WHOLE, n_name=TEXT, n_regionkey=WHOLE, n_comment=TEXT),
    "supplier": _schema(s_suppkey=WHOLE, s_name=TEXT, s_address=TEXT, s_nationkey=WHOLE, s_phone=TEXT, s_acctbal=MONEY, s_comment=TEXT),
    "customer": _schema(c_custkey=WHOLE, c_name=TEXT, c_address=TEXT, c_nationkey=WHOLE, c_phone=TEXT, c_acctbal=MONEY, c_mktsegment=TEXT, c_comment=TEXT),
    "part": _schema(p_partkey=WHOLE, p_name=TEXT, p_mfgr=TEXT, p_brand=TEXT, p_type=TEXT, p_size=WHOLE, p_container=TEXT, p_retailprice=MONEY, p_comment=TEXT),
    "partsupp": _schema(ps_partkey=WHOLE, ps_suppkey=WHOLE, ps_availqty=WHOLE, ps_supplycost=MONEY, ps_comment=TEXT),
    "orders": _schema(o_orderkey=WHOLE, o_custkey=WHOLE, o_orderstatus=TEXT, o_totalprice=MONEY, o_orderdate=DAY, o_orderpriority=TEXT, o_clerk=TEXT, o_shippriority=WHOLE, o_comment=TEXT),
    "lineitem": _schema(
        l_orderkey=WHOLE, l_partkey=WHOLE, l_suppkey=WHOLE, l_linenumber=WHOLE, l_quantity=MONEY, l_extendedprice=MONEY, l_discount=MONEY, l_tax=MONEY,
        l_returnflag=TEXT, l_linestatus=TEXT, l_shipdate=DAY, l_commitdate=DAY, l_receiptdate=DAY, l_shipinstruct=TEXT, l_shipmode=TEXT, l_comment=TEXT,
    ),
}
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
    "partsupp": ["ps_partkey", "ps_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
}
#: (table, columns) -> (table, columns). Informational: Spark does not enforce keys.
FOREIGN_KEYS = {
    ("nation", ("n_regionkey",)): ("region", ("r_regionkey",)),
    ("supplier", ("s_nationkey",)): ("nation", ("n_nationkey",)),
    ("customer", ("c_nationkey",)): ("nation", ("n_nationkey",)),
    ("orders", ("o_custkey",)): ("customer", ("c_custkey",)),
    ("lineitem", ("l_orderkey",)): ("orders", ("o_orderkey",)),
    ("lineitem", ("l_partkey", "l_suppkey")): ("partsupp", ("ps_partkey", "ps_suppkey")),
    ("partsupp", ("ps_partkey",)): ("part", ("p_partkey",)),
    ("partsupp", ("ps_suppkey",)): ("supplier", ("s_suppkey",)),
}
