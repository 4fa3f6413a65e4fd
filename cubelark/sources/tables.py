"""Reading, loading and changing tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS

#: Partitions of the physical layout rule, and each table's column for it (nation and region live on the last one).
PARTITIONS = 8
LAYOUT = {"customer": "c_custkey", "orders": "o_custkey", "part": "p_partkey", "partsupp": "ps_partkey", "supplier": "s_suppkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A `|`-separated text table whose lines end in `|`; a bad field becomes null."""
    padded = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    return spark.read.schema(padded).option("sep", "|").option("mode", "PERMISSIVE").csv(path).drop("_end")


def write_tbl(df: DataFrame, path: str) -> None:
    """A `|`-separated text table whose lines end in `|`."""
    df.select("*", F.lit(None).cast("string").alias("_end")).write.mode("overwrite").option("sep", "|").option("nullValue", "").option("emptyValue", "").csv(path)


def load_tables(spark: SparkSession, sources: Mapping[str, str], target: str) -> None:
    """Drop and recreate the Parquet tables under `target` from `.tbl` files by table name."""
    for name, path in sources.items():
        read_tbl(spark, path, SCHEMAS[name]).write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def recreate_table(df: DataFrame, name: str) -> None:
    """Replace a catalog table."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.saveAsTable(name)


#: One statement: quoted strings and names, comments, and anything else up to a semicolon.
_STATEMENT = re.compile(r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;'"`])+""", re.S)


def statements(script: str) -> list[str]:
    """The statements of a script separated by `;`, not counting those inside quotes and comments."""
    return [x for x in (m.group().strip() for m in _STATEMENT.finditer(script)) if re.sub(r"--[^\n]*|/\*.*?\*/", "", x, flags=re.S).strip()]


def run_script(spark: SparkSession, script: str) -> int:
    """Run a script's statements, session variables included; returns how many. A failing one stops it."""
    done = statements(script)
    for statement in done:
        spark.sql(statement)
    return len(done)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for intermediate files under the session's warehouse, which all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cubelark-{name}"


def partition_of(name: str, df: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Add `part_no`, the node that the layout rule gives a row; lineitem follows its order's customer."""
    if name in ("nation", "region"):
        return df.withColumn("part_no", F.lit(PARTITIONS - 1))
    if name == "lineitem":
        keys = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.pmod("o_custkey", F.lit(PARTITIONS)).cast("int").alias("part_no"))
        return df.join(keys, "l_orderkey")
    return df.withColumn("part_no", F.pmod(LAYOUT[name], F.lit(PARTITIONS)).cast("int"))


def write_copartitioned(df: DataFrame, name: str, key: str, buckets: int = PARTITIONS) -> None:
    """A bucketed table: joins of two of them on their keys need no shuffle."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def refresh_insert(base: DataFrame, new: DataFrame) -> DataFrame:
    """RF1: new rows join the table."""
    return base.unionByName(new)


def refresh_delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """RF2: the rows of the given keys leave the table."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def jdbc(spark: SparkSession, url: str, relation: str, predicates: list[str], properties: dict[str, str]) -> DataFrame:
    """One relation gathered from a database, a task for each predicate."""
    return spark.read.jdbc(url, relation, predicates=predicates, properties=properties)


def numbers(spark: SparkSession, upto: int = 100_000) -> DataFrame:
    return spark.range(1, upto + 1).withColumnRenamed("id", "number")
