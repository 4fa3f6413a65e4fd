"""Result files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.derived import with_views
from ..schemas import SCHEMAS
from .tables import table


def write_result(df: DataFrame, path: str) -> None:
    """One `|`-separated text file; for final results, which are small."""
    df.coalesce(1).write.mode("overwrite").option("sep", "|").csv(path)


def formatted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows as text: the keys joined by `|`, a tab, the value."""
    return df.select(F.concat(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.lit("\t"), F.col(value).cast("string")).alias("line"))


def dump_csv(df: DataFrame, path: str) -> None:
    """Every field in double quotes; decimals as doubles."""
    cols = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("quoteAll", True).csv(path)


def dump_all(spark: SparkSession, sf_dir: str, target: str) -> dict[str, DataFrame]:
    """Quoted dumps of all eight tables, a folder for each; returns what was dumped, by name."""
    tables = {name: table(spark, sf_dir, name) for name in SCHEMAS if name != "partsupp"}
    for name in ("part", "supplier"):
        tables[name].createOrReplaceTempView(name)
    tables["partsupp"] = spark.sql(with_views("select * from ps"))
    for name, df in tables.items():
        dump_csv(df, f"{target}/{name}")
    return tables


#: Rows that a report shows at most; what is more goes to a file.
MOST_SHOWN = 100_000


def report(df: DataFrame, limit: int = 1000) -> str:
    """A header and at most `limit` rows as text; without a positive limit up to MOST_SHOWN, and a note if there are more."""
    most = limit if limit > 0 else MOST_SHOWN
    rows = df.limit(most + (limit <= 0)).toLocalIterator()
    lines = ["|".join("" if v is None else str(v) for v in r) for r in rows]
    if len(lines) > most:
        lines[most:] = [f"... more than {most} rows"]
    return "\n".join(["|".join(df.columns), *lines])
