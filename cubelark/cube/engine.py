"""Building, storing and querying the cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import volume
from ..sources.tables import table
from .model import BY_NAME, DIMENSIONS, LEVELS, STORED_PREFIX, CubeView, cuboid_name, cuboids, is_stored

SUM = "decimal(38,4)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: all levels and its volume."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", volume().alias("volume"))
    both = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(*[F.expr(x.sql).cast(x.kind).alias(x.name) for x in LEVELS.values()], "volume")


def _measures(df: DataFrame) -> list:
    total = F.sum("volume" if "volume" in df.columns else "sum_volume").cast(SUM).alias("sum_volume")
    count = (F.count("*") if "volume" in df.columns else F.sum("count_volume")).cast("long").alias("count_volume")
    return [total, count]


def aggregate(df: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """One cuboid from facts or from a finer cuboid; without levels the grand total."""
    return df.groupBy(*levels).agg(*_measures(df))


def _held(group: list[tuple[str, ...]]) -> list[str]:
    """The finest levels of a group of cuboids and all coarser ones; those follow from them and make no more rows."""
    used = {x for w in group for x in w}
    return sorted(y.name for d in DIMENSIONS for y in d.levels if any(x in used and d.index(y.name) <= d.index(x) for x in (z.name for z in d.levels)))


def all_cuboids(base: DataFrame, wanted: list[tuple[str, ...]]) -> DataFrame:
    """Several cuboids in one table: `cuboid` names each row's, levels outside it are null.

    Facts are read once. Sums and counts can be summed again, so one aggregation
    first reduces them to the finest wanted levels without product and to those with it;
    then each reduced row goes to its own cuboids, which keeps the expansion small.
    """
    groups = [g for g in ([w for w in wanted if ("product_id" in w) == with_product] for with_product in (False, True)) if g]
    sets = [_held(g) for g in groups]
    every = sorted({x for held in sets for x in held})
    if len(sets) == 1:
        reduced = aggregate(base, tuple(every)).withColumn("_of", F.lit(0))
    else:
        reduced = base.groupingSets([[F.col(x) for x in held] for held in sets], *[F.col(x) for x in every]).agg(*_measures(base), (1 - F.grouping("product_id")).cast("int").alias("_of"))

    def row(w: tuple[str, ...]) -> Column:
        return F.struct(F.lit("__".join(w) or "all").alias("cuboid"), *[(F.col(x) if x in w else F.lit(None).cast(k.kind)).alias(x) for x, k in LEVELS.items()])

    rows = F.when(F.col("_of") == 0, F.array(*map(row, groups[0]))).otherwise(F.array(*map(row, groups[-1])))
    cells = reduced.select(F.inline(rows), "sum_volume", "count_volume")
    return cells.groupBy("cuboid", *LEVELS).agg(*_measures(cells)).select("cuboid", *LEVELS, "sum_volume", "count_volume")


def build(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write all stored cuboids, a folder named by `cuboid_name` for each, in one pass over the facts."""
    stored = [c for c in cuboids() if is_stored(c)]
    rows = all_cuboids(facts(spark, sf_dir), stored)
    named = rows.withColumn("cuboid", F.concat(F.lit(STORED_PREFIX), "cuboid"))
    named.write.mode("overwrite").partitionBy("cuboid").parquet(path)


def stored_cuboid(spark: SparkSession, path: str, levels: tuple[str, ...]) -> DataFrame:
    """One stored cuboid; only its own folder is read."""
    return spark.read.parquet(path).where(F.col("cuboid") == cuboid_name(levels)).select(*levels, "sum_volume", "count_volume")


def storage(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Rows and bytes of files of each stored cuboid, and bytes of the base tables under the name `base`."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    files = listed.load(path).select(F.regexp_extract("path", "cuboid=([^/]*)/", 1).alias("cuboid"), "length")
    sizes = files.groupBy("cuboid").agg(F.sum("length").alias("n_bytes"))
    rows = spark.read.parquet(path).groupBy("cuboid").agg(F.count("*").alias("n_rows"))
    names = ("nation", "customer", "orders", "lineitem")
    base = reduce(DataFrame.union, [table(spark, sf_dir, n).select(F.lit(1).alias("x")) for n in names]).agg(F.lit("base").alias("cuboid"), F.count("*").alias("n_rows"))
    held = reduce(DataFrame.union, [listed.load(f"{sf_dir}/{n}.parquet").select("length") for n in names]).agg(F.sum("length").alias("n_bytes"))
    return rows.join(sizes, "cuboid").select("cuboid", "n_rows", "n_bytes").union(base.crossJoin(held))  # one row each


def merge_delta(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored cuboids with those of new facts added; no old fact is read."""
    levels = list(LEVELS)
    return stored.unionByName(delta).groupBy("cuboid", *levels).agg(F.sum("sum_volume").cast(SUM).alias("sum_volume"), F.sum("count_volume").cast("long").alias("count_volume"))


def statistics(cube: DataFrame) -> DataFrame:
    """Rows of each cuboid, and bytes of its fixed-width values."""
    width = reduce(lambda a, x: a + F.when(F.col(x).isNotNull(), 8).otherwise(0), LEVELS, F.lit(24))
    return cube.groupBy("cuboid").agg(F.count("*").alias("n_rows"), F.sum(width).cast("long").alias("n_bytes"))


def _labels(spark: SparkSession, sf_dir: str, level: str) -> DataFrame | None:
    source = {"c_region_id": ("region", "r_regionkey", "r_name"), "c_nation_id": ("nation", "n_nationkey", "n_name"), "product_id": ("part", "p_partkey", "p_name")}.get(level)
    if not source:
        return None
    name, key, label = source
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias(level), F.col(label).alias(LEVELS[level].label))


def query(spark: SparkSession, sf_dir: str, view: CubeView, path: str | None = None, limit: int = 0) -> DataFrame:
    """A view's rows: its levels, their labels, the measures; ordered by the levels.

    Stored cuboids are read from `path`; others are aggregated from the facts with
    the same result. Selections apply before aggregation, labels after it. A limit
    applies to whole, merged rows; none if it isn't positive.
    """
    levels = view.columns
    if path and is_stored(levels):
        rows = stored_cuboid(spark, path, levels)
    else:
        rows = facts(spark, sf_dir)
    for dim, (lo, hi) in view.ranges.items():
        column = F.col(view.levels[dim])
        rows = rows.where(column == F.lit(lo) if lo == hi else column.between(F.lit(lo), F.lit(hi)))
    if not (path and is_stored(levels)):
        rows = aggregate(rows, levels)
    shown = []
    for level in levels:
        if (labels := _labels(spark, sf_dir, level)) is not None:
            rows = rows.join(labels, level, "left")
            shown.append(LEVELS[level].label)
    out = rows.select(*levels, *shown, "sum_volume", "count_volume")
    out = out.orderBy(*levels) if levels else out
    return out.limit(limit) if limit > 0 else out


def averages(spark: SparkSession, sf_dir: str, wanted: list[tuple[str, ...]]) -> DataFrame:
    """Cuboids with sum and average volume; null stands for all values of a level."""
    rows = all_cuboids(facts(spark, sf_dir), wanted)
    return rows.withColumn("avg_volume", F.col("sum_volume").cast("double") / F.col("count_volume")).drop("count_volume")


__all__ = ["BY_NAME", "aggregate", "all_cuboids", "averages", "build", "cuboid_name", "facts", "merge_delta", "query", "statistics", "storage", "stored_cuboid"]
