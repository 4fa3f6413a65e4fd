"""Durable intermediate results and bounded helpers for the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``, or the folder set by
    ``setCheckpointDir``. Where a session has neither, a temporary folder serves a
    local master, whose tasks share the machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get(CHECKPOINT, None) or context.getCheckpointDir()
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder; smaller than a checkpoint, and lineage ends there too."""
    path = fresh_path(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files behind results that are durable by now.

    Spark removes them when its driver collects garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Paths given out, by application.
_GIVEN: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables and checkpoints of this application; returns how many folders.

    Results are read from them, and tasks that are run again read them too. So this is for the
    end, when all results have been written elsewhere.
    """
    context = spark.sparkContext
    paths = _GIVEN.pop(context.applicationId, []) + ([context.getCheckpointDir()] if context.getCheckpointDir() else [])
    gone = 0
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True))
    if context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))  # a new folder for what follows
    return gone


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have, whatever its case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


#: A key is hot from one of so many parts of a join's rows on (so there are at most that many such keys), but not below so many rows.
HOT_PARTS, HOT_ROWS = 1000, 1000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `by_key`, which has one row a key and in `weight` about how many of the rows bear it.

    One task of a plain join would take all rows of a hot key. Hot keys are at most
    HOT_PARTS rows, so they are broadcast and their rows stay where they are; the
    others are joined as usual. Both tables are read twice: give durable ones. `how` is inner or left.
    """
    total, most = by_key.agg(F.sum(weight), F.max(weight)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_PARTS)
    if (most or 0) < least:
        return rows.join(by_key.drop(weight), key, how)
    hot = F.broadcast(by_key.where(F.col(weight) >= least).drop(weight))
    rest = rows.join(hot.select(key), key, "left_anti").join(by_key.where(F.col(weight) < least).drop(weight), key, how)
    return rows.join(hot, key).unionByName(rest)


def numbered(df: DataFrame, keys: list[str], number: str = "slot") -> DataFrame:
    """Add each row's place from 0 in the order of `keys` among the rows with the same first key.

    No task sees all rows, not even those of one first key: rows are
    range-partitioned on the keys, made durable and numbered inside each partition.
    Only the first value of a partition can go on from earlier ones, so one small row a
    partition tells where its numbers begin. Ties keep the order of the durable
    copy. Nulls come first.
    """
    spark, within = df.sparkSession, keys[0]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)).withColumn("_part", F.spark_partition_id())
    sizes = placed.groupBy("_part", within).agg(F.count("*").alias("n")).withColumn("x", F.struct(within, "n"))
    ends = sizes.groupBy("_part").agg(F.min("x").alias("first"), F.max("x").alias("last")).orderBy("_part").collect()  # one row a partition
    begins, run, value = [], 0, None
    for i, (part, first, last) in enumerate(ends):
        at = run if i and first[0] == value else 0
        begins.append((part, first[0], at))
        run, value = (at + first[1] if first[0] == last[0] else last[1]), last[0]
    kind = placed.schema[within].dataType.simpleString()
    begins = spark.createDataFrame(begins, f"_part int, _value {kind}, _first long")
    inside = F.expr(f"row_number() over (partition by _part, {within} order by {', '.join(keys)})") - 1
    first = F.when(F.col(within).eqNullSafe(F.col("_value")), F.col("_first")).otherwise(0)
    return placed.join(F.broadcast(begins), "_part").withColumn(number, (inside + first).cast("long")).drop("_part", "_value", "_first")
