"""Tables in the folder that driver and executors share, and ranks without a single partition."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where tables go if the session names no shared folder; sessions on one machine only (tests).
LOCAL_SHARED = "/tmp/helixmill-shared"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; without it, a folder of this machine if the session runs on it alone, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/helixmill/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that stored() and new_folder() made in this application; results that still read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: With it, Spark deletes the shuffle files of a query when the query ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: it cuts the lineage, and a lost executor costs running tasks only.

    Its shuffle files go once it is written, so a chain of stored tables takes the disk of its largest step, not of all.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, to: str, *order: Column) -> DataFrame:
    """df with a column to: the 0-based position of each row in the given order. Ties get different positions.

    Rows are range-partitioned and sorted in their partitions; the driver gets one row count a partition.
    A global window would put all rows into one task instead.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = {r[0]: r[1] for r in table.groupBy(part.alias("p")).count().collect()}
    offsets, total = [0] * (max(counts, default=-1) + 1), 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    if not counts:
        return table.withColumn(to, F.lit(0).cast("long")).drop("__at")
    before = F.get(F.array(*(F.lit(x).cast("long") for x in offsets)), part.cast("int"))
    return table.withColumn(to, before + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


#: Rows of a range, at most, however large a table is.
RANGE_ROWS = 1 << 19


def range_size(n: int) -> int:
    """The size of ranges of n places: small tables are cut into 64, and no range has more than RANGE_ROWS places."""
    return max(1, min(RANGE_ROWS, -(-n // 64)))


def running(df: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """df with to: the sum of value over this row and all rows of smaller by, an integer from 0 without gaps.

    Each range of places is summed up on its own; what comes before it, from one row a range.
    """
    size = range_size(df.count())
    df = df.withColumn("__range", F.floor(F.col(by) / size))
    order = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = df.groupBy("__range").agg(F.sum(value).alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(by))
    return df.join(before, "__range").withColumn(to, F.col("__before") + inside).drop("__range", "__before")


def as_of(points: DataFrame, at: str, starts: DataFrame, start: str, columns: tuple[str, ...], n: int) -> DataFrame:
    """points with the columns of the last row of starts that begins at or before them; places are from 0 to n - 1, starts distinct.

    Both sides are dealt into ranges of places and sorted there; the last start before a range is carried over from one
    row a range. So no comparison is made between rows that are not neighbours, and a range holds at most RANGE_ROWS starts.
    """
    size = range_size(n)
    types = dict(starts.dtypes)
    own = starts.select(F.col(start).cast("long").alias("__place"), F.lit(0).alias("__side"), F.struct(*columns).alias("__found"), *(F.lit(None).cast(t).alias(c) for c, t in points.dtypes))
    kind = ", ".join(f"`{c}`: {types[c]}" for c in columns)
    asked = points.select(F.col(at).cast("long").alias("__place"), F.lit(1).alias("__side"), F.lit(None).cast(f"struct<{kind}>").alias("__found"), *points.columns)
    rows = own.unionByName(asked).withColumn("__range", F.floor(F.col("__place") / size))
    ranges = rows.groupBy("__range").agg(F.max(F.when(F.col("__side") == 0, F.struct("__place", "__found"))).alias("__last"))
    order = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carried = ranges.select("__range", F.last("__last", ignorenulls=True).over(order).alias("__carried"))
    inside = Window.partitionBy("__range").orderBy("__place", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, "__range").withColumn("__found", F.coalesce(F.last("__found", ignorenulls=True).over(inside), F.col("__carried.__found")))
    return rows.where("__side = 1").select(*points.columns, *(F.col("__found")[c].alias(c) for c in columns))


def ranked_within(rows: DataFrame, group: str, to: str, *order: Column) -> DataFrame:
    """rows with to: the 0-based position of each row in its group, whatever the size of a group."""
    rows = ranked(rows, "__rank", F.col(group), *order)
    first = rows.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(to, F.col("__rank") - F.col("__first")).drop("__rank", "__group", "__first")
