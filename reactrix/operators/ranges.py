"""Global orders without a global task: rows are dealt by range, and what lies before a range is added from the sums of ranges."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one range.
RANGE_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared space, removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster, whose executors are processes of their own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/reactrix-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: A Parquet row group's usual size: a smaller table may be one task's whole work.
ONE_TASK_BYTES = 128 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt over the cluster's cores if its files are so small that one task may read them all. Larger tables stay as they are."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < ONE_TASK_BYTES else df


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """df as a table, with the number of each row's range of the order in ``__range_no``."""
    df = stored(df, "rows")
    return stored(df.repartitionByRange(1 + df.count() // rows, *order).withColumn("__range_no", F.spark_partition_id()), "ranges")


def running(ranges: DataFrame, order: list[Column], value: str, out: str, groups: list[str] = ()) -> DataFrame:
    """Rows of in_ranges() with the sum of value over the rows before them, in their group. The order begins with the groups."""
    sums = ranges.groupBy(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__range_no").alias("__of")).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*[f"__{g}" for g in groups]).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__range_no", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__range_no") == F.col("__of")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    met = ranges.join(sums, same).withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return met.drop("__of", "__before", *[f"__{g}" for g in groups])


def row_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with each row's place in the whole order, from 1."""
    return running(in_ranges(df.withColumn("__one", F.lit(1)), *order), order, "__one", out).withColumn(out, (F.col(out) + 1).cast("int")).drop("__one", "__range_no")


def quantiles(df: DataFrame, groups: list[str], value: str, times: str | None = None, **at: float) -> DataFrame:
    """groups and one column for each share: the exact quantile, interpolated between neighbours. Nulls don't count.

    Rows are first reduced to (group, value, count); no task holds a group's values. times: the column of such counts, if df has them already.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg((F.count("*") if times is None else F.sum(times)).alias("__n"))
    order = [*[F.col(g) for g in groups], F.col("__v")]
    placed = running(in_ranges(counts, *order), order, "__n", "__at", groups)
    totals = placed.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.sum("__n").alias("__total"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    rows = placed.join(F.broadcast(totals) if not groups else totals, same)
    out = []
    for name, share in at.items():
        spot = F.lit(float(share)) * (F.col("__total") - 1)
        holds = lambda k: (F.col("__at") <= k) & (k < F.col("__at") + F.col("__n"))
        low, high = F.max(F.when(holds(F.floor(spot)), F.col("__v").cast("double"))), F.max(F.when(holds(F.ceil(spot)), F.col("__v").cast("double")))
        out.append((low + (high - low) * F.max(spot - F.floor(spot))).alias(name))
    return rows.groupBy(*groups).agg(*out)
