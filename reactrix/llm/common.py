"""Helpers that all training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; larger sides are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: A key is hot with more than 1 / HOT_KEYS of a table's rows, and HOT_ROWS at least: there are fewer than HOT_KEYS hot keys.
HOT_KEYS, HOT_ROWS = 100_000, 256
#: Rows of one range, where rows are numbered or added up in a global order.
RANGE_ROWS = 1_000_000

#: Words are runs of anything but these ASCII white-space characters.
SPACE = r"[ \t-\r]+"
#: Every character outside a-z, 0-9 and non-ASCII separates words of the decontamination contract.
NON_TOKEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character, accented capitals included, stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # UTF-8 lower() is table driven and fast; it equals the ASCII rule only where no other capital is present.
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def split_words(text: Column, separator: str = SPACE) -> Column:
    """Words of a text in order; null and blank texts have an empty list.

    Separators at the start leave one empty first piece, at the end one empty last piece, and nowhere else.
    """
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    # bound once, so that the text is not split again for every use
    return let(parts, lambda p: F.slice(
        p,
        F.when(F.element_at(p, 1) == "", 2).otherwise(1),
        F.greatest(F.lit(0), F.size(p)
                   - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
                   - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0))))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are never inlined or recomputed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let2(value1: Column, value2: Column, body) -> Column:
    return let(F.struct(value1.alias("a"), value2.alias("b")), lambda s: body(s["a"], s["b"]))


def text_key(text: Column) -> Column:
    """With doc_id, the identity of a row's text: repeated rows share it and get equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00")))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine (tests) may go without: it gets a local one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.gettempdir()}/reactrix-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Tables written inside the open temporary() scopes, innermost last.
_scopes: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts the lineage.

    The table survives lost executors. It is removed by drop_table(), at the end of the innermost temporary() scope,
    or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reactrix/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Removes a table of materialize() after its last use."""
    files, where = _folder(df.sparkSession, df.table_path)
    files.delete(where, True)


@contextmanager
def temporary(spark: SparkSession):
    """Tables written by materialize() inside are removed at the end; the caller has written what it keeps by then, in the list it is given."""
    _scopes.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        stay = {df.table_path for df in kept}
        for path in _scopes.pop():
            if path not in stay:
                files, where = _folder(spark, path)
                files.delete(where, True)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(big: DataFrame, small: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of big with small, whose keys are unique and whose column ``n`` (dropped) counts the rows that big has of each.

    Keys with more than 1 / HOT_KEYS of big's ``total`` rows are joined by a broadcast, so that their rows stay where they
    are; there are fewer than HOT_KEYS such keys, whatever the size. All others are joined by a shuffle. big is read twice.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    if total <= bar:
        return big.join(small.drop(n), key)
    hot = small.where(F.col(n) > bar).drop(n)
    met = big.join(F.broadcast(hot), key)
    return met.unionByName(big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(n) <= bar).drop(n), key))


def meet(rows: DataFrame, small: DataFrame, same: Column, how: str, n: int, row_key: Column, small_key: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined (left, left_anti or inner) with the ``n`` rows of small, such that rows without a partner aren't shuffled.

    Up to the limit small is broadcast. Beyond it a bitmap of its hashed keys (64-bit row_key and small_key; 16 bits for each key, 128 MB
    at most) is, and only the rows whose bit is set go through a shuffle: all partners, and few others until there
    are some 2 ** 27 keys. Rows whose bit is clear have no partner.
    """
    if n <= limit:
        return rows.join(F.broadcast(small), same, how)
    bits = min(30, max(15, (16 * n - 1).bit_length()))

    def place(key):
        return F.shiftrightunsigned(key, 64 - bits)

    maps = small.select(place(small_key).alias("__p")).groupBy(F.shiftright("__p", 15).alias("__of")).agg(F.bitmap_construct_agg(F.col("__p").bitwiseAND(F.lit(32767))).alias("__map"))
    marked = rows.withColumn("__at", place(row_key)).withColumn("__part", F.shiftright("__at", 15)).join(F.broadcast(maps), F.col("__part") == F.col("__of"), "left")
    low = F.col("__at").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.floor(byte / F.pow(F.lit(2), low.bitwiseAND(F.lit(7)))).cast("int").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = marked.withColumn("__bit", bit).drop("__at", "__part", "__of", "__map")
    met = marked.where("__bit").drop("__bit").join(small, same, how)
    return met if how == "inner" else met.unionByName(marked.where("not __bit").drop("__bit"), allowMissingColumns=True)


def in_ranges(df: DataFrame, order: list[Column], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """A table of df's rows (df is a table itself) with the number of their range in ``order``, ``__part``, about ``rows`` in each."""
    return materialize(df.repartitionByRange(1 + df.count() // rows, *order).withColumn("__part", F.spark_partition_id()), name)


def running(ranges: DataFrame, order: list[Column], **values: str) -> DataFrame:
    """Rows of in_ranges() with the sums of the named columns over all rows before them: in the range by a window, over ranges by their sums."""
    sums = ranges.groupBy(F.col("__part").alias("__of")).agg(*[F.sum(v).alias(f"__{out}") for out, v in values.items()])
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = sums.select("__of", *[F.coalesce(F.sum(f"__{out}").over(earlier), F.lit(0)).alias(f"__{out}") for out in values])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranges.join(F.broadcast(sums), F.col("__part") == F.col("__of"))
    met = met.withColumns({out: F.col(f"__{out}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for out, v in values.items()})
    return met.drop("__of", *[f"__{out}" for out in values])


def running_array(values: Column, start, step, width: int = 256) -> Column:
    """For each element, step applied from the first element up to it (an associative step with the neutral ``start``).

    Arrays are built in pieces of ``width``, as each longer array is a copy: the cost grows with n * width + (n / width) ** 2.
    """
    def grown(part):
        first = F.struct(start.alias("now"), F.array(start).alias("all"))
        return F.aggregate(part, first, lambda a, x: let(step(a["now"], x), lambda y: F.struct(y.alias("now"), F.concat(a["all"], F.array(y)).alias("all"))), lambda a: F.slice(a["all"], F.lit(2), F.size(part)))

    def pieces(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: let(F.slice(v, k * width + 1, F.lit(width)), grown))

    def joined(parts):
        ends = F.transform(parts, lambda p: F.element_at(p, -1))
        first = F.struct(start.alias("now"), F.array(start).alias("all"))
        befores = F.aggregate(ends, first, lambda a, x: let(step(a["now"], x), lambda y: F.struct(y.alias("now"), F.concat(a["all"], F.array(y)).alias("all"))), lambda a: a["all"])
        return F.flatten(F.zip_with(parts, F.slice(befores, F.lit(1), F.size(parts)), lambda p, before: F.transform(p, lambda x: step(before, x))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.slice(F.array(start), 1, 0)).otherwise(let(pieces(v), joined)))


def clean_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra input columns never clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def packed(df: DataFrame) -> Column:
    """All columns of df in the struct ``row``, out of the way of the names that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
