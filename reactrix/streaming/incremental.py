"""Ingestion of crawled posts with Structured Streaming. What was seen is keyed state, so a batch never reads what earlier ones have written.

State lives in RocksDB beside the checkpoint: a query that is started again goes on where it ended, and its cost is that of the new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.readers import CRAWLED

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def post_key(url: str = "post_url", text: str = "post_content"):
    """The address, or a hash of the first 50 characters where there is none; the empty key, which is one like others, without both."""
    return F.coalesce(F.nullif(F.col(url), F.lit("")), F.sha2(F.substring(text, 1, 50), 256), F.lit(""))


class First(StatefulProcessor):
    """The first row of a key, by the given columns (nulls last), once for ever. A key's rows pass one by one."""

    def __init__(self, *order: str):
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        best = None
        place = lambda r: [(r[c] is None, r[c]) for c in self.order]
        for r in rows:
            if best is None or _before(place(r), place(best)):
                best = r
        if not self.seen.exists():
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def _before(a: list, b: list) -> bool:
    for (a_null, x), (b_null, y) in zip(a, b, strict=True):
        if a_null != b_null:
            return b_null
        if not a_null and x != y:
            return x < y
    return False


class Pages(StatefulProcessor):
    """Goes over each page's rows in order and gives those to keep, until ``most`` old ones came in a row; the page is over then, for later batches too.

    The rows of a page in one batch are sorted in memory: bound batches by maxFilesPerTrigger.
    """

    def __init__(self, order: list[str], old: str, keep: str, most: int):
        self.order, self.old, self.keep, self.most = order, old, keep, most

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "old int")

    def handleInputRows(self, key, rows, timerValues):
        run = self.run.get()[0] if self.run.exists() else 0
        for r in sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in self.order]) if run < self.most else rows:
            if run >= self.most:
                continue
            run = run + 1 if r[self.old] else 0
            if not r[self.old] and r[self.keep]:
                yield r
        self.run.update((run,))

    def close(self) -> None:
        pass


def new_posts(stream: DataFrame) -> DataFrame:
    """Posts of a stream whose key never came before, with post_key; of a batch's equal posts the first by creation time and id."""
    rows = stream.withColumn("post_key", post_key())
    return rows.groupBy("post_key").transformWithState(First("creation_time", "post_id"), rows.schema, "Append", "None")


def follow_pages(stream: DataFrame, page: str, order: list[str], old: Column, keep: Column, most: int = 3) -> DataFrame:
    """Rows of a stream that a crawler of each page keeps: those that aren't old, up to the end of the first run of ``most`` old ones."""
    rows = stream.withColumns({"__old": F.coalesce(old, F.lit(False)), "__keep": F.coalesce(keep, F.lit(False))})
    return rows.groupBy(page).transformWithState(Pages(order, "__old", "__keep", most), rows.schema, "Append", "None").drop("__old", "__keep")


def append(stream: DataFrame, target: str, checkpoint: str):
    """Starts to append what the stream has and hasn't been taken yet to a Parquet folder; returns the running query."""
    stream.sparkSession.conf.set(*STORE)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Starts the ingestion of new posts of a folder."""
    return append(new_posts(spark.readStream.schema(CRAWLED).json(folder)), target, checkpoint)


def daily_controversy(posts: DataFrame, late: str = "2 days") -> DataFrame:
    """Extension: mean controversy of each topic by day over a stream of enriched posts with a ``ts``, late posts included."""
    return posts.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "topic_label_final").agg(F.avg("controversy").alias("controversy"), F.count("*").alias("n"))
