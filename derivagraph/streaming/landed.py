"""Pages that land as files, one crawl round a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crawl import crawl_round
from ..operators.curate import keep_last
from ..operators.derive import Lexicon


def page_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """word, page, fetched_at of Parquet files as they land."""
    return spark.readStream.schema("word string, page string, fetched_at timestamp").option("maxFilesPerTrigger", per_trigger).parquet(path)


def derive_stream(pages: DataFrame, lexicon: DataFrame, out: str, checkpoint: str):
    """Starts the stream: of each micro-batch the last page per word gives edges, appended to ``out`` under the batch's number.

    A batch that is repeated after a failure overwrites its own folder, so every page counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        last = keep_last(batch, ["word"], ["fetched_at", "page"]).select("word", "page")
        edges, _ = crawl_round(last.select("word"), last, Lexicon(lexicon))
        edges.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(pages: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Pages per window of arrival; rows later than ``late`` are left out."""
    return pages.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window)).agg(F.count(F.lit(1)).alias("n_pages")).select(F.col("window.start").alias("start"), "n_pages")
