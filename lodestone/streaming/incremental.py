"""Keeping a stored index up to date from a stream of rows; an extension beside the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import tokens
from ..plans.index import postings_of


def index_stream(rows: DataFrame, pk: str, fields: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of each micro-batch under path, marked with its number, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        each = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f"`{f}`")).alias("tokens")) for f in fields))
        parts = batch.select(F.col(pk).alias("pk"), F.explode(each).alias("x")).select("pk", "x.field", "x.tokens", F.size("x.tokens").alias("dl"))
        postings_of(parts).withColumn("pk_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_postings(postings: DataFrame) -> DataFrame:
    """Of each document the postings of its last batch."""
    last = postings.groupBy("pk", "field").agg(F.max("pk_batch").alias("pk_batch"))
    return postings.join(last, ["pk", "field", "pk_batch"], "left_semi")


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of a stream by tumbling windows, with rows later than the watermark left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("doc_count"))
