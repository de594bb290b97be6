"""An index that follows a stream of documents, and windows over events (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def postings_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, token, tf, dl) row by row: counts within a document need no state, so any stream will do."""
    t = tokens(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("id"), t.alias("tokens")).withColumn("dl", F.size("tokens"))
    counted = F.transform(F.array_distinct("tokens"), lambda x: F.struct(x.alias("token"), F.size(F.filter("tokens", lambda y: y == x)).cast("long").alias("tf")))
    return rows.select("id", "dl", F.inline(counted))


def follow(docs: DataFrame, id_column: str, text_column: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of new documents to a Parquet folder; ends when what is there has been taken."""
    return (
        postings_of(docs, id_column, text_column)
        .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, kind, n): events by window of time; those later than ``late`` are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))


def once(events: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """Events without repetitions of a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
