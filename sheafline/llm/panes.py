"""Hourly panes of events that arrive late, with emissions and revisions.

Method: a stateful streaming query in update mode keeps every pane's count and sum, and
drops the state of a pane once it is closed. foreachBatch joins the panes that a batch
has changed to the table of panes of the batch before, which says what has been emitted;
the join gives the panes that are due, and a retraction and a replacement for each one that was
emitted and has changed. Rows of closed panes don't reach the aggregation.

The table of panes is written anew by each batch, from the one before, under the batch's number; so are
its records. A batch that is run again after a failure finds the same table and writes the same.
Everything lies under ``spark.checkpoint.dir``. Only the highest event time goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import Scratch

HOUR = 3_600_000_000
#: A day of 24 hours in microseconds, as all times are here.
DAY = 24 * HOUR
#: Hours and days behind a pane's end at which it is due and closed.
DUE_HOURS, CLOSED_DAYS = 6, 4
#: Spark's watermark starts at 1970. Times are moved by so many days for it, more than there are before any timestamp.
MOVED_DAYS = 4_000_000
EVENT = "click_id long, kind string, event long, cents long"
RECORD = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
PANE = "kind string, hour long, old_rows long, old_cents long, emitted boolean, changed boolean, n_rows long, cents long, due boolean, closed boolean"
_MICROBATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@dataclass(frozen=True)
class Limits:
    """When a pane is due and closed, in microseconds of event time behind its end."""

    due: int = DUE_HOURS * HOUR
    closed: int = CLOSED_DAYS * DAY


def microseconds(ts: Column) -> Column:
    """Microseconds from 1970 to a timestamp, by its own fields, whatever zone the session has."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def deal(clicks: DataFrame, batches: int = 8) -> DataFrame:
    """(batch int, click_id, kind, event, cents): each click once, in its batch; see EVENT.

    Rows without ts, click_id or arrived_at are left out. Of several rows of a click that with the
    earliest arrival counts, of equals the first by ts, kind and value (null first). D being
    the day of arrival since 1970 and q = D mod batches, a click belongs to batch q or, by the CRC of its
    id, to one of up to six behind, and to the last at most; its event time is ts moved by q - D days. kind
    null is ``none``; a value that is null or no finite number has 0 cents.
    """
    row = F.struct("arrived_at", "ts", "kind", "value")
    once = clicks.where("ts is not null and click_id is not null and arrived_at is not null")
    once = once.select(F.col("click_id").cast("long").alias("click_id"), row.alias("r")).groupBy("click_id").agg(F.min("r").alias("r"))
    day = F.unix_date(F.to_date("r.arrived_at")).cast("long")
    q = F.pmod(day, F.lit(batches))
    behind = F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23)
    value = F.col("r.value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return once.select(
        F.least(F.lit(batches - 1), q + behind).cast("int").alias("batch"),
        "click_id",
        F.coalesce("r.kind", F.lit("none")).alias("kind"),
        (microseconds(F.col("r.ts")) - (day - q) * DAY).alias("event"),
        F.when(finite, F.floor(100 * value + 0.5)).otherwise(0).cast("long").alias("cents"),
    )


def hour_of(event: Column) -> Column:
    return F.floor((event - F.pmod(event, F.lit(HOUR))) / HOUR).cast("long")


def _passed(hour: Column, behind: int, highest: int | None) -> Column:
    """Whether the highest event time has reached ``behind`` microseconds from the end of the hour on."""
    return F.lit(False) if highest is None else (hour + 1) * HOUR + behind <= F.lit(highest)


def run(spark: SparkSession, batches: list[DataFrame], scratch: Scratch, limits: Limits = Limits()) -> DataFrame:
    """The records (see RECORD) that the batches, rows of EVENT, give one after another.

    Each batch is written to a folder and read by a stream that is started for it on the one
    checkpoint, and stopped when it has read it; an empty batch is run as well. W is the
    highest event time of the batches before. Rows of panes that are closed at W come out as ``late``. Panes that are due
    at W and not yet emitted come out as ``emit``, those emitted before that have new rows as ``retract`` with
    their old totals and ``replace`` with the new; the last batch emits the others as ``final``.

    Rows without an event time are not allowed. Repeated rows count each. Without batches there are no records.
    """
    root = scratch.path()
    before = spark.conf.get(_MICROBATCHES)
    spark.conf.set(_MICROBATCHES, "false")  # one start, one batch: nothing runs for the watermark's sake alone
    try:
        highest = None
        for number, rows in enumerate(batches):
            rows.select("click_id", "kind", "event", "cents").write.mode("overwrite").parquet(f"{root}/in/{number}")
            _feed(spark, root, number, number == len(batches) - 1, highest, limits)
            told = spark.read.schema(EVENT).parquet(f"{root}/in/{number}").agg(F.max("event").alias("w")).first().w
            highest = max((x for x in (highest, told) if x is not None), default=None)
    finally:
        spark.conf.set(_MICROBATCHES, before)
    if not batches:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(*[f"{root}/records/{k}" for k in range(len(batches))])


def _feed(spark: SparkSession, root: str, number: int, last: bool, highest: int | None, limits: Limits) -> None:
    rows = spark.readStream.schema(EVENT).parquet(f"{root}/in/*")
    moved = F.timestamp_micros(F.col("event") + MOVED_DAYS * DAY)
    panes = (
        rows.where(~_passed(hour_of(F.col("event")), limits.closed, highest))
        .withColumn("time", moved)
        .withWatermark("time", f"{limits.closed // 1000} milliseconds")
        .groupBy("kind", F.window("time", "1 hour").alias("w"))
        .agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"))
        .select("kind", (F.floor(F.unix_micros("w.start") / HOUR) - MOVED_DAYS * 24).cast("long").alias("hour"), "n_rows", "cents")
    )

    def publish(changes: DataFrame, _: int) -> None:
        # the state is read and kept once, by this write
        changes.write.mode("overwrite").parquet(f"{root}/changes/{number}")
        _publish(spark, root, number, last, highest, limits)

    stream = panes.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()


def _publish(spark: SparkSession, root: str, number: int, last: bool, highest: int | None, limits: Limits) -> None:
    """The table of panes of this batch, from the one before and the panes that have changed; then the batch's records."""
    changes = spark.read.schema("kind string, hour long, n_rows long, cents long").parquet(f"{root}/changes/{number}")
    if number:
        held = spark.read.schema(PANE).parquet(f"{root}/panes/{number - 1}").where("not closed")
        held = held.select("kind", "hour", F.col("n_rows").alias("old_rows"), F.col("cents").alias("old_cents"), (F.col("emitted") | F.col("due")).alias("emitted"))
    else:
        held = spark.createDataFrame([], "kind string, hour long, old_rows long, old_cents long, emitted boolean")
    joined = held.join(changes, ["kind", "hour"], "full_outer")
    table = joined.select(
        "kind",
        "hour",
        "old_rows",
        "old_cents",
        F.coalesce("emitted", F.lit(False)).alias("emitted"),
        F.col("n_rows").isNotNull().alias("changed"),
        F.coalesce("n_rows", "old_rows").alias("n_rows"),
        F.coalesce("cents", "old_cents").alias("cents"),
        _passed(F.col("hour"), limits.due, highest).alias("due"),
        _passed(F.col("hour"), limits.closed, highest).alias("closed"),
    )
    table.write.mode("overwrite").parquet(f"{root}/panes/{number}")
    table = spark.read.schema(PANE).parquet(f"{root}/panes/{number}")
    old = lambda record: F.struct(F.lit(record).alias("record"), F.col("old_rows").alias("n_rows"), F.col("old_cents").alias("cents"))
    new = lambda record: F.struct(F.lit(record).alias("record"), F.col("n_rows"), F.col("cents"))
    told = F.when(F.col("emitted") & F.col("changed"), F.array(old("retract"), new("replace"))).when(~F.col("emitted") & F.col("due"), F.array(new("emit")))
    if last:
        told = told.when(~F.col("emitted"), F.array(new("final")))
    records = table.select("kind", "hour", F.explode(told).alias("r")).select("kind", "hour", F.lit(-1).cast("long").alias("click_id"), "r.n_rows", "r.cents", "r.record")
    rows = spark.read.schema(EVENT).parquet(f"{root}/in/{number}").withColumn("hour", hour_of(F.col("event"))).where(_passed(F.col("hour"), limits.closed, highest))
    late = rows.select("kind", "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"))
    told = records.unionByName(late).select(F.lit(number).cast("long").alias("batch"), "hour", "click_id", "n_rows", "cents", "record", "kind")
    told.write.mode("overwrite").parquet(f"{root}/records/{number}")


def click_panes(clicks: DataFrame, batches: int = 8) -> DataFrame:
    """The records of clicks (click_id, ts, arrived_at, kind, value), dealt into batches by deal()."""
    spark = clicks.sparkSession
    scratch = Scratch(spark, "panes")
    dealt = scratch.save(deal(clicks, batches))
    return run(spark, [dealt.where(F.col("batch") == k) for k in range(batches)], scratch)
