"""Which rows a question may find: its time scope, a metadata filter, and the layers of an index.

One condition serves every retriever. What holds for all questions is applied to rows
before they are scored; what differs by question to scored pairs before they are ranked. The
statistics of an index stay those of all its rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import time_scope
from . import filters

#: Days of a bucket in which spans are brought together.
BUCKET_DAYS = 32


def _number(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def day_of(number: Column) -> Column:
    """The date of a whole number yyyymmdd; null for 0 and for what is no date."""
    return F.try_to_date(F.when(number > 0, F.lpad(number.cast("string"), 8, "0")), "yyyyMMdd")


def question_scopes(questions: DataFrame, anchor: dt.date | None = None) -> DataFrame:
    """(qid, span_from int, span_to int, kind) of the questions that speak of a time, as yyyymmdd.

    questions: qid, question and, unless ``anchor`` is given for all, asked_at (date). A question without
    a date has no scope.
    """
    asked = F.lit(anchor) if anchor is not None else F.col("asked_at").cast("date")
    rows = questions.select("qid", "question", asked.alias("asked_at")).where("question is not null and asked_at is not null")

    def run(batches):
        for batch in batches:
            told = [time_scope(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("asked_at").to_pylist(), strict=True)]
            at = [i for i, s in enumerate(told) if s is not None]
            found = [told[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid").take(pa.array(at, pa.int64())), pa.array([_number(s.start) for s in found], pa.int32()), pa.array([_number(s.end) for s in found], pa.int32()), pa.array([s.kind for s in found], pa.string())],
                ["qid", "span_from", "span_to", "kind"],
            )

    return rows.mapInArrow(run, f"qid {dict(rows.dtypes)['qid']}, span_from int, span_to int, kind string")


def overlapping(left: DataFrame, right: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """(left_id, right_id) of all pairs whose spans share a day.

    left: left_id, span_from, span_to; right: right_id, span_from, span_to; as yyyymmdd. Rows
    without a date (0 or null), or that end before they begin, meet none. Spans are dealt into
    buckets of ``days`` days and joined there; a pair is found in the first bucket that both have,
    and so once.
    """

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        begin, end = F.unix_date(day_of(F.col("span_from"))), F.unix_date(day_of(F.col("span_to")))
        rows = rows.select(F.col(f"{name}_id"), begin.alias(f"{name}_from"), end.alias(f"{name}_to")).where(F.col(f"{name}_from") <= F.col(f"{name}_to"))
        bucket = lambda c: F.floor(F.col(f"{name}_{c}") / days).cast("int")
        return rows.withColumn(f"{name}_first", bucket("from")).withColumn("bucket", F.explode(F.sequence(bucket("from"), bucket("to"))))

    both = dealt(left, "left").join(dealt(right, "right"), "bucket")
    once = F.col("bucket") == F.greatest("left_first", "right_first")
    return both.where(once & (F.col("left_from") <= F.col("right_to")) & (F.col("right_from") <= F.col("left_to"))).select("left_id", "right_id")


@dataclass
class Within:
    """What questions may find.

    facts: id and, as far as they are asked for, span_from, span_to (yyyymmdd, 0 without a date), layer, level and the
    columns that ``where`` names. scopes: (qid, span_from, span_to); a question without one finds rows of any time.
    where: a metadata filter. scope, levels: see filters.layer_scope.
    """

    facts: DataFrame
    scopes: DataFrame | None = None
    where: dict | None = None
    scope: str = "mixed"
    levels: tuple[int, ...] = field(default=())

    def rows(self, table: DataFrame) -> DataFrame:
        """The rows of a table (id, ...) that any question may find; for those without facts only if nothing is asked of them."""
        asked = []
        if self.where:
            asked.append(filters.compile_filter(self.where, F.col))
        if self.scope != "mixed" or self.levels:
            asked.append(filters.layer_scope(F.coalesce("layer", F.lit("")), F.coalesce("level", F.lit(0)), self.scope, self.levels))
        if not asked:
            return table
        kept = self.facts
        for c in asked:
            kept = kept.where(c)
        return table.join(kept.select("id"), "id", "left_semi")

    def pairs(self, scored: DataFrame) -> DataFrame:
        """Scored pairs (qid, id, ...) that the questions' time scopes let through."""
        if self.scopes is None:
            return scored
        spans = self.facts.select("id", F.col("span_from").alias("_from"), F.col("span_to").alias("_to"))
        asked = self.scopes.select("qid", F.col("span_from").alias("_start"), F.col("span_to").alias("_end"))
        both = scored.join(asked, "qid", "left").join(spans, "id", "left")
        inside = (F.col("_from") > 0) & (F.col("_from") <= F.col("_end")) & (F.col("_to") >= F.col("_start"))
        return both.where(F.col("_start").isNull() | F.coalesce(inside, F.lit(False))).drop("_from", "_to", "_start", "_end")
