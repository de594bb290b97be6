"""Running values and totals of groups of any size.

A window over one group runs in one task. Here groups are cut into blocks of their
order: rows meet only those of their own block, and blocks meet as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive numbers of an order that make one block.
BLOCK = 4096
_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _blocked(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.coalesce(F.col(order).cast("long"), F.lit(-1)) / BLOCK))


def _same(keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in [*keys, "_block"]:
        condition = condition & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return condition


def with_running(rows: DataFrame, keys: list[str], order: list[str], fold: str, value: Column, name: str) -> DataFrame:
    """Adds to each row the fold (sum or max) of ``value`` over the rows of its keys up to itself; null if none has one.

    The first column of ``order`` is a whole number, dense enough for blocks; rows that are equal in the
    order are taken one after another. Null keys are one group.
    """
    f = _FOLDS[fold]
    rows = _blocked(rows.withColumn("_value", value), order[0])
    inside = f("_value").over(W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before = rows.groupBy(*keys, "_block").agg(f("_value").alias("_all"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = before.select(*keys, "_block", f("_all").over(earlier).alias("_before"))
    rows = rows.withColumn("_inside", inside).alias("a").join(before.alias("b"), _same(keys)).select("a.*", "b._before")
    both = F.coalesce(F.col("_inside") + F.col("_before"), "_inside", "_before") if fold == "sum" else F.greatest("_inside", "_before")
    return rows.withColumn(name, both).drop("_value", "_block", "_inside", "_before")


def with_totals(rows: DataFrame, keys: list[str], order: str, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds to each row folds over all rows of its keys: name -> (sum, max, min or count, value)."""
    rows = _blocked(rows, order)
    partly = rows.groupBy(*keys, "_block").agg(*[_FOLDS[f](v).alias(name) for name, (f, v) in totals.items()])
    again = {"count": "sum"}
    whole = W.partitionBy(*keys)
    partly = partly.select(*keys, "_block", *[_FOLDS[again.get(f, f)](name).over(whole).alias(name) for name, (f, _) in totals.items()])
    return rows.alias("a").join(partly.alias("b"), _same(keys)).select("a.*", *[F.col(f"b.`{n}`") for n in totals]).drop("_block")
