"""Vectors as arrays; bulk products are in operators.dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_tokens

ASCII_HASH_SLOTS = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its length; the zero vector stays as it is."""
    n = length(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def hash_slots(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The sparse ASCII-hash embedding: (id, slot, weight), weights of unit length.

    A token's slot is its MD5 modulo 128, which the last two hex digits decide.
    """
    token = docs.select(id_column, F.explode(ascii_tokens(F.col(text_column))).alias("token"))
    slot = F.conv(F.right(F.md5("token"), F.lit(2)), 16, 10).cast("int") % ASCII_HASH_SLOTS
    counts = token.groupBy(id_column, slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    norms = counts.groupBy(id_column).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, id_column).select(id_column, "slot", (F.col("n") / F.col("norm")).alias("weight"))
