"""How well an embedding brings the two languages of sentence pairs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from . import dense
from .saved import saved

#: The least distance of the means of pairs and mismatches that counts as aligned.
SEPARATION = 0.3


def bilingual(pairs: DataFrame) -> DataFrame:
    """One row about pairs (pair_id long from 0, a, b: vectors of the two languages).

    pair_mean, pair_min: cosines of pairs; other_mean, other_max: of all mismatches between the languages; a_wins,
    b_wins: how often a sentence's nearest in the pool of both languages, but for itself, is its own translation
    (ties to the first language, then to the smaller id); n; verdict: ``aligned`` if all win and the means lie SEPARATION apart.

    The mean of mismatches comes from the sums of both sides, so only nearest neighbours need products of all.
    """
    rows = saved(pairs.select(F.col("pair_id").cast("long").alias("i"), unit(F.col("a")).alias("a"), unit(F.col("b")).alias("b")), "pairs")
    step = (rows.agg(F.max("i").alias("m")).first().m or 0) + 1
    sides = {c: rows.select((F.col("i") + (step if c == "b" else 0)).alias("id"), F.col(c).alias("vec")) for c in "ab"}
    pool = sides["a"].unionByName(sides["b"])
    nearest = dense.cosine_top_k(pool, pool, 1, "id", "vec", decimals=9)
    wins = nearest.select((F.col("qid") < step).alias("first"), (F.abs(F.col("qid") - F.col("id")) == step).alias("own"))
    wins = wins.agg(F.count_if(F.expr("first and own")).alias("a_wins"), F.count_if(F.expr("not first and own")).alias("b_wins"))
    across = dense.cosine_top_k(sides["a"], sides["b"], 2, "id", "vec", decimals=9).where(F.col("id") - F.col("qid") != step).agg(F.max("score").alias("other_max"))
    own = rows.agg(F.count("*").alias("n"), F.avg(dot(F.col("a"), F.col("b"))).alias("pair_mean"), F.min(dot(F.col("a"), F.col("b"))).alias("pair_min"), F.sum(dot(F.col("a"), F.col("b"))).alias("same"))
    sums = [rows.select(F.posexplode(c).alias("slot", "x")).groupBy("slot").agg(F.sum("x").alias(c)) for c in "ab"]
    every = sums[0].join(sums[1], "slot").agg(F.sum(F.col("a") * F.col("b")).alias("every"))
    # one row each
    told = own.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(wins)).crossJoin(F.broadcast(across))
    n = F.col("n")
    told = told.withColumn("other_mean", F.when(n > 1, (F.col("every") - F.col("same")) / (n * (n - 1))))
    good = (F.col("a_wins") == n) & (F.col("b_wins") == n) & (F.col("pair_mean") - F.col("other_mean") >= SEPARATION)
    return told.select("n", *[F.round(c, 4).alias(c) for c in ("pair_mean", "pair_min", "other_mean", "other_max")], "a_wins", "b_wins", F.when(good, "aligned").otherwise("weak or no alignment").alias("verdict"))
