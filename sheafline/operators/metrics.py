"""Scoring of rankings and runs against ground truth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens


def retrieval_metrics(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per question with gold documents: recall, precision, mrr, ndcg, hit.

    ranking: (qid, doc, place), distinct documents; recall, nDCG and hit look at the
    first k, precision divides by how many of them there are, MRR sees the whole list.
    """
    marked = ranking.join(gold.select("qid", "doc", F.lit(1).alias("good")), ["qid", "doc"], "left")
    good, top = F.coalesce("good", F.lit(0)), F.col("place") <= k
    # gain by place is summed per question; the ideal is a sum of the first min(k, n) gains
    per = marked.groupBy("qid").agg(
        F.sum(F.when(top, good).otherwise(0)).alias("found"),
        F.sum(F.when(top, 1).otherwise(0)).alias("given"),
        F.max(F.when(good == 1, 1.0 / F.col("place"))).alias("mrr"),
        F.sum(F.when(top & (good == 1), 1.0 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    wanted = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = wanted.join(per, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "qid",
        F.round(zero(F.col("found") / F.col("n_gold")), 6).alias("recall"),
        F.round(zero(F.when(F.col("given") > 0, F.col("found") / F.col("given"))), 6).alias("precision"),
        F.round(zero(F.col("mrr")), 6).alias("mrr"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"),
        (F.coalesce("found", F.lit(0)) > 0).alias("hit"),
    )


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """The mean of the parts that are not null, by their weights; null if all are."""
    top = sum((F.coalesce(c.cast("double"), F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def headline(recall: Column, quote: Column, ndcg: Column, abstained: Column) -> Column:
    return weighted_mean([(recall, 0.4), (quote, 0.3), (ndcg, 0.2), (abstained, 0.1)])


def decision(*scores: Column) -> Column:
    """The plain mean of all; null unless all are there."""
    return sum(scores[1:], scores[0]) / len(scores)


def spread(rows: DataFrame, by: str, score: Column) -> DataFrame:
    """(by, n, mean, stderr) of a score that is not null; no error for fewer than two."""
    got = rows.select(by, score.alias("s")).where("s is not null")
    return got.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("s"), 6).alias("mean"),
        F.round(F.when(F.count("*") > 1, F.stddev_samp("s") / F.sqrt(F.count("*"))), 6).alias("stderr"),
    )


def verdict(runs: DataFrame, by: str, name: str) -> DataFrame:
    """(by, leader, lead, verdict): the first of each group and whether its lead exceeds the combined error.

    unranked: fewer than two scores; unknown: an error is missing.
    """
    order = W.partitionBy(by).orderBy(F.desc_nulls_last("mean"), name)
    top = runs.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    pick = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    two = top.groupBy(by).agg(*[pick(c, n).alias(f"{c}_{n}") for c in (name, "mean", "stderr") for n in (1, 2)])
    lead = F.col("mean_1") - F.col("mean_2")
    error = F.sqrt(F.pow("stderr_1", 2) + F.pow("stderr_2", 2))
    word = F.when(F.col("mean_2").isNull(), "unranked").when(error.isNull(), "unknown").when(lead > error, "winner").otherwise("tie")
    return two.select(by, F.col(f"{name}_1").alias("leader"), F.round(lead, 6).alias("lead"), word.alias("verdict"))


def fuzzy_quotes(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """``pairs`` (quote, text) with found: contained, or nearly so; the slow test runs only where the plain one fails.

    Nearly: the longest common substring's share of the quote is at least ``least``.
    That is so if a stretch of the shortest such length is in the text.
    """
    plain = F.contains("text", "quote") & (F.col("quote") != "")
    n = F.length("quote")
    k = F.ceil(n * least)  # the product may be off by a rounding
    some = F.greatest(n, F.lit(1))
    k = F.when((k - 1) / some >= least, k - 1).when(k / some >= least, k).otherwise(k + 1).cast("int")
    near = F.exists(F.sequence(F.lit(1), n - k + 1), lambda i: F.contains("text", F.substring("quote", i, k)))
    near = F.when((n > 0) & (k >= 1) & (F.length("text") >= k), near).otherwise(F.lit(False))
    left = pairs.where(~F.coalesce(plain, F.lit(False))).withColumn("found", near)
    return pairs.where(plain).withColumn("found", F.lit(True)).unionByName(left)


#: Texts of questions that are sent to every task at most, and cells of texts by questions that are counted at once.
OVERLAP_QUESTIONS, OVERLAP_CELLS = 20_000, 1 << 22


def largest_overlap(asked: DataFrame, told: DataFrame) -> DataFrame:
    """(item_id, overlap): the largest share of a question's distinct tokens that one of the texts has; 0 where none has any.

    asked: (item_id, text), told: (text). Texts stay where they are read: each task counts the tokens
    that its texts have of each question and sends on one number for a question. More than OVERLAP_QUESTIONS questions
    meet the texts on their tokens, by digests.
    """
    words = lambda rows: rows.withColumn("words", F.array_distinct(tokens(F.col("text"))))
    left = words(asked.select("item_id", "text").distinct()).where(F.size("words") > 0).select("item_id", F.sha2("text", 256).alias("asking"), "words")
    rows = left.limit(OVERLAP_QUESTIONS + 1).toArrow()  # bounded by the limit
    if rows.num_rows > OVERLAP_QUESTIONS:
        many = left.select("item_id", "asking", F.size("words").alias("n"), F.explode("words").alias("token"))
        right = words(told.select("text").distinct()).select(F.sha2("text", 256).alias("other"), F.explode("words").alias("token"))
        shares = many.join(right, "token").groupBy("item_id", "asking", "other").agg((F.count("*") / F.first("n")).alias("share"))
    else:
        shared = told.sparkSession.sparkContext.broadcast((rows.column("item_id").combine_chunks(), rows.column("words").combine_chunks()))
        kind = dict(asked.dtypes)["item_id"]

        def count(batches):
            ids, lists = shared.value
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            known = flat.unique()
            # the questions of every token, one after another
            of = pc.index_in(flat, known).to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            owners = np.repeat(np.arange(len(sizes)), sizes)[order]
            first = np.searchsorted(of[order], np.arange(len(known) + 1))
            best = np.zeros(len(sizes))
            step = max(1, OVERLAP_CELLS // max(len(sizes), 1))
            for batch in batches:
                for k in range(0, batch.num_rows if len(sizes) else 0, step):
                    part = batch.column(0).slice(k, step)
                    row = np.repeat(np.arange(len(part)), pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False))
                    token = pc.index_in(part.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
                    row, token = row[token >= 0], token[token >= 0]
                    many = first[token + 1] - first[token]
                    at = np.repeat(first[token] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    cells = np.bincount(np.repeat(row, many) * len(sizes) + owners[at], minlength=len(part) * len(sizes)).reshape(len(part), len(sizes))
                    best = np.maximum(best, (cells / sizes).max(axis=0, initial=0.0))
            yield pa.RecordBatch.from_arrays([ids, pa.array(best)], ["item_id", "share"])

        shares = words(told.select("text")).select("words").mapInArrow(count, f"item_id {kind}, share double")
    best = shares.groupBy("item_id").agg(F.max("share").alias("share"))
    return asked.select("item_id").distinct().join(best, "item_id", "left").select("item_id", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("overlap"))


def quote_recall(quotes: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, quote_recall): the share of a question's quotes that some context holds; quotes: (qid, quote_id), found: the same, of those held."""
    hit = found.select("qid", "quote_id").distinct().withColumn("hit", F.lit(1))
    rows = quotes.join(hit, ["qid", "quote_id"], "left")
    return rows.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("quote_recall"))


def average_precision(grades: DataFrame, least: float = 0.5) -> DataFrame:
    """(qid, context_precision) of contexts (qid, rank, similarity) that count from ``least`` on."""
    w = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = grades.withColumn("good", (F.col("similarity") >= least).cast("int")).withColumn("at", F.sum("good").over(w) / F.row_number().over(W.partitionBy("qid").orderBy("rank")))
    return rows.groupBy("qid").agg(F.round(F.coalesce(F.sum(F.col("at") * F.col("good")) / F.nullif(F.sum("good"), F.lit(0)), F.lit(0.0)), 6).alias("context_precision"))


#: Judge calls that a sample takes for each metric, besides one for each retrieved chunk (fixed values).
JUDGE_CALLS = {"faithfulness": 2, "answer_relevancy": 1, "context_recall": 1, "factual_correctness": 2}


def expected_judge_calls(n_samples: int, k: int, include_factual: bool = True) -> int:
    """About how many calls a judged run makes; answers in a wrong form, asked for again, come on top."""
    each = sum(JUDGE_CALLS.values()) - (0 if include_factual else JUDGE_CALLS["factual_correctness"])
    return max(n_samples, 0) * (each + max(k, 0))
