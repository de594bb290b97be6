"""Whole runs: all questions through one configuration, their scores, and sweeps over configurations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.embedders import EMBEDDERS
from ..plans.config import RetrievalConfig
from . import levels, metrics, retrieve, scopes
from .index import Index


@dataclass
class Corpus:
    """chunks (id, text) with their index; slots (id, slot, weight) of the hash embedding named by embedder; facts (id; day, importance for rerankers; span_from, span_to, layer, level and labels for scopes) and members (summary, id) of summary rows, if they are needed."""

    chunks: DataFrame
    index: Index
    slots: DataFrame | None = None
    facts: DataFrame | None = None
    vectors: DataFrame | None = None
    embedder: str = "ascii-hash"
    members: DataFrame | None = None


def retrieve_all(corpus: Corpus, questions: DataFrame, config: RetrievalConfig, anchor: Column | None = None, where: dict | None = None, asked_on: dt.date | None = None) -> DataFrame:
    """(qid, id, rank): the contexts of every question (qid, question) under the configuration.

    where: a metadata filter on the columns of corpus.facts. With config.time_filter, a question that speaks of a
    time finds rows of that time alone; it counts from its asked_at (a column of questions) or, for all, from asked_on. With the
    scope ``drill-down``, summaries are found and each is followed by its best covered members.
    """
    if config.problems():
        raise ValueError("; ".join(config.problems()))
    within = None
    plain = config.summary_scope == "mixed" and not config.summary_levels
    if where or config.time_filter or not plain:
        timed = scopes.question_scopes(questions, asked_on) if config.time_filter else None
        within = scopes.Within(corpus.facts, timed, where, config.summary_scope, config.summary_levels)
    rankings = []
    if config.retriever != "bm25":
        embed = EMBEDDERS[corpus.embedder]
        slots = corpus.slots if corpus.slots is not None else embed(corpus.chunks, "id", "text")
        asked = embed(questions.withColumnRenamed("question", "text"), "qid", "text")
        rankings.append(retrieve.sparse_dense(slots, asked, config.candidates, within))
    if config.retriever != "dense":
        rankings.append(retrieve.bm25(corpus.index, questions, config.candidates, config.multi_query, within))
    found = retrieve.fuse(rankings, config.rrf_k) if len(rankings) > 1 else rankings[0]
    if config.summary_boost != 1:
        found = retrieve.boosted(found, corpus.facts.select("id", "layer"), config.summary_boost).drop("layer")
    found = found.where(F.col("rank") <= max(config.rerank_depth, config.k))
    cover = None
    if config.reranker == "lexical" or config.grade_threshold > 0:
        cover = retrieve.idf_coverage(corpus.index, questions, found)
    if config.reranker == "lexical":
        found = retrieve.rerank_lexical(found, cover)
    elif config.reranker == "recency":
        found = retrieve.rerank_recency(found, corpus.facts, anchor, config.recency_half_life_days)
    elif config.reranker == "agentic":
        found = retrieve.rerank_agentic(found, corpus.facts, anchor, config.agentic_weights, config.recency_half_life_days)
    elif config.reranker != "none":
        raise ValueError(f"{config.reranker} needs a model; see retrieve.rerank_with")
    if config.mmr_lambda < 1:
        found = retrieve.mmr(found, corpus.vectors, config.mmr_lambda, config.k)
    found = found.where(F.col("rank") <= config.k)
    if config.grade_threshold > 0:
        found = retrieve.gate(found, cover.withColumnRenamed("coverage", "grade"), config.grade_threshold)
    if config.summary_scope == "drill-down":
        below = corpus.members.withColumnRenamed("summary", "up").join(found.select("qid", F.col("id").alias("up")), "up").select("qid", "id").distinct()
        opened = levels.drill(found.select("qid", "id", "rank"), corpus.members, retrieve.idf_coverage(corpus.index, questions, below), config.k)
        # a row that several summaries lead to counts where it comes first
        first = opened.groupBy("qid", "id").agg(F.min(F.struct("rank", "depth", F.coalesce("expanded_from", F.lit("")).alias("up"), "place")).alias("at"))
        order = W.partitionBy("qid").orderBy("at.rank", "at.depth", "at.up", "at.place", "id")
        found = first.withColumn("rank", F.row_number().over(order)).select("qid", "id", "rank")
    sizes = corpus.chunks.select("id", F.length("text").alias("size"))
    return retrieve.fit_budget(found.select("qid", "id", "rank"), sizes, config.max_context_chars)


def evaluate(contexts: DataFrame, gold: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Per question: its retrieval scores if it has gold documents, else whether it was rightly left unanswered.

    gold: (qid, doc); a chunk's id stands for its document.
    """
    scores = metrics.retrieval_metrics(contexts.select("qid", F.col("id").alias("doc"), F.col("rank").alias("place")), gold, k)
    kept = retrieve.abstained(questions, contexts)
    rows = kept.join(scores, "qid", "left")
    answerable = F.col("recall").isNotNull()
    return rows.select(
        "qid", "n_contexts", "recall", "precision", "mrr", "ndcg", "hit",
        F.when(answerable, F.col("abstained")).alias("false_abstention"),
        F.when(~answerable, F.col("abstained")).alias("abstained_correctly"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row: the means of all measures, each over the questions that have it."""
    measures = ("recall", "precision", "mrr", "ndcg", "hit", "false_abstention", "abstained_correctly")
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in measures])


def sweep(corpus: Corpus, questions: DataFrame, gold: DataFrame, variants: dict[str, RetrievalConfig], anchor: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, n, mean, stderr) of the variants' decision scores, and the verdict on the best of them. All share one index."""
    rows = None
    for name, config in variants.items():
        part = evaluate(retrieve_all(corpus, questions, config, anchor), gold, questions, config.k).withColumn("name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    scores = metrics.spread(rows, "name", metrics.decision(*[F.col(c) for c in ("recall", "precision", "mrr", "ndcg")]))
    return scores, metrics.verdict(scores.withColumn("sweep", F.lit(1)), "sweep", "name")


def judge_screen(claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, claim, context, supported): each claim with a number as it is and with a changed one, where one can be made.

    claims: (qid, claim); contexts: (qid, context).
    """
    both = claims.join(contexts, "qid").withColumn("changed", text.mutate_number(F.col("claim"), F.col("context"))).where("changed is not null")
    true = both.select("qid", "claim", "context", F.lit(True).alias("supported"))
    return true.unionByName(both.select("qid", F.col("changed").alias("claim"), "context", F.lit(False).alias("supported")))
