"""Retrieval: lexical and dense candidates, fusion, reranking, gating, diversity, budgets.

All questions are answered at once; a ranking is a table (qid, id, score, rank).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import age_days, decay
from ..functions.text import INTERROGATIVES, ascii_tokens, query_variants, tokens
from ..functions.vectors import ASCII_HASH_SLOTS, hash_slots
from .index import Index
from .saved import saved
from .scopes import Within
from .sizes import small

K1, B = 1.5, 0.75
RRF_K = 60


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank by (score descending, id) within each question; with k, the first k only."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def query_terms(questions: DataFrame, variants: bool = False) -> DataFrame:
    """(qid, variant, token): the distinct tokens of each question, or of each of its variants."""
    if variants:
        questions = questions.select("qid", F.posexplode(query_variants(F.col("question"))).alias("variant", "question"))
    else:
        questions = questions.withColumn("variant", F.lit(0))
    return questions.select("qid", "variant", F.explode(F.array_distinct(tokens(F.col("question")))).alias("token"))


def wanted_terms(questions: DataFrame) -> DataFrame:
    """(token): the tokens of all questions and their variants."""
    return query_terms(questions).select("token").unionByName(query_terms(questions, variants=True).select("token")).distinct()


#: Numbers in the matrix of tokens and questions that is sent to every task at most.
SCAN_CELLS = 1 << 23
#: Numbers in the matrix of texts and tokens that a task makes at a time.
STEP_CELLS = 1 << 21


def bm25(index: Index, questions: DataFrame, k: int = 40, variants: bool = False, within: Within | None = None) -> DataFrame:
    """The k best of each question by BM25, of scores above 0; with variants, a chunk's best score of any; of the rows ``within``, if given.

    Texts of an index for questions stay where they are: each batch is a matrix, multiplied with that of the
    questions' weights, of which every question keeps k rows; the result is saved. Within bounds, for too many questions
    or ids of several rows, only postings of the questions' tokens are scored: the terms are joined to the
    questions first, and the postings to what is left.
    """
    asked = query_terms(questions, variants)
    if within is None and _scannable(index, asked):
        return saved(ranked(_scan(index, asked, k), k), "bm25")
    return ranked(_joined(index, asked, variants, within), k)


def _scannable(index: Index, asked: DataFrame) -> bool:
    """Whether texts are held and the matrix of asked (qid, variant, token) fits into SCAN_CELLS."""
    if index.held is None:
        return False
    size = asked.agg(F.count_distinct("token").alias("t"), F.count_distinct(F.struct("qid", "variant")).alias("c")).first()
    return size.t * size.c <= SCAN_CELLS


def _joined(index: Index, asked: DataFrame, variants: bool = False, within: Within | None = None) -> DataFrame:
    """(qid, id, score): all BM25 scores above 0, from postings."""
    weighted = small(asked.join(index.terms.select("token", "idf"), "token"))
    norm = F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / F.col("avg_len"))
    postings = within.rows(index.postings) if within else index.postings
    hits = postings.join(weighted, "token").crossJoin(F.broadcast(index.stats))  # stats is one row
    scored = hits.groupBy("qid", "variant", "id").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))
    if variants:
        scored = scored.groupBy("qid", "id").agg(F.max("score").alias("score"))
    scored = within.pairs(scored) if within else scored
    return scored.where("score > 0").select("qid", "id", F.round("score", 6).alias("score"))


def weight_matrix(asked: DataFrame) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Weights (tokens by questions' variants), tokens, each question's first column, questions; of asked (qid, variant, token, idf), which fit into SCAN_CELLS."""
    rows = asked.select("qid", "variant", "token", "idf").distinct().toArrow()
    qids = pc.unique(rows.column("qid"))
    names = pc.unique(rows.column("token"))
    place = pc.index_in(rows.column("qid"), qids).to_numpy()
    column, of = np.unique(place.astype(np.int64) * 8 + rows.column("variant").to_numpy(), return_inverse=True)  # three variants at most
    weights = np.zeros((len(names), len(column)))
    weights[pc.index_in(rows.column("token"), names).to_numpy(), of] = rows.column("idf").to_numpy()
    return weights, names, np.searchsorted(column // 8, np.arange(len(qids))), qids


def _scan(index: Index, asked: DataFrame, k: int, by_owner: bool = False) -> DataFrame:
    """(qid, id, score): of each batch of texts each question's k best by BM25; asked (qid, variant, token) and its weights fit into SCAN_CELLS.

    By owner, (qid, id, score, owner): the best text of each of the k best owners.
    """
    weights, names, firsts, qids = weight_matrix(asked.join(index.terms.select("token", "idf"), "token"))
    shared = index.held.sparkSession.sparkContext.broadcast((weights, names, firsts, qids))
    avg_len = float(index.stats.first().avg_len or 1.0)
    kinds = dict(index.held.dtypes)["id"], dict(asked.dtypes)["qid"]

    def products(batches):
        weights, names, firsts, qids = shared.value
        if not len(names):
            return
        step = max(1, STEP_CELLS // len(names))
        for batch in batches:
            score = np.empty((len(qids), batch.num_rows))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                sizes = pc.list_value_length(part.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = pc.index_in(part.column("tokens").flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
                cells, tf = np.unique(row * len(names) + codes[codes >= 0], return_counts=True)
                norm = tf + K1 * (1 - B + B * np.maximum(part.column("dl").to_numpy(), 1)[cells // len(names)] / avg_len)
                m = np.zeros(len(sizes) * len(names))
                m[cells] = tf * (K1 + 1) / norm
                found = m.reshape(len(sizes), len(names)) @ weights
                score[:, i : i + step] = np.maximum.reduceat(found, firsts, axis=1).T
            yield from best_owners_of(score, batch.column("id"), batch.column("owner"), qids, k) if by_owner else best_of(score, batch.column("id"), qids, k)

    owner = [("owner", dict(index.held.dtypes)["owner"])] if by_owner else []
    found = (index.held.where("id is not null") if by_owner else index.held).mapInArrow(products, ", ".join(f"{c} {kind}" for c, kind in [("qid", kinds[1]), ("id", kinds[0]), ("score", "double"), *owner]))
    return found.withColumn("score", F.round("score", 6))


def best_of(exact: np.ndarray, ids: pa.Array, qids: pa.Array, k: int):
    """Of the scores of questions (rows) and ids the k best of each by their rounded value, ties to the smaller id, if above 0."""
    if not len(ids) or not len(qids):
        return
    score = np.round(exact, 6)
    place = np.empty(len(ids), np.int64)  # of equal scores the smaller id comes first
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.zeros(len(score))
    row, at = np.nonzero((score >= least[:, None]) & (score > 0))
    order = np.lexsort((place[at], -score[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[kept], at[kept]
    yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), ids.take(pa.array(at)), pa.array(exact[row, at])], ["qid", "id", "score"])


def best_owners_of(exact: np.ndarray, ids: pa.Array, owners: pa.Array, qids: pa.Array, k: int):
    """As best_of(), of each question's k best owners the best id; ids without an owner are left out."""
    coded = owners.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place, codes))[int((codes < 0).sum()) :]  # by owner, then by id
    if not len(order) or not len(qids):
        return
    score, edges = np.round(exact[:, order], 6), np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    at = np.stack([low + score[:, low:high].argmax(axis=1) for low, high in zip(edges, edges[1:])], axis=1)
    top = np.take_along_axis(score, at, 1)
    row, owner = np.nonzero(top > 0)
    sort = np.lexsort((place[order[at[row, owner]]], -top[row, owner], row))
    row, owner = row[sort], owner[sort]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, owner = row[kept], owner[kept]
    best = order[at[row, owner]]
    yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), ids.take(pa.array(best)), pa.array(exact[row, best]), coded.dictionary.take(pa.array(owner))], ["qid", "id", "score", "owner"])


def best_owners(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """(qid, owner, place): the k best owners of each question, each by the best of all its texts by BM25, ties to the smaller id.

    Texts of an index for questions stay where they are, as in bm25(); the result is saved.
    """
    asked = query_terms(questions)
    found = _scan(index, asked, k, by_owner=True) if _scannable(index, asked) else _joined(index, asked).join(index.owners, "id")
    best = found.groupBy("qid", "owner").agg(F.min(F.struct((-F.col("score")).alias("score"), "id")).alias("best"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("best", "owner"))
    return saved(best.withColumn("place", place).where(F.col("place") <= k).select("qid", "owner", "place"), "owners")


def sparse_dense(chunk_slots: DataFrame, query_slots: DataFrame, k: int = 40, within: Within | None = None) -> DataFrame:
    """The k best by the product of sparse unit vectors: (id, slot, weight) against (qid, slot, weight); of the rows ``within``, if given."""
    chunk_slots = within.rows(chunk_slots) if within else chunk_slots
    asked = small(query_slots.select("qid", "slot", F.col("weight").alias("w")))
    scored = chunk_slots.join(asked, "slot").groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score"))
    return ranked(within.pairs(scored) if within else scored, k)


#: Questions whose vectors are sent to every task at most.
SCAN_QUESTIONS = 20_000


def dense_scan(chunks: DataFrame, questions: DataFrame, k: int = 40) -> DataFrame:
    """As sparse_dense() with ASCII-hash vectors, from texts: chunks (id, text) against questions (qid, text).

    Chunks stay where they are read: each batch is a matrix, multiplied with that of all questions, of which
    every question keeps k rows. More than SCAN_QUESTIONS questions are joined by slots instead.
    """
    slot = lambda c: F.transform(ascii_tokens(F.col(c)), lambda t: F.conv(F.right(F.md5(t), F.lit(2)), 16, 10).cast("int") % ASCII_HASH_SLOTS)
    asked = questions.select("qid", slot("text").alias("slots"))
    if asked.count() > SCAN_QUESTIONS:
        return sparse_dense(hash_slots(chunks, "id", "text"), hash_slots(questions, "qid", "text"), k)
    held = asked.toArrow()  # at most SCAN_QUESTIONS rows
    shared = chunks.sparkSession.sparkContext.broadcast((_slot_matrix(held.column("slots").combine_chunks()), held.column("qid").combine_chunks()))
    kinds = dict(chunks.dtypes)["id"], dict(questions.dtypes)["qid"]

    def products(batches):
        q, qids = shared.value
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            exact = q @ _slot_matrix(batch.column("slots")).T
            score = np.where(exact > 0, np.round(exact, 6), -1.0)
            place = np.empty(batch.num_rows, np.int64)  # of equal scores the smaller id comes first
            place[pc.sort_indices(batch.column("id")).to_numpy()] = np.arange(batch.num_rows)
            least = np.partition(score, -k, axis=1)[:, -k] if batch.num_rows > k else np.zeros(len(score))
            row, at = np.nonzero((score >= least[:, None]) & (exact > 0))
            order = np.lexsort((place[at], -score[row, at], row))
            row, at = row[order], at[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[kept], at[kept]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), batch.column("id").take(pa.array(at)), pa.array(score[row, at])], ["qid", "id", "score"])

    return saved(ranked(chunks.select("id", slot("text").alias("slots")).mapInArrow(products, f"qid {kinds[1]}, id {kinds[0]}, score double"), k), "dense")


def _slot_matrix(slots: pa.Array) -> np.ndarray:
    """Rows of unit length from lists of slots; a list without any is a zero row."""
    counts = pc.list_value_length(slots).fill_null(0).to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(len(slots)), counts) * ASCII_HASH_SLOTS + slots.flatten().to_numpy(zero_copy_only=False)
    m = np.bincount(cells.astype(np.int64), minlength=len(slots) * ASCII_HASH_SLOTS).reshape(len(slots), ASCII_HASH_SLOTS).astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def fuse(rankings: list[DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (rrf_k + rank) over the rankings."""
    rows = None
    for r in rankings:
        part = r.select("qid", "id", (F.lit(1.0) / (rrf_k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return ranked(rows.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score")))


def boosted(ranking: DataFrame, layers: DataFrame, boost: float) -> DataFrame:
    """Scores of summary rows times boost, before the cut; ``layers``: (id, layer)."""
    out = ranking.join(layers, "id", "left")
    return ranked(out.withColumn("score", F.when(F.col("layer") == "summary", F.col("score") * boost).otherwise(F.col("score"))).drop("rank"))


def minmax(score: Column, by: str = "qid") -> Column:
    """Scaled to 0-1 within a question; 0.5 where all are equal."""
    w = W.partitionBy(by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.when(span < 1e-9, 0.5).otherwise((score - low) / span)


def _weighted_terms(index: Index, questions: DataFrame) -> DataFrame:
    """(token, qid, idf) as idf_coverage() takes them."""
    asked = query_terms(questions).where(~F.col("token").isin(*INTERROGATIVES)).drop("variant")
    return asked.join(index.terms.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))


def idf_coverage(index: Index, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, id, coverage): the share of the question's idf that the chunk's tokens cover.

    Interrogatives don't count; a token unknown to the index weighs 1.
    """
    weighted = _weighted_terms(index, questions)
    total = weighted.groupBy("qid").agg(F.sum("idf").alias("total"))
    if index.held is not None:  # the texts of the pairs, if these can be broadcast
        told = index.held.join(small(pairs.select("id").distinct()), "id", "left_semi").select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    else:
        told = index.postings.select("id", "token")
    hits = told.join(small(pairs.select("qid", "id")), "id").join(small(weighted), ["qid", "token"])
    covered = hits.groupBy("qid", "id").agg(F.sum("idf").alias("covered"))
    out = pairs.select("qid", "id").join(covered, ["qid", "id"], "left").join(small(total), "qid", "left")
    return out.select("qid", "id", F.round(F.coalesce(F.col("covered") / F.col("total"), F.lit(0.0)), 6).alias("coverage"))


def rerank_lexical(candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Half the relevance, half the coverage scaled within the question."""
    both = candidates.join(coverage, ["qid", "id"])
    score = 0.5 * minmax(F.col("score")) + 0.5 * minmax(F.col("coverage"))
    return ranked(both.select("qid", "id", F.round(score, 6).alias("score")))


def rerank_recency(candidates: DataFrame, dates: DataFrame, anchor: Column, half_life: float = 180) -> DataFrame:
    """Relevance times the decay of age; ``dates``: (id, day)."""
    both = candidates.join(dates, "id", "left")
    return ranked(both.select("qid", "id", F.round(minmax(F.col("score")) * decay(age_days(F.col("day"), anchor), half_life), 6).alias("score")))


def rerank_agentic(candidates: DataFrame, facts: DataFrame, anchor: Column, weights=(1.0, 0.3, 0.2), half_life: float = 180) -> DataFrame:
    """Weighted relevance, recency and importance; ``facts``: (id, day, importance)."""
    both = candidates.join(facts, "id", "left")
    score = weights[0] * minmax(F.col("score")) + weights[1] * decay(age_days(F.col("day"), anchor), half_life) + weights[2] * F.coalesce("importance", F.lit(0.0))
    return ranked(both.select("qid", "id", F.round(score, 6).alias("score")))


def rerank_with(candidates: DataFrame, texts: DataFrame, model, share: float = 1.0) -> DataFrame:
    """Scores of an injected callable (questions, texts) -> numbers, mixed as share * model + (1 - share) * relevance."""
    both = candidates.withColumn("rel", minmax(F.col("score"))).join(texts, "id").select("qid", "id", "rel", "question", "text")

    def run(frames):
        for f in frames:
            f["score"] = share * np.asarray(model(f["question"].tolist(), f["text"].tolist()), float) + (1 - share) * f["rel"]
            yield f[["qid", "id", "score"]]

    kinds = dict(both.dtypes)
    return ranked(both.mapInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, score double"))


def gate(candidates: DataFrame, grades: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose grade reaches the threshold; ``grades``: (qid, id, grade)."""
    return ranked(candidates.join(grades, ["qid", "id"]).where(F.col("grade") >= threshold).drop("rank", "grade"))


def abstained(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """(qid, n_contexts, abstained): whether nothing was kept for a question."""
    counts = kept.groupBy("qid").agg(F.count("*").alias("n"))
    out = questions.select("qid").join(counts, "qid", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("qid", n.cast("long").alias("n_contexts"), (n == 0).alias("abstained"))


def mmr(candidates: DataFrame, vectors: DataFrame, lam: float, k: int) -> DataFrame:
    """The k of each question by maximal marginal relevance.

    Greedy, so one small group (the candidates of a question, of reranking depth) is a
    task's unit. Candidates without a vector are compared as unlike all others.
    """
    if lam >= 1:
        return candidates.where(F.col("rank") <= k)
    rows = candidates.join(vectors.select("id", "vec"), "id", "left")
    kinds = dict(rows.dtypes)

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank"], kind="stable").reset_index(drop=True)
        dim = max((len(v) for v in f["vec"] if v is not None), default=1)
        m = np.array([np.zeros(dim) if v is None else np.asarray(v, float) for v in f["vec"]])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        near, left, order = np.zeros(len(f)), list(range(len(f))), []
        while left and len(order) < k:
            best = max(left, key=lambda i: (lam * f["score"][i] - (1 - lam) * (near[i] if order else 0.0), -i))
            order.append(best)
            left.remove(best)
            near = np.maximum(near, m @ m[best]) if len(order) > 1 else m @ m[best]
        out = f.loc[order, ["qid", "id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return rows.groupBy("qid").applyInPandas(pick, f"qid {kinds['qid']}, id {kinds['id']}, score double, rank int")


def covered_members(index: Index, questions: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(qid, owner, id, coverage): of all texts of the owners kept (qid, owner) for a question; among them are the k best covered of each.

    Coverage is that of idf_coverage(), ids are strings, ties go to the smaller. Texts of an index for questions stay where they are;
    each batch keeps k of every question and owner.
    """
    weighted = _weighted_terms(index, questions)
    if not _scannable(index, query_terms(questions)):
        pairs = index.owners.join(small(kept.select("qid", "owner")), "owner")
        told = pairs.join(idf_coverage(index, questions, pairs.select("qid", "id").distinct()), ["qid", "id"])
        return told.select("qid", "owner", F.col("id").cast("string").alias("id"), "coverage")
    weights, names, _, qids = weight_matrix(weighted.withColumn("variant", F.lit(0)))
    chosen = kept.select("qid", "owner").distinct().toArrow()  # k of each question, whose terms fit into SCAN_CELLS
    shared = index.held.sparkSession.sparkContext.broadcast((weights, weights.sum(axis=0), names, pc.index_in(chosen.column("qid"), qids).fill_null(-1).to_numpy(), chosen))

    def products(batches):
        weights, total, names, columns, chosen = shared.value
        step = max(1, STEP_CELLS // max(1, len(names)))
        for batch in batches:
            coded = batch.column("owner").dictionary_encode()
            place = np.empty(batch.num_rows, np.int64)
            place[pc.sort_indices(batch.column("id")).to_numpy()] = np.arange(batch.num_rows)
            order = np.lexsort((place, coded.indices.to_numpy(zero_copy_only=False)))
            edges = np.searchsorted(coded.indices.to_numpy(zero_copy_only=False)[order], np.arange(len(coded.dictionary) + 1))
            wanting = pc.index_in(chosen.column("owner"), coded.dictionary).fill_null(-1).to_numpy()
            for owner in np.unique(wanting[wanting >= 0]):
                asking = np.flatnonzero(wanting == owner)
                known = columns[asking] >= 0  # a question of interrogatives alone covers nothing
                for low in range(edges[owner], edges[owner + 1], step):
                    rows = order[low : min(low + step, edges[owner + 1])]
                    words = batch.column("tokens").take(pa.array(rows))
                    codes = pc.index_in(words.flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(rows)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
                    m = np.zeros((len(rows), len(names)))
                    m[row[codes >= 0], codes[codes >= 0]] = 1
                    covered = np.zeros((len(rows), len(asking)))
                    covered[:, known] = np.round(m @ weights[:, columns[asking[known]]] / total[columns[asking[known]]], 6)
                    best = np.argsort(-covered, axis=0, kind="stable")[:k]
                    of = np.broadcast_to(np.arange(len(asking)), best.shape)
                    told = [chosen.column(c).combine_chunks().take(pa.array(asking[of.ravel()])) for c in ("qid", "owner")]
                    yield pa.RecordBatch.from_arrays([*told, batch.column("id").take(pa.array(rows[best.ravel()])), pa.array(covered[best.ravel(), of.ravel()])], ["qid", "owner", "id", "coverage"])

    kinds = dict(kept.dtypes)
    held = index.held.where("id is not null and owner is not null").select(F.col("id").cast("string").alias("id"), "owner", "tokens")
    return held.mapInArrow(products, f"qid {kinds['qid']}, owner {kinds['owner']}, id string, coverage double")


def drill_down(kept: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Kept summaries with their members behind them, the best covered first, k of each at most.

    kept: (qid, owner, place); members: (qid, owner, id, coverage) with the k best covered of each at least. Returns
    qid, at, expanded_from, id, place.
    """
    order = W.partitionBy("qid", "owner").orderBy(F.desc("coverage"), "id")
    graded = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    graded = graded.join(small(kept.select("qid", "owner", F.col("place").alias("at"))), ["qid", "owner"])
    own = kept.select("qid", F.col("place").alias("at"), F.lit(None).cast(dict(kept.dtypes)["owner"]).alias("expanded_from"), F.col("owner").alias("id"), F.lit(0).alias("place"))
    return own.unionByName(graded.select("qid", "at", F.col("owner").alias("expanded_from"), "id", "place"))


def fit_budget(kept: DataFrame, sizes: DataFrame, budget: int = 6000) -> DataFrame:
    """In order of rank, what still fits; what doesn't is skipped, the first always stays.

    The fold runs over one question's kept contexts, k at most.
    """
    rows = small(kept).join(sizes, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "size"))).alias("rows"))
    folded = F.expr(f"""aggregate(rows, named_struct('used', 0L, 'kept', slice(rows, 1, 0)),
      (a, r) -> if(size(a.kept) = 0 or a.used + r.size <= {budget},
        named_struct('used', a.used + cast(r.size as bigint), 'kept', concat(a.kept, array(r))), a), a -> a.kept)""")
    return rows.select("qid", F.inline(folded))


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """(qid, id, <stage>_rank for every stage): where a candidate stood at each; null where it wasn't."""
    rows = None
    for name, r in stages.items():
        part = r.select("qid", "id", F.lit(name).alias("stage"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("qid", "id").agg(*[F.max(F.when(F.col("stage") == n, F.col("rank"))).alias(f"{n}_rank") for n in stages])


def first_documents(ranking: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, doc, place): the distinct documents of a ranking in order of their first chunk; ``documents``: (id, doc)."""
    firsts = small(ranking).join(documents, "id").groupBy("qid", "doc").agg(F.min("rank").alias("at"))
    return firsts.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("at", "doc"))).select("qid", "doc", "place")


#: What an answerer says where it has nothing to go by, by language.
REFUSALS = {
    "English": "I could not find anything about this in the diary.",
    "German": "Ich habe dazu im Tagebuch nichts gefunden.",
}


def extractive_answer(contexts: DataFrame, questions: DataFrame, most: int = 3, chars: int = 300, refusal: str = REFUSALS["English"]) -> DataFrame:
    """(qid, answer): the longest sentence, cut, of each of the first contexts, with its document; the refusal if there are none.

    contexts: (qid, rank, doc, text); questions: (qid), each of which has a row.
    """
    from ..functions.text import sentences

    best = F.array_max(F.transform(sentences(F.col("text")), lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))
    line = F.concat(F.substring(best["s"], 1, chars), F.lit(" ["), F.col("doc").cast("string"), F.lit("]"))
    rows = contexts.where(F.col("rank") <= most).select("qid", "rank", line.alias("line")).where("line is not null")
    parts = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("p"))
    answers = parts.select("qid", F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("answer"))
    return questions.select("qid").distinct().join(answers, "qid", "left").select("qid", F.coalesce("answer", F.lit(refusal)).alias("answer"))


def is_refusal(answer: Column) -> Column:
    """Whether an answer is one of the refusals, white space around it aside; null is none."""
    return F.coalesce(F.trim(answer).isin(*REFUSALS.values()), F.lit(False))
