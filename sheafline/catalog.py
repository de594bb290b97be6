"""The registered queries: name -> (query, SQL for DuckDB or None).

Each query applies an operator to whole tables. The SQL is written from the
operator's definition, not from its code.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import dates, embedders, persian, text, vectors
from .operators import board, chunking, dense, evidence, filters, hierarchy, index, levels, metrics, probe, retrieve, scopes, split, stored_index
from .operators.saved import saved, step_folder
from .operators.sizes import small
from .plans.config import PRODUCTION, IndexConfig
from .sources.vector_store import VectorStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Table = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers f(t), where t(name) reads a table, under its name."""

    def add(f: Callable[[Table], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ shared pieces

_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2)"
_INDEX = rf"""
WITH tok AS (SELECT doc_id AS id, {_TOKENS.format("text")} AS tokens FROM documents),
sized AS (SELECT id, tokens, len(tokens) AS dl FROM tok),
postings AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS token FROM sized) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(greatest(dl, 1)) AS avg_len FROM sized),
terms AS (SELECT token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY token),
asked AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS.format("text")}) AS token FROM benchmark)"""
_BM25 = (
    _INDEX
    + """,
scored AS (
  SELECT qid, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(dl, 1) / avg_len))), 6) AS score
  FROM asked JOIN terms USING (token) JOIN postings USING (token), stats GROUP BY qid, id),
bm25 AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 40)"""
)
_SLOTS = """
SELECT id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM (
  SELECT id, CAST(('0x' || right(md5(token), 2)) AS INTEGER) % 128 AS slot, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {0} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM {1}) GROUP BY ALL)"""
_DENSE = f"""
c AS ({_SLOTS.format("doc_id", "documents")}), q AS ({_SLOTS.format("item_id", "benchmark")}),
dense AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.id AS qid, c.id AS id, round(sum(c.weight * q.weight), 6) AS score FROM c JOIN q USING (slot) GROUP BY ALL)) WHERE rank <= 40)"""
_HYBRID = (
    _BM25
    + ","
    + _DENSE
    + """,
fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM bm25 UNION ALL SELECT qid, id, rank FROM dense) GROUP BY ALL))"""
)
_INTERROGATIVES = ", ".join(f"'{w}'" for w in text.INTERROGATIVES)
_COVERAGE = (
    _BM25
    + f""",
weighted AS (SELECT qid, asked.token, coalesce(idf, 1.0) AS idf FROM asked LEFT JOIN terms USING (token) WHERE asked.token NOT IN ({_INTERROGATIVES})),
total AS (SELECT qid, sum(idf) AS total FROM weighted GROUP BY qid),
covered AS (SELECT w.qid, b.id, sum(w.idf) AS covered FROM bm25 b JOIN weighted w ON w.qid = b.qid JOIN postings p ON p.id = b.id AND p.token = w.token GROUP BY ALL),
coverage AS (SELECT b.qid, b.id, round(coalesce(c.covered / t.total, 0.0), 6) AS coverage FROM bm25 b LEFT JOIN covered c ON c.qid = b.qid AND c.id = b.id LEFT JOIN total t ON t.qid = b.qid)"""
)
_MINMAX = "CASE WHEN max({0}) OVER (PARTITION BY qid) - min({0}) OVER (PARTITION BY qid) < 1e-9 THEN 0.5 ELSE ({0} - min({0}) OVER (PARTITION BY qid)) / (max({0}) OVER (PARTITION BY qid) - min({0}) OVER (PARTITION BY qid)) END"
_GOLD = r"""
gold AS (SELECT item_id AS qid, doc_id AS doc FROM
  (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) JOIN
  (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark) ON contains(t, q) OR contains(q, t) WHERE t <> '' AND q <> '')"""


def _questions(t: Table) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _index(t: Table) -> index.Index:
    return index.build(t("documents"), "doc_id", "text")


def _asked_index(t: Table) -> index.Index:
    """The index as far as the questions need it."""
    return index.build(t("documents"), "doc_id", "text", retrieve.wanted_terms(_questions(t)))


def _bm25(t: Table) -> DataFrame:
    return retrieve.bm25(_asked_index(t), _questions(t), 40)


def _dense(t: Table) -> DataFrame:
    return retrieve.dense_scan(t("documents").select(F.col("doc_id").alias("id"), "text"), t("benchmark").select(F.col("item_id").alias("qid"), "text"), 40)


def _gold(t: Table) -> DataFrame:
    docs = t("documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    return evidence.gold_pairs(docs, t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote")))


def _parts(t: Table) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_idx"), "role", "text")


# ------------------------------------------------------------------ text and index


@query(f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_tokens, CAST(len(list_distinct(x)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS x FROM documents)")
def tokenize_stats(t: Table) -> DataFrame:
    x = text.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS BIGINT) AS n FROM documents")
def ascii_tokens(t: Table) -> DataFrame:
    return t("documents").select("doc_id", F.size(text.ascii_tokens(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT item_id, unnest(list_transform(range(1, greatest(length(x) - 3, 1) + 1), lambda i: substring(x, i, 4))) AS gram
FROM (SELECT item_id, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS x FROM benchmark) WHERE length(x) > 0""")
def char_ngrams(t: Table) -> DataFrame:
    return t("benchmark").select("item_id", F.explode(text.char_ngrams(F.col("text"))).alias("gram"))


@query(r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?…])\s+', chr(92) || '1' || chr(10), 'g'), '\n'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""".replace("chr(92) || '1' || chr(10)", "'\\1\n'"))
def sentence_stats(t: Table) -> DataFrame:
    s = text.sentences(F.col("text"))
    longest = F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0))
    return t("documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), longest.cast("long").alias("longest"))


@query(f"""SELECT item_id, coalesce(nullif(array_to_string(list_filter({_TOKENS.format('text')}, lambda x: x NOT IN ({_INTERROGATIVES})), ' '), ''), text) AS keywords FROM benchmark""")
def keyword_query(t: Table) -> DataFrame:
    return t("benchmark").select("item_id", text.keyword_query(F.col("text")).alias("keywords"))


def _language_sql() -> str:
    count = {lang: "len(list_filter(x, lambda w: w IN (" + ", ".join(f"'{w}'" for w in ws) + ")))" for lang, ws in text.FUNCTION_WORDS.items()}
    most = f"greatest({', '.join(count.values())})"
    cases = " ".join(f"WHEN {c} = {most} THEN '{lang}'" for lang, c in count.items())
    return f"SELECT doc_id, CASE WHEN {most} = 0 THEN 'und' {cases} END AS detected FROM (SELECT doc_id, {_TOKENS.format('text')} AS x FROM documents)"


@query(_language_sql())
def language_detect(t: Table) -> DataFrame:
    return t("documents").select("doc_id", text.language(F.col("text")).alias("detected"))


@query(_INDEX + " SELECT token, df, round(idf, 6) AS idf FROM terms")
def term_idf(t: Table) -> DataFrame:
    return _index(t).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(_INDEX + " SELECT id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, CAST(max(tf) AS BIGINT) AS top_tf FROM postings GROUP BY id")
def postings_stats(t: Table) -> DataFrame:
    return _index(t).postings.groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("top_tf"))


@query("SELECT count(*) AS n_chunks, round(avg(length(coalesce(text, ''))), 1) AS avg_chars, CAST(floor(quantile_cont(length(coalesce(text, '')), 0.95)) AS BIGINT) AS p95_chars FROM documents")
def index_stats(t: Table) -> DataFrame:
    return index.size_stats(t("documents"), "text")


@query(f"SELECT id, slot, round(weight, 6) AS weight FROM ({_SLOTS.format('doc_id', 'documents')})")
def ascii_hash_embed(t: Table) -> DataFrame:
    found = vectors.hash_slots(t("documents").withColumnRenamed("doc_id", "id"), "id", "text")
    return found.select("id", "slot", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------ retrieval


@query(_BM25 + " SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 8")
def bm25_top8(t: Table) -> DataFrame:
    return _bm25(t).where("rank <= 8")


_VARIANTS = f"""
variants AS (SELECT qid, unnest(list_distinct(list_filter([question, kw, long_words], lambda x: x IS NOT NULL))) AS v FROM (
  SELECT item_id AS qid, text AS question, coalesce(nullif(array_to_string(list_filter({_TOKENS.format('text')}, lambda x: x NOT IN ({_INTERROGATIVES})), ' '), ''), text) AS kw,
    nullif(array_to_string(list_filter({_TOKENS.format('text')}, lambda x: length(x) >= 6), ' '), '') AS long_words FROM benchmark)),
vasked AS (SELECT DISTINCT qid, v, unnest({_TOKENS.format('v')}) AS token FROM variants),
vscored AS (SELECT qid, id, round(max(s), 6) AS score FROM (
  SELECT qid, v, id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(dl, 1) / avg_len))) AS s
  FROM vasked JOIN terms USING (token) JOIN postings USING (token), stats GROUP BY ALL) GROUP BY qid, id)"""


@query(_INDEX + "," + _VARIANTS + " SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vscored WHERE score > 0) WHERE rank <= 8")
def bm25_multi_query(t: Table) -> DataFrame:
    return retrieve.bm25(_asked_index(t), _questions(t), 8, variants=True)


@query(f"WITH {_DENSE} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 8")
def dense_hash_top8(t: Table) -> DataFrame:
    return _dense(t).where("rank <= 8")


@query(_HYBRID + " SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank <= 8")
def hybrid_rrf(t: Table) -> DataFrame:
    return retrieve.fuse([_bm25(t), _dense(t)]).where("rank <= 8")


@query(_HYBRID + """ SELECT f.qid, f.id, CAST(b.rank AS INTEGER) AS bm25_rank, CAST(d.rank AS INTEGER) AS dense_rank, CAST(f.rank AS INTEGER) AS fused_rank
FROM fused f LEFT JOIN bm25 b USING (qid, id) LEFT JOIN dense d USING (qid, id)""")
def trace_ladder(t: Table) -> DataFrame:
    lexical, near = _bm25(t), _dense(t)
    return retrieve.trace({"bm25": lexical, "dense": near, "fused": retrieve.fuse([lexical, near])})


@query(_COVERAGE + " SELECT * FROM coverage")
def idf_coverage(t: Table) -> DataFrame:
    ix = _asked_index(t)
    return retrieve.idf_coverage(ix, _questions(t), retrieve.bm25(ix, _questions(t), 40))


def _reranked_sql(score: str, more: str = "") -> str:
    return _COVERAGE + f""", mixed AS (SELECT b.qid, b.id, b.score, coverage FROM bm25 b JOIN coverage c USING (qid, id)),
re AS (SELECT qid, id, round({score}, 6) AS score FROM (SELECT *, {_MINMAX.format('score')} AS rel, {_MINMAX.format('coverage')} AS cov FROM mixed) {more})
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM re"""


@query(_reranked_sql("0.5 * rel + 0.5 * cov"))
def lexical_rerank(t: Table) -> DataFrame:
    ix = _asked_index(t)
    found = retrieve.bm25(ix, _questions(t), 40)
    return retrieve.rerank_lexical(found, retrieve.idf_coverage(ix, _questions(t), found))


#: Documents get a date from their id, as the tables have none.
_DAY = "date_add(date '2024-01-01', cast(doc_id % 365 as int))"


@query(_BM25 + " SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 8")
def stored_bm25(t: Table) -> DataFrame:
    """BM25 on an index in the shared folder, which the first call for these documents builds."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    held = stored_index.stored(docs.sparkSession, docs, {"columns": ["doc_id", "text"]})
    return held.search(_questions(t), 40).where("rank <= 8")


_SCOPED = """ d AS (SELECT doc_id AS id, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS day FROM documents),
q AS (SELECT item_id AS qid, DATE '2024-01-01' + CAST(item_id * 37 % 300 AS INTEGER) AS first, DATE '2024-01-01' + CAST(item_id * 37 % 300 + 10 + item_id % 90 AS INTEGER) AS last FROM benchmark)"""


def _dated(t: Table) -> tuple[DataFrame, DataFrame]:
    """Documents with a day, and for every question a range of days of its own; both from ids, as the tables have no dates for them."""
    number = lambda day: F.date_format(day, "yyyyMMdd").cast("int")
    day = number(F.expr(_DAY))
    facts = t("documents").select(F.col("doc_id").alias("id"), day.alias("span_from"), day.alias("span_to"), "lang", "n_chars")
    first = F.expr("date_add(date '2024-01-01', cast(item_id * 37 % 300 as int))")
    last = F.expr("date_add(date '2024-01-01', cast(item_id * 37 % 300 + 10 + item_id % 90 as int))")
    return facts, t("benchmark").select(F.col("item_id").alias("qid"), number(first).alias("span_from"), number(last).alias("span_to"))


@query(_BM25.replace("WHERE score > 0)", "JOIN d USING (id) JOIN q USING (qid) JOIN documents o ON o.doc_id = id WHERE score > 0 AND day BETWEEN first AND last AND lang IN ('en', 'de') AND n_chars >= 300)").replace("WITH tok AS", "WITH" + _SCOPED + ", tok AS") + " SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 8")
def scoped_bm25(t: Table) -> DataFrame:
    """BM25 where each question has its own time scope and all have a metadata filter; the index stays that of all documents."""
    facts, asked = _dated(t)
    within = scopes.Within(facts, asked, {"$and": [{"lang": {"$in": ["en", "de"]}}, {"n_chars": {"$gte": 300}}]})
    return retrieve.bm25(_asked_index(t), _questions(t), 40, within=within).where("rank <= 8")


@query("WITH" + _SCOPED + " SELECT qid, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM q JOIN d ON day BETWEEN first AND last GROUP BY qid")
def time_scope_pairs(t: Table) -> DataFrame:
    """The documents in every question's time scope, by buckets of days; counted, and their ids summed."""
    facts, asked = _dated(t)
    pairs = scopes.overlapping(asked.withColumnRenamed("qid", "left_id"), facts.withColumnRenamed("id", "right_id"))
    return pairs.groupBy(F.col("left_id").alias("qid")).agg(F.count("*").alias("n"), F.sum("right_id").alias("ids"))


@query(_reranked_sql("rel * power(0.5, abs(date_diff('day', DATE '2024-01-01' + CAST(id % 365 AS INTEGER), DATE '2025-01-01')) / 180.0)"))
def recency_rerank(t: Table) -> DataFrame:
    days = t("documents").select(F.col("doc_id").alias("id"), F.expr(_DAY).alias("day"))
    return retrieve.rerank_recency(_bm25(t), days, F.lit("2025-01-01"))


@query(_reranked_sql("rel + 0.3 * power(0.5, abs(date_diff('day', DATE '2024-01-01' + CAST(id % 365 AS INTEGER), DATE '2025-01-01')) / 180.0) + 0.2 * coalesce(quality, 0)", "LEFT JOIN (SELECT doc_id, quality FROM labels) l ON l.doc_id = id"))
def agentic_rerank(t: Table) -> DataFrame:
    facts = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.expr(_DAY).alias("day"), chunking.importance(F.col("quality"), 0, 1).alias("importance")
    )
    return retrieve.rerank_agentic(_bm25(t), facts, F.lit("2025-01-01"))


@query(_COVERAGE + """, kept AS (SELECT qid, count(*) AS n FROM coverage WHERE coverage >= 0.6 GROUP BY qid)
SELECT item_id AS qid, coalesce(n, 0) AS n_contexts, coalesce(n, 0) = 0 AS abstained FROM benchmark LEFT JOIN kept ON qid = item_id""")
def lexical_gate(t: Table) -> DataFrame:
    ix = _asked_index(t)
    found = retrieve.bm25(ix, _questions(t), 40)
    grades = retrieve.idf_coverage(ix, _questions(t), found).withColumnRenamed("coverage", "grade")
    return retrieve.abstained(_questions(t), retrieve.gate(found, grades, 0.6))


@query(_BM25 + """ SELECT qid, doc AS source, CAST(row_number() OVER (PARTITION BY qid ORDER BY best, doc) AS INTEGER) AS place FROM (
  SELECT qid, source AS doc, min(rank) AS best FROM bm25 JOIN documents ON doc_id = id GROUP BY ALL)""")
def first_documents(t: Table) -> DataFrame:
    owners = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"))
    return retrieve.first_documents(_bm25(t), owners).withColumnRenamed("doc", "source")


@query()
def context_budget(t: Table) -> DataFrame:
    """The fold over a question's contexts; tested against a loop."""
    sizes = t("documents").select(F.col("doc_id").alias("id"), F.length("text").alias("size"))
    return retrieve.fit_budget(_bm25(t).where("rank <= 8"), sizes, 6000)


@query()
def mmr_diversify(t: Table) -> DataFrame:
    """Greedy per question; tested against a loop."""
    found = _bm25(t).where("rank <= 20")
    docs = t("documents").withColumnRenamed("doc_id", "id").join(small(found.select("id").distinct()), "id", "left_semi")  # only candidates are compared
    return retrieve.mmr(found, embedders.dense(docs), 0.7, 8)


@query()
def token_hash_embed(t: Table) -> DataFrame:
    """BLAKE2b is not in SQL; tested against a loop."""
    return embedders.token_hash(t("documents"), "doc_id", "text")


@query()
def char_hash_embed(t: Table) -> DataFrame:
    """BLAKE2b is not in SQL; tested against a loop."""
    return embedders.char_hash(t("documents"), "doc_id", "text")


@query()
def extractive_answer(t: Table) -> DataFrame:
    rows = _bm25(t).join(t("documents").select(F.col("doc_id").alias("id"), "text"), "id").select("qid", "rank", F.col("id").alias("doc"), "text")
    return retrieve.extractive_answer(rows, _questions(t))


@query()
def drill_down(t: Table) -> DataFrame:
    """The two best sources of every question as summaries, each by the best of all its documents, and behind each the three best covered of all its documents."""
    ix = index.build(t("documents"), "doc_id", "text", retrieve.wanted_terms(_questions(t)), "source")
    kept = retrieve.best_owners(ix, _questions(t), 2)
    return retrieve.drill_down(kept, retrieve.covered_members(ix, _questions(t), kept, 3), 3)


# ------------------------------------------------------------------ vectors

_KNN = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
s AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS ql, b.label AS l, round(list_sum(list_transform(range(1, len(a.u) + 1), lambda i: a.u[i] * b.u[i])), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5)
"""


def _knn(t: Table) -> DataFrame:
    return dense.cosine_top_k(t("embeddings"), t("embeddings"), 5, "vec_id", "embedding")


@query("""WITH p AS (SELECT a.vec_id // 2 AS i, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
pool AS (SELECT i, 0 AS side, a AS v FROM p UNION ALL SELECT i, 1, b FROM p),
near AS (SELECT q.i, q.side, o.i AS oi, o.side AS os, row_number() OVER (PARTITION BY q.i, q.side ORDER BY round(list_cosine_similarity(q.v, o.v), 9) DESC, o.side, o.i) AS r FROM pool q JOIN pool o ON q.i <> o.i OR q.side <> o.side),
own AS (SELECT count(*) AS n, avg(list_cosine_similarity(a, b)) AS pm, min(list_cosine_similarity(a, b)) AS pi FROM p),
other AS (SELECT avg(list_cosine_similarity(x.a, y.b)) AS om, max(list_cosine_similarity(x.a, y.b)) AS ox FROM p x JOIN p y ON x.i <> y.i),
w AS (SELECT count(*) FILTER (side = 0 AND os = 1 AND oi = i) AS aw, count(*) FILTER (side = 1 AND os = 0 AND oi = i) AS bw FROM near WHERE r = 1)
SELECT n, round(pm, 4) AS pair_mean, round(pi, 4) AS pair_min, round(om, 4) AS other_mean, round(ox, 4) AS other_max, aw AS a_wins, bw AS b_wins,
  CASE WHEN aw = n AND bw = n AND pm - om >= 0.3 THEN 'aligned' ELSE 'weak or no alignment' END AS verdict FROM own, other, w""")
def bilingual_probe(t: Table) -> DataFrame:
    """Vectors of even and next odd ids as the two languages of a pair."""
    rows = t("embeddings")
    odd = rows.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return probe.bilingual(rows.where("vec_id % 2 = 0").join(odd, "vec_id").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").alias("a"), "b"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def persian_tokens(t: Table) -> DataFrame:
    """Persian tokens of every document; in texts of other scripts they are the neutral ones."""
    return t("documents").select("doc_id", persian.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("""WITH v AS (SELECT e.vec_id AS id, embedding AS v, label, row_number() OVER (ORDER BY e.vec_id) AS o FROM embeddings e WHERE e.vec_id % 7 <> 3),
s AS (SELECT q.vec_id AS qid, v.id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.v AS DOUBLE[])), 6) AS score FROM embeddings q, v WHERE v.label % 2 = 1 OR v.label >= 6)
SELECT qid, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")
def vector_store_nearest(t: Table) -> DataFrame:
    """The embeddings kept in a store, some of them deleted and stored anew, and the nearest of every embedding under a filter."""
    rows = t("embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    spark = rows.sparkSession
    store = VectorStore(spark, f"{step_folder(spark)}/vectors-{uuid.uuid4().hex}")
    told = rows.select(F.lpad(F.col("qid").cast("string"), 18, "0").alias("id"), F.lit("").alias("text"), "vec", F.create_map(F.lit("parity"), F.when(F.col("label") % 2 == 1, "odd").otherwise("even")).alias("labels"), F.create_map(F.lit("label"), F.col("label").cast("double")).alias("numbers"))
    store.upsert(told)
    store.delete(told.where("cast(id as bigint) % 7 = 3").select("id"))
    store.upsert(told.where("cast(id as bigint) % 7 = 4"))
    found = store.nearest(rows.select("qid", "vec"), 5, {"$or": [{"parity": "odd"}, {"label": {"$gte": 6}}]})
    return found.select("qid", F.col("id").cast("long").alias("id"), "score", "rank")


@query(_KNN + "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_cosine(t: Table) -> DataFrame:
    return _knn(t)


@query(_KNN + "SELECT ql AS label, round(avg(CAST(l = ql AS DOUBLE)), 6) AS precision, count(*) AS n FROM knn GROUP BY ql")
def knn_label_precision(t: Table) -> DataFrame:
    labels = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("l"))
    rows = _knn(t).join(labels, "id").join(labels.select(F.col("id").alias("qid"), F.col("l").alias("label")), "qid")
    return rows.groupBy("label").agg(F.round(F.avg((F.col("l") == F.col("label")).cast("double")), 6).alias("precision"), F.count("*").alias("n"))


@query(_KNN + "SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(score) AS weight FROM knn WHERE score > 0 GROUP BY ALL")
def knn_edges(t: Table) -> DataFrame:
    return hierarchy.knn_edges(_knn(t))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS slot, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL")
def mean_vector(t: Table) -> DataFrame:
    return dense.mean_vectors(t("embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT label, vec_id AS id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS mean FROM c GROUP BY ALL), n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY label),
s AS (SELECT label, id, round(sum(CAST(x AS DOUBLE) * mean) / any_value(norm), 6) AS score FROM c JOIN m USING (label, i) JOIN n USING (label) GROUP BY ALL)
SELECT label, id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS INTEGER) AS place FROM s""")
def centroid_order(t: Table) -> DataFrame:
    return dense.centroid_order(t("embeddings"), "vec_id", "label", "embedding")


# ------------------------------------------------------------------ hierarchy

_RARE = _INDEX + """, rare AS (SELECT * FROM (SELECT id, token, round(idf, 6) AS idf, row_number() OVER (PARTITION BY id ORDER BY df, token) AS place
  FROM postings JOIN terms USING (token)) WHERE place <= 12)"""
_EDGES = _RARE + """, kept AS (SELECT token FROM rare GROUP BY token HAVING count(*) BETWEEN 2 AND (SELECT greatest(2, n // 5) FROM stats)),
edges AS (SELECT x.id AS a, y.id AS b, round(sum(x.idf), 6) AS weight FROM rare x JOIN rare y USING (token) WHERE x.id < y.id AND token IN (FROM kept) GROUP BY ALL)"""


def _edges(t: Table) -> DataFrame:
    ix = _index(t)
    return hierarchy.lexical_edges(hierarchy.rare_terms(ix), ix.stats)


@query(_RARE + " SELECT id, token, idf, CAST(place AS INTEGER) AS place FROM rare")
def rare_terms_top12(t: Table) -> DataFrame:
    return hierarchy.rare_terms(_index(t))


@query(_EDGES + " SELECT * FROM edges")
def lexical_edges(t: Table) -> DataFrame:
    return _edges(t)


@query(_EDGES + " SELECT count(*) AS n_edges, round(2 * count(*) / (any_value(n) * (any_value(n) - 1)), 6) AS density FROM edges, (SELECT count(*) AS n FROM documents)")
def graph_density(t: Table) -> DataFrame:
    return hierarchy.density(_edges(t), t("documents").count())


@query(_KNN + """, e AS (SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(score) AS w FROM knn WHERE score > 0 GROUP BY ALL), lab AS (SELECT vec_id, label FROM embeddings),
x AS (SELECT w, p.label AS la, q.label AS lb FROM e JOIN lab p ON p.vec_id = a JOIN lab q ON q.vec_id = b),
i AS (SELECT la AS label, sum(w) AS inside FROM x WHERE la = lb GROUP BY la), d AS (SELECT label, sum(w) AS degree FROM (SELECT la AS label, w FROM x UNION ALL SELECT lb, w FROM x) GROUP BY label)
SELECT round(sum(coalesce(inside, 0) / m - pow(degree / (2 * m), 2)), 6) AS modularity, count(*) AS n_groups FROM d LEFT JOIN i USING (label), (SELECT sum(w) AS m FROM e)""")
def graph_modularity(t: Table) -> DataFrame:
    return hierarchy.modularity(hierarchy.knn_edges(_knn(t)), t("embeddings").select(F.col("vec_id").alias("id"), "label"))


@query()
def label_propagation(t: Table) -> DataFrame:
    """Iterative; tested against a loop."""
    return hierarchy.label_propagation(hierarchy.knn_edges(_knn(t)))


_LEVELS = """
WITH a AS (SELECT d.doc_id, text, coalesce(lang, '') || '|' || coalesce(source, '') AS g, quality FROM documents d LEFT JOIN labels USING (doc_id)),
b AS (SELECT g, count(*) AS members, min(doc_id) AS first, round(avg(coalesce(quality, 0)), 3) AS importance FROM a GROUP BY g HAVING count(*) >= 3),
c AS (SELECT *, row_number() OVER (ORDER BY first, g) - 1 AS no, split_part(g, '|', 1) AS up FROM b),
d AS (SELECT up, count(*) AS members, min(no) AS first, round(avg(importance), 3) AS importance FROM c GROUP BY up HAVING count(*) >= 3),
e AS (SELECT *, row_number() OVER (ORDER BY first, up) - 1 AS no FROM d)"""


def _levels(t: Table) -> tuple[DataFrame, levels.Hierarchy]:
    """Documents under their languages and sources, and these under their languages; two levels of summaries."""
    docs = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("no"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.coalesce("quality", F.lit(0)).cast("double").alias("importance"))
    leaves = saved(embedders.with_dense(rows).withColumn("document", F.col("id")), "leaves")

    def once(below: DataFrame) -> DataFrame:
        own = leaves.select("id", F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("source", F.lit(""))).alias("made"))
        return below.join(own, "id", "left").select(F.coalesce("made", F.substring_index("group", "|", 1)).alias("group"), "id")

    return leaves, levels.build(leaves, once, embedders.dense, levels=2, summarizer="lead-idf")


@query(
    _LEVELS
    + """
SELECT 'summary:h1-' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS id, 1 AS level, g AS "group", members, importance FROM c
UNION ALL SELECT 'summary:h2-' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END, 2, up, members, importance FROM e"""
)
def hierarchy_levels(t: Table) -> DataFrame:
    return _levels(t)[1].summaries.select("id", "level", "group", "members", "importance")


@query(
    _LEVELS
    + """, r AS (SELECT 1 AS level, g AS name, doc_id FROM a JOIN c USING (g) UNION ALL SELECT 2, up, doc_id FROM a JOIN c USING (g) JOIN d USING (up))
SELECT level, name AS "group", count(*) AS leaves, CAST(sum(doc_id) AS BIGINT) AS ids FROM r GROUP BY ALL"""
)
def hierarchy_leaves(t: Table) -> DataFrame:
    """The leaves that every summary speaks for, through both levels."""
    _, built = _levels(t)
    found = levels.speaks_for(built.members, 2).join(built.summaries.select(F.col("id").alias("summary"), "level", "group"), "summary")
    return found.groupBy("level", "group").agg(F.count("*").alias("leaves"), F.sum(F.col("leaf").cast("long")).alias("ids"))


@query()
def summary_texts(t: Table) -> DataFrame:
    """The four summarisers on the documents of every source; each is tested against a loop."""
    rows = t("documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("group"), F.coalesce("text", F.lit("")).alias("text"))
    held = saved(embedders.with_dense(rows).where("vec is not null").select("group", F.col("id").alias("no"), "text", "vec", F.col("id").cast("string").alias("document")), "members")
    terms = saved(index.build(rows, "id", "text").terms, "terms")
    out = [make(held, terms).select(F.lit(name).alias("summariser"), "group", "text") for name, make in levels.SUMMARISERS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query()
def kmeans_groups(t: Table) -> DataFrame:
    """Iterative; tested by its properties."""
    return hierarchy.kmeans_groups(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 10)


@query("SELECT lang AS \"group\", doc_id AS id FROM documents UNION ALL SELECT source, doc_id FROM documents WHERE source <> lang")
def metadata_groups(t: Table) -> DataFrame:
    rows = t("documents").select("doc_id", F.array_compact(F.array_distinct(F.array("lang", "source"))).alias("tags"))
    return hierarchy.metadata_groups(rows, "doc_id", ["tags"])[1]


@query("SELECT count(*) AS n_groups, min(n) AS smallest, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median, max(n) AS largest, CAST(count(*) FILTER (n = 1) AS BIGINT) AS singles FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def level_stats(t: Table) -> DataFrame:
    return hierarchy.level_stats(t("documents"), "source")


@query("SELECT source, count(*) AS members, round(avg(n_chars), 3) AS mean, min(doc_id) AS first, max(doc_id) AS last, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS kinds FROM documents GROUP BY source")
def group_card(t: Table) -> DataFrame:
    return hierarchy.group_card(t("documents"), "source", "n_chars", "doc_id", "lang")


@query("""SELECT source, max(quality) AS confidence, round(avg(toxic), 3) AS mean_toxic, count(DISTINCT lang) AS n_langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_rollup(t: Table) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.max("quality").alias("confidence"), F.round(F.avg("toxic"), 3).alias("mean_toxic"), F.count_distinct("lang").alias("n_langs"))


# ------------------------------------------------------------------ chunking


@query("SELECT conv_id AS doc_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def doc_join(t: Table) -> DataFrame:
    return chunking.join_parts(_parts(t), prefix="role").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk_idx, turn AS part_start, turn AS part_end, text FROM conversations")
def part_chunks(t: Table) -> DataFrame:
    return chunking.part_chunks(_parts(t))


@query("""SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, min(turn) AS part_start, max(turn) AS part_end, string_agg(text, chr(10) ORDER BY turn) AS text FROM (
  SELECT conv_id AS doc_id, turn, text, sum(o) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS chunk_idx FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 OR role = 'user' THEN 1 ELSE 0 END AS o FROM conversations)) GROUP BY ALL""")
def label_boundary_chunks(t: Table) -> DataFrame:
    return chunking.label_chunks(_parts(t), F.col("role") == "user")


@query(r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_idx, piece AS text FROM (
  SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n|\. '), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents))""")
def separator_chunks(t: Table) -> DataFrame:
    return chunking.separator_chunks(t("documents"), [". ", "\n"])


def _packed_sql(size: int) -> str:
    """long (doc_id, s, e, path, text) packed greedily: packed (the same columns, k, text)."""
    return f"""
words AS (SELECT doc_id, s, e, path, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '\\S+') AS w FROM long)),
lined AS (SELECT doc_id, s, e, path, list(word ORDER BY i) AS w, list(upto ORDER BY i) AS ends FROM (
  SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id, s, path ORDER BY i) AS upto FROM words) GROUP BY ALL),
lines AS (
  SELECT doc_id, s, e, path, w, ends, 0 AS k, 1 AS i, greatest(1, len(list_filter(ends, lambda x: x - 1 <= {size}))) AS j FROM lined
  UNION ALL SELECT doc_id, s, e, path, w, ends, k + 1, j + 1, greatest(j + 1, len(list_filter(ends, lambda x: x - ends[j] - 1 <= {size}))) FROM lines WHERE j < len(w)),
packed AS (SELECT doc_id, s, e, path, k, array_to_string(w[i:j], ' ') AS text FROM lines)"""


@query(f"""WITH RECURSIVE long AS (SELECT doc_id, 0 AS s, 0 AS e, 0 AS path, coalesce(text, '') AS text FROM documents),{_packed_sql(500)}
SELECT doc_id, CAST(k AS INTEGER) AS chunk_idx, text FROM packed""")
def word_pack_chunks(t: Table) -> DataFrame:
    return chunking.budget_chunks(t("documents"), 500)


@query(r"""WITH RECURSIVE words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents)),
lined AS (SELECT doc_id, list(word ORDER BY i) AS w, list(upto ORDER BY i) AS ends FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM words) GROUP BY ALL),
lines AS (
  SELECT doc_id, w, ends, 0 AS k, 1 AS i, greatest(1, len(list_filter(ends, lambda x: x - 1 <= 500))) AS j FROM lined
  UNION ALL SELECT doc_id, w, ends, k + 1, n, greatest(n, len(list_filter(ends, lambda x: x - coalesce(ends[n - 1], 0) - 1 <= 500))) FROM (
    SELECT *, greatest(i + 1, least(j, 1 + len(list_filter(ends, lambda x: x < coalesce(ends[i - 1], 0) + 400)))) AS n FROM lines WHERE j < len(w)))
SELECT doc_id, CAST(k AS INTEGER) AS chunk_idx, array_to_string(w[i:j], ' ') AS text FROM lines""")
def sliding_windows(t: Table) -> DataFrame:
    return chunking.window_chunks(t("documents"), 500, 100)


@query()
def drift_chunks(t: Table) -> DataFrame:
    """Conversations cut where consecutive turns drift apart."""
    parts = _parts(t)
    slot = vectors.hash_slots(parts.withColumn("id", F.struct("doc_id", "part_idx")), "id", "text")
    full = slot.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"))
    vec = full.select("id.*", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))
    return chunking.drift_chunks(parts.join(vec, ["doc_id", "part_idx"], "left"))


@query(rf"""WITH RECURSIVE p AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text, max(idx) AS last FROM p GROUP BY doc_id),
pieces AS (
  SELECT doc_id, 0 AS s, last AS e, 0 AS path, text FROM d WHERE length(text) <= 300
  UNION ALL SELECT p.doc_id, idx, idx, 0, p.text FROM p JOIN d USING (doc_id) WHERE length(d.text) > 300),
long AS (SELECT * FROM pieces WHERE length(text) > 300),{_packed_sql(300)},
chunks AS (SELECT doc_id, s, e, 0 AS k, text FROM pieces WHERE length(text) <= 300 UNION ALL SELECT doc_id, s, e, k, text FROM packed),
roles AS (SELECT doc_id, s, string_agg(role, ' ' ORDER BY first) AS roles FROM (
  SELECT p.doc_id, s, role, min(idx) AS first FROM p JOIN pieces ON p.doc_id = pieces.doc_id AND idx BETWEEN s AND e GROUP BY ALL) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS c FROM chunks)
SELECT doc_id, c AS chunk_no, doc_id || ':c' || c AS chunk_id, s AS part_start, e AS part_end, roles,
  '[turns: ' || (last + 1) || ']' || chr(10) || n.text AS text FROM n JOIN d USING (doc_id) JOIN roles USING (doc_id, s)""")
def split_parts_over_budget(t: Table) -> DataFrame:
    """Conversations as production cuts them: whole if they fit, else by turns, and longer turns at words; with prefixes and roles."""
    parts = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_idx"), "role", "text")
    turns = parts.groupBy("doc_id").agg(F.count("*").alias("turns"))
    config = IndexConfig(split_plan=PRODUCTION[0].split_plan, chunk_chars=300)
    out = split.index_chunks(parts, turns, config, ["turns"], ["role"])
    return out.select("doc_id", "chunk_no", "chunk_id", "part_start", "part_end", F.array_join("role", " ").alias("roles"), "text")


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM d WHERE length(text) > 500)),
b AS (SELECT doc_id, i, unnest(l) AS text, unnest(range(len(l))) AS j FROM (SELECT doc_id, i, list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM a WHERE length(text) > 500)),
pieces AS (SELECT doc_id, 0 AS s, -1 AS e, [i] AS path, text FROM a WHERE length(text) <= 500 UNION ALL SELECT doc_id, 0, -1, [i, j], text FROM b),
long AS (SELECT * FROM pieces WHERE length(text) > 500),{_packed_sql(500)},
chunks AS (
  SELECT doc_id, 0 AS span, CAST([] AS BIGINT[]) AS path, text FROM d WHERE length(text) <= 500
  UNION ALL SELECT doc_id, -1, path, text FROM pieces WHERE length(text) <= 500 UNION ALL SELECT doc_id, -1, list_concat(path, [k]), text FROM packed),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS c FROM chunks)
SELECT doc_id, c AS chunk_no, doc_id || ':c' || c AS chunk_id, span AS part_start, span AS part_end, md5(n.text) AS digest,
  CASE WHEN lang IS NULL AND source IS NULL THEN '' ELSE '[' || concat_ws(' | ', 'lang: ' || lang, 'source: ' || source) || ']' || chr(10) END AS prefix FROM n JOIN d USING (doc_id)""")
def split_separators_over_budget(t: Table) -> DataFrame:
    """Documents cut at line ends, then at sentence ends, then at words, each only where a piece is over the budget."""
    docs = t("documents").select("doc_id", "lang", "source", "text")
    parts = docs.select("doc_id", F.lit(0).alias("part_idx"), "text")
    config = IndexConfig(split_plan='document / "\\n" over-budget / ". " over-budget')
    out = split.index_chunks(parts, docs, config, ["lang", "source"])
    body = F.expr("substring(text, length(prefix) + 1)")
    return out.select("doc_id", "chunk_no", "chunk_id", "part_start", "part_end", F.md5(body).alias("digest"), "prefix")


@query()
def split_drift(t: Table) -> DataFrame:
    """Conversations cut where turns drift apart or a turn says ``however``, then what is over the budget by user turns."""
    parts = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_idx"), "role", "text")
    chunks, _ = split.carry_out(parts, 'document / drift or "however" / role=user over-budget', budget=400, overlap=80, prefix="role")
    return chunks


@query("""SELECT doc_id, CASE WHEN lang IS NULL AND source IS NULL AND quality IS NULL THEN '' ELSE
 '[' || concat_ws(' | ', 'lang: ' || lang, 'source: ' || source, 'quality: ' || CAST(quality AS VARCHAR)) || ']' || chr(10) END AS prefix FROM documents LEFT JOIN labels USING (doc_id)""")
def contextual_prefix(t: Table) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", chunking.contextual_prefix([(c, F.col(c)) for c in ("lang", "source", "quality")]).alias("prefix"))


@query("""WITH p AS (SELECT conv_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 OR role = 'user' THEN 1 ELSE 0 END AS o FROM conversations),
g AS (SELECT *, sum(o) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS c FROM p),
f AS (SELECT conv_id, c, role, min(turn) AS pos FROM g GROUP BY ALL)
SELECT conv_id AS doc_id, CAST(c AS BIGINT) AS chunk_idx, string_agg(role, ' ' ORDER BY pos) AS roles FROM f GROUP BY ALL""")
def label_flow(t: Table) -> DataFrame:
    parts = _parts(t)
    found = chunking.label_flow(parts, chunking.label_chunks(parts, F.col("role") == "user"), "role")
    return found.select("doc_id", "chunk_idx", F.array_join("values", " ").alias("roles"))


@query("SELECT conv_id AS doc_id, turn AS chunk_idx, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(t: Table) -> DataFrame:
    return chunking.neighbours(_parts(t).withColumnRenamed("part_idx", "chunk_idx"))


# ------------------------------------------------------------------ filters and dates


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (lang IN ('en', 'de') AND quality IS NOT NULL AND quality <> 0) OR n_chars > 5000")
def metadata_filter(t: Table) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    spec = {"$or": [{"lang": {"$in": ["en", "de"]}, "quality": {"$ne": 0}}, {"n_chars": {"$gt": 5000}}]}
    return rows.where(filters.compile_filter(spec, F.col)).select("doc_id")


@query("""WITH s AS (SELECT user_id, CAST(strftime(min(ts), '%Y%m%d') AS INTEGER) AS f, CAST(strftime(max(ts), '%Y%m%d') AS INTEGER) AS u, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, f AS span_from, u AS span_to, n AS n_events FROM s WHERE f <= 20240115 AND u >= 20240110""")
def time_overlap(t: Table) -> DataFrame:
    spans = t("events").groupBy("user_id").agg(dates.date_int(F.min("ts")).alias("span_from"), dates.date_int(F.max("ts")).alias("span_to"), F.count("*").alias("n_events"))
    return spans.where(filters.time_overlap(F.col("span_from"), F.col("span_to"), 20240110, 20240115))


@query("SELECT event_type, round(sum(value * power(0.5, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') / 30.0)), 4) AS decayed FROM events GROUP BY event_type")
def recency_decay(t: Table) -> DataFrame:
    age = dates.age_days(F.col("ts"), F.lit("2024-02-01"))
    return t("events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * dates.decay(age, 30)), 4).alias("decayed"))


# ------------------------------------------------------------------ scoring


@query("WITH " + _GOLD.strip() + " SELECT DISTINCT qid, doc FROM gold")
def gold_marking(t: Table) -> DataFrame:
    return _gold(t)


@query(r"""WITH p AS (SELECT doc_id AS id, d.text AS text, item_id, b.text AS q FROM documents d JOIN (SELECT item_id, text FROM benchmark WHERE text <> '') b ON contains(d.text, b.text)),
f AS (SELECT id, unnest(list_filter(range(1, length(text) - length(q) + 2), lambda i: substring(text, i, length(q)) = q)) - 1 AS s, length(q) AS n FROM p),
g AS (SELECT id, s, s + n AS e, max(s + n) OVER (PARTITION BY id ORDER BY s, s + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
h AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s, e) AS k FROM g)
SELECT id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM h GROUP BY id, k""")
def evidence_spans(t: Table) -> DataFrame:
    """Where passages of the benchmark stand in documents."""
    return evidence.spans(t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t("documents").select(F.col("doc_id").alias("id"), "text"))


_RUNS = r"""q AS (SELECT item_id, q, length(q) AS n, CAST(ceil(0.9 * length(q) - 1e-9) AS INTEGER) AS k FROM (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS q FROM benchmark) WHERE q <> '')"""


@query("WITH" + _RUNS.replace("q AS", " q AS", 1) + r""", d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id AS quote_id, doc_id AS id, contains(t, q) AS exact FROM q, d WHERE contains(t, q) OR len(list_filter(range(1, n - k + 2), lambda i: contains(t, substring(q, i, k)))) > 0""")
def evidence_runs(t: Table) -> DataFrame:
    """The documents that hold nine tenths of a benchmark passage in one run."""
    return evidence.find_quotes(t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t("documents").select(F.col("doc_id").alias("id"), "text"))


@query(_BM25 + "," + _RUNS + r""", c AS (SELECT qid, trim(regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY rank), '\s+', ' ', 'g')) AS t FROM bm25 JOIN documents ON doc_id = id WHERE rank <= 8 GROUP BY qid),
h AS (SELECT item_id, CASE WHEN contains(t, q) OR length(t) >= n AND len(list_filter(range(1, n - k + 2), lambda i: contains(t, substring(q, i, k)))) > 0 THEN 1.0 ELSE 0.0 END AS hit FROM q LEFT JOIN c ON c.qid = item_id WHERE item_id % 3 <> 0)
SELECT item_id AS qid, CAST(round(hit, 6) AS DOUBLE) AS quote_recall FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN h USING (item_id)""")
def text_quote_recall(t: Table) -> DataFrame:
    """Quote recall on the texts of eight contexts; a third of the passages count as paraphrases."""
    texts = t("documents").select(F.col("doc_id").alias("id"), "text")
    contexts = _bm25(t).where("rank <= 8").join(texts, "id").select("qid", "rank", "text")
    quotes = t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"), F.when(F.col("item_id") % 3 == 0, "paraphrase").otherwise("verbatim").alias("fidelity"))
    return evidence.text_recall(quotes, contexts)


_METRICS = _BM25 + "," + _GOLD + """, g AS (SELECT DISTINCT qid, doc FROM gold), ng AS (SELECT qid, count(*) AS n_gold FROM g GROUP BY qid),
m AS (SELECT b.qid, b.rank, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS good FROM bm25 b LEFT JOIN g ON g.qid = b.qid AND g.doc = b.id),
per AS (SELECT qid, sum(good) FILTER (rank <= 8) AS found, count(*) FILTER (rank <= 8) AS given, max(good / rank) AS mrr, sum(good / log2(rank + 1)) FILTER (rank <= 8) AS dcg FROM m GROUP BY qid),
scores AS (SELECT qid, round(coalesce(found / n_gold, 0), 6) AS recall, round(coalesce(found / given, 0), 6) AS precision, round(coalesce(mrr, 0), 6) AS mrr,
 round(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 8) + 1), lambda i: 1.0 / log2(i + 1))), 0), 6) AS ndcg, coalesce(found, 0) > 0 AS hit FROM ng LEFT JOIN per USING (qid))"""


def _metrics(t: Table) -> DataFrame:
    ranking = _bm25(t).select("qid", F.col("id").alias("doc"), F.col("rank").alias("place"))
    return metrics.retrieval_metrics(ranking, _gold(t), 8)


@query(_METRICS + " SELECT * FROM scores")
def retrieval_metrics(t: Table) -> DataFrame:
    return _metrics(t)


@query(_METRICS + " SELECT qid, round((0.4 * recall + 0.2 * ndcg) / 0.6, 6) AS headline FROM scores")
def headline(t: Table) -> DataFrame:
    none = F.lit(None).cast("double")
    return _metrics(t).select("qid", F.round(metrics.headline(F.col("recall"), none, F.col("ndcg"), none), 6).alias("headline"))


@query(_METRICS + """, d AS (SELECT hit, (recall + precision + mrr + ndcg) / 4 AS s FROM scores)
SELECT hit, count(*) AS n, round(avg(s), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(s) / sqrt(count(*)) END, 6) AS stderr FROM d GROUP BY hit""")
def decision_spread(t: Table) -> DataFrame:
    return metrics.spread(_metrics(t), "hit", metrics.decision(*[F.col(c) for c in ("recall", "precision", "mrr", "ndcg")]))


_RUNS = "runs AS (SELECT c_mktsegment AS dataset, c_nationkey AS run, round(avg(c_acctbal), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(c_acctbal) / sqrt(count(*)) END, 6) AS stderr FROM customer GROUP BY ALL)"


def _runs(t: Table) -> DataFrame:
    """Customers' balances stand in for scores: segments for datasets, nations for runs."""
    c = F.col("c_acctbal").cast("double")
    return t("customer").groupBy(F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey").alias("run")).agg(
        F.round(F.avg(c), 6).alias("mean"), F.round(F.when(F.count("*") > 1, F.stddev_samp(c) / F.sqrt(F.count("*"))), 6).alias("stderr")
    )


@query("WITH " + _RUNS + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean DESC NULLS LAST, run) AS k FROM runs),
two AS (SELECT dataset, max(run) FILTER (k = 1) AS leader, max(mean) FILTER (k = 1) AS m1, max(mean) FILTER (k = 2) AS m2, max(stderr) FILTER (k = 1) AS e1, max(stderr) FILTER (k = 2) AS e2 FROM r WHERE k <= 2 GROUP BY dataset)
SELECT dataset, leader, round(m1 - m2, 6) AS lead, CASE WHEN m2 IS NULL THEN 'unranked' WHEN sqrt(e1 * e1 + e2 * e2) IS NULL THEN 'unknown' WHEN m1 - m2 > sqrt(e1 * e1 + e2 * e2) THEN 'winner' ELSE 'tie' END AS verdict FROM two""")
def verdict(t: Table) -> DataFrame:
    return metrics.verdict(_runs(t), "dataset", "run")


@query(f"SELECT b.item_id, round(max(CASE WHEN n > 0 THEN k / n ELSE 0 END), 6) AS overlap FROM (SELECT item_id, len(list_distinct({_TOKENS.format('b.text')})) AS n, len(list_intersect(list_distinct({_TOKENS.format('b.text')}), list_distinct({_TOKENS.format('l.text')}))) AS k FROM benchmark b, conversations l) b GROUP BY b.item_id")
def token_overlap(t: Table) -> DataFrame:
    """Each question's largest token overlap with any turn."""
    return metrics.largest_overlap(t("benchmark"), t("conversations"))


@query(f"""WITH p AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS a, lead({_TOKENS.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
f AS (SELECT conv_id, turn, len(a) + len(b) AS n, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS k FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN k > 0 THEN 2.0 * k / n ELSE 0.0 END, 6) AS f1 FROM f""")
def token_f1(t: Table) -> DataFrame:
    """Token F1 of every turn with the one after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("a")).withColumn("b", F.lead("a").over(w)).where("b is not null")
    return rows.select("conv_id", "turn", F.round(text.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query()
def fuzzy_quote(t: Table) -> DataFrame:
    """Every turn with the one after it, as quote and text; tested against difflib."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").select("conv_id", "turn", F.col("text").alias("quote"), F.lead("text").over(w).alias("text"), F.lead("turn").over(w).alias("next"))
    return metrics.fuzzy_quotes(rows.where("next is not null").drop("next"))


@query(_BM25 + "," + _GOLD + """, g AS (SELECT DISTINCT qid, doc FROM gold), h AS (SELECT DISTINCT g.qid, g.doc FROM g JOIN bm25 ON bm25.qid = g.qid AND bm25.id = g.doc WHERE rank <= 8)
SELECT g.qid, round(avg(CASE WHEN h.doc IS NULL THEN 0.0 ELSE 1.0 END), 6) AS quote_recall FROM g LEFT JOIN h ON h.qid = g.qid AND h.doc = g.doc GROUP BY g.qid""")
def quote_recall(t: Table) -> DataFrame:
    quotes = _gold(t).select("qid", F.col("doc").alias("quote_id"))
    return metrics.quote_recall(quotes, _bm25(t).where("rank <= 8").select("qid", F.col("id").alias("quote_id")))


@query(_COVERAGE + """, a AS (SELECT qid, coverage >= 0.5 AS good, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k, sum(CAST(coverage >= 0.5 AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM coverage JOIN bm25 USING (qid, id))
SELECT qid, round(coalesce(sum(c / k) FILTER (good) / nullif(count(*) FILTER (good), 0), 0.0), 6) AS context_precision FROM a GROUP BY qid""")
def context_precision(t: Table) -> DataFrame:
    ix = _asked_index(t)
    found = retrieve.bm25(ix, _questions(t), 40)
    grades = found.join(retrieve.idf_coverage(ix, _questions(t), found), ["qid", "id"]).select("qid", "rank", F.col("coverage").alias("similarity"))
    return metrics.average_precision(grades)


# ------------------------------------------------------------------ boards, samples, stores


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM s WHERE k IN (SELECT i * (SELECT count(*) FROM documents) // 100 FROM range(100) r(i))""")
def stride_sample(t: Table) -> DataFrame:
    docs = t("documents").select("doc_id")
    return board.stride_sample(docs, ["doc_id"], 100, docs.count())


@query("""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL),
q AS (SELECT lang, count(*) AS quota FROM (SELECT lang FROM s ORDER BY k, lang LIMIT 80) GROUP BY lang)
SELECT doc_id, s.lang FROM s JOIN q ON q.lang = s.lang WHERE k IN (SELECT i * s.n // quota FROM range(80) r(i) WHERE i < quota)""")
def balanced_sample(t: Table) -> DataFrame:
    docs = t("documents").where("lang is not null").select("doc_id", "lang")
    return board.balanced_sample(docs, "lang", ["doc_id"], 80)


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def dangling_refs(t: Table) -> DataFrame:
    return board.dangling(t("labels").select("doc_id", "quality"), "doc_id", t("documents").where("n_chars > 500"), "doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_wins(t: Table) -> DataFrame:
    found = board.latest(t("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return found.select("user_id", "event_type", "event_id", "value")


_BOARD = """WITH r AS (SELECT c_custkey AS id, c_nationkey AS dataset, c_acctbal AS decision FROM customer),
l AS (SELECT o_custkey AS id, CAST(NULL AS INTEGER) AS dataset, max(o_totalprice) AS decision FROM orders GROUP BY o_custkey)"""


def _board(t: Table) -> DataFrame:
    runs = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dataset"), F.col("c_acctbal").alias("decision"))
    ledger = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("decision")).withColumn("dataset", F.lit(None).cast(dict(runs.dtypes)["dataset"]))
    return board.merge_board(runs, ledger, "id", ["dataset", "decision"])


@query(_BOARD + """ SELECT coalesce(r.id, l.id) AS id, coalesce(r.dataset, l.dataset) AS dataset, coalesce(r.decision, l.decision) AS decision,
 CASE WHEN r.id IS NOT NULL AND l.id IS NOT NULL THEN 'both' WHEN r.id IS NOT NULL THEN 'run' ELSE 'ledger' END AS source FROM r FULL JOIN l ON r.id = l.id""")
def board_full_outer(t: Table) -> DataFrame:
    return _board(t)


@query("SELECT o_orderpriority AS dataset, count(*) AS n_runs, max(o_orderdate) AS newest, max(o_totalprice) AS best FROM orders GROUP BY 1")
def board_by_dataset(t: Table) -> DataFrame:
    rows = t("orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("decision"))
    return board.by_dataset(rows)


@query("""WITH p AS (SELECT user_id AS run, md5(array_to_string(list_sort(list(DISTINCT event_type)), ',')) AS questions FROM events GROUP BY user_id)
SELECT questions, count(*) AS n_runs, string_agg(CAST(run AS VARCHAR), ' ' ORDER BY run) AS runs FROM p GROUP BY questions""")
def comparability_groups(t: Table) -> DataFrame:
    found = board.comparability(t("events").withColumnRenamed("user_id", "run"), "run", "event_type", [])
    return found.select("questions", "n_runs", F.array_join("runs", " ").alias("runs"))


@query("SELECT lang, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS quality, round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def difficulty_rates(t: Table) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return board.rates(rows, "lang", {"quality": F.col("quality"), "toxic": F.col("toxic")})


@query("""WITH j AS (SELECT source AS judge, quality = 1 AS supported, CASE WHEN n_chars < 100 THEN NULL ELSE n_chars > 400 END AS verdict FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, coalesce(CAST(supported = verdict AS DOUBLE), 0.0) AS ok FROM j)
SELECT judge, round(avg(ok), 6) AS accuracy, round(avg(ok) FILTER (supported), 6) AS recall_true, round(avg(ok) FILTER (NOT supported), 6) AS recall_false,
 CAST(count(*) FILTER (verdict IS NULL) AS BIGINT) AS failures, count(DISTINCT verdict) < 2 AS degenerate FROM r GROUP BY judge""")
def judge_screen_score(t: Table) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id")
    judged = rows.select(F.col("source").alias("judge"), (F.col("quality") == 1).alias("supported"), F.when(F.col("n_chars") >= 100, F.col("n_chars") > 400).alias("verdict"))
    return board.screen_score(judged)


@query("""WITH s AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS s, CAST(floor(value) AS BIGINT) + 3 AS e FROM events),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, k""")
def span_merge(t: Table) -> DataFrame:
    start = F.floor("value").cast("long")
    return board.merge_spans(t("events").select("user_id", start.alias("start"), (start + 3).alias("end")), ["user_id"])


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 600")
def history_budget(t: Table) -> DataFrame:
    return board.history_budget(t("conversations"), 600).select("conv_id", "turn", "used")


@query("""SELECT p_partkey, CAST((CASE WHEN contains(lower(p_name), 'a') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_name), 'steel') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'a') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END) AS INTEGER) AS score
FROM part WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 8""")
def catalogue_search(t: Table) -> DataFrame:
    return board.search_pages(t("part"), ["a", "steel"], {"p_name": 3, "p_type": 1}, "p_partkey")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY user_id")
def context_counts(t: Table) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"), F.sum(F.length("props")).alias("chars"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_documents, CAST(count(*) FILTER (text IS NULL OR trim(text) = '') AS BIGINT) AS blank, CAST(count(*) FILTER (contains(text, chr(10) || chr(10))) AS BIGINT) AS blank_lines, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents")
def dataset_readings(t: Table) -> DataFrame:
    docs = t("documents")
    lost = docs.join(t("labels").select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("unlabelled"))
    told = docs.agg(
        F.count("*").alias("n_documents"),
        F.sum((F.col("text").isNull() | (F.trim("text") == "")).cast("long")).alias("blank"),
        F.sum(F.coalesce(F.contains("text", F.lit("\n\n")), F.lit(False)).cast("long")).alias("blank_lines"),
    )
    return told.crossJoin(lost)  # one row each


@query("""WITH i AS (SELECT quality = 1 AS supported, least(n_chars, 1000) / 1000.0 AS overlap FROM documents JOIN labels USING (doc_id)),
m AS (SELECT round(avg(overlap) FILTER (supported), 3) AS supported, round(avg(overlap) FILTER (NOT supported), 3) AS unsupported FROM i)
SELECT supported, unsupported, round(supported - unsupported, 3) AS difference, coalesce(abs(round(supported - unsupported, 3)) <= 0.03, false) AS blind FROM m""")
def lexical_leak(t: Table) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id")
    return board.lexical_signal(rows.select((F.col("quality") == 1).alias("supported"), (F.least("n_chars", F.lit(1000)) / 1000).alias("overlap")))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents)")
def labelled_questions(t: Table) -> DataFrame:
    docs = t("documents").select("doc_id", "lang", "source")
    ends = docs.agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    return board.with_labels(docs, {"lang": ["en", "de"], "source": [ends["a"], ends["b"]]})


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def selection_note(t: Table) -> DataFrame:
    return board.selection_counts(t("documents"), "lang")


_RUN = "SELECT doc_id, quality / 2.0 AS recall, toxic = 1 AS abstained FROM labels"


def _run_rows(t: Table) -> DataFrame:
    return t("labels").select("doc_id", (F.col("quality") / 2).alias("recall"), (F.col("toxic") == 1).alias("abstained"))


@query(f"SELECT r.doc_id, CAST(recall AS DOUBLE) AS recall, abstained, lang, text FROM ({_RUN}) r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE recall IS NULL OR recall < 1")
def failure_rows(t: Table) -> DataFrame:
    return board.failures(_run_rows(t), t("documents").select("doc_id", "lang", "text"), "doc_id")


@query(f"SELECT r.doc_id, CAST(recall AS DOUBLE) AS recall, abstained, lang FROM ({_RUN}) r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE abstained")
def abstained_rows(t: Table) -> DataFrame:
    return board.failures(_run_rows(t), t("documents").select("doc_id", "lang"), "doc_id", "abstained")


@query("SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN round(((toxic = 1)::INTEGER + 1 + (quality = 1)::INTEGER) / 4.0, 6) END AS coverage FROM labels JOIN documents USING (doc_id)")
def derived_fact_coverage(t: Table) -> DataFrame:
    """Replies of a judge over four facts: two that the labels decide, one affirmed after a denial, one without a line."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    reply = F.concat(F.lit("1: "), yes(F.col("toxic") == 1), F.lit("\n2 - no\nnot a verdict\n 2. TRUE\r\n3: "), yes(F.col("quality") == 1))
    rows = t("labels").join(t("documents"), "doc_id")
    return rows.select("doc_id", F.round(text.fact_coverage(reply, F.lit(4), F.col("text")), 6).alias("coverage"))


@query(r"""SELECT conv_id, turn, role, contains(coalesce(s[1], ''), 'the') AS refusal
FROM (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?…])\s+', '\1
', 'g'), '\n'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)""")
def refusal_detection(t: Table) -> DataFrame:
    """Turns whose first sentence holds a marker, here a frequent word."""
    return t("conversations").select("conv_id", "turn", "role", text.reads_as_refusal(F.col("text"), tuple(retrieve.REFUSALS.values()), ("the",)).alias("refusal"))


@query(f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens, to_json({{'lang': coalesce(lang, ''), 'n': n_chars}})::VARCHAR AS span, n_chars FROM documents")
def flattened_labels(t: Table) -> DataFrame:
    docs = t("documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"), F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_chars").alias("n")).alias("span"), "n_chars")
    return docs.select("doc_id", *[text.flattened(F.col(c), docs.schema[c].dataType).alias(c) for c in ("tokens", "span", "n_chars")])


@query("""WITH s AS (SELECT coalesce(lang, '?') AS lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS id, 'leaf' AS layer, 0 AS level, n_chars AS n FROM documents
UNION ALL SELECT 'g-' || lang, 'summary', 2, CAST(sum(n) AS BIGINT) FROM s GROUP BY lang""")
def leaves_and_summaries(t: Table) -> DataFrame:
    """Leaves and two levels of summaries in one index, in the scope that takes leaves and the second level."""
    docs = t("documents")
    lang = F.coalesce("lang", F.lit("?"))
    low = docs.groupBy(lang.alias("lang"), "source").agg(F.count("*").alias("n"))
    first = low.select(F.concat(F.lit("s-"), "lang", F.lit("-"), F.coalesce("source", F.lit("?"))).alias("id"), F.lit(1).alias("level"), "n")
    second = low.groupBy("lang").agg(F.sum("n").alias("n")).select(F.concat(F.lit("g-"), "lang").alias("id"), F.lit(2).alias("level"), "n")
    whole = board.pool(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("n")), first.unionByName(second))
    return whole.where(filters.layer_scope(F.col("layer"), F.col("level"), "mixed", (2,)))
