"""One small test for each finding that changed the code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline import catalog
from sheafline.functions import embedders, text
from sheafline.operators import chunking, dense, evidence, hierarchy, index, retrieve


def test_sentences_keep_digits_of_their_place(spark):
    row = spark.createDataFrame([("a. 1b\n2c2\n  d  ",)], "t string").select(text.sentences(F.col("t")).alias("s")).first()
    assert row.s == ["a.", "1b", "2c2", "d"]


def test_separator_chunks_keep_digits_of_their_place(spark):
    docs = spark.createDataFrame([(1, "0a0. 11 b1\n  2c 2 ")], "doc_id long, text string")
    assert [r.text for r in chunking.separator_chunks(docs, [". ", "\n"]).orderBy("chunk_idx").collect()] == ["0a0", "11 b1", "2c 2"]


def test_density_of_more_nodes_than_an_int_squares(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    row = hierarchy.density(edges, 50_000).first()
    assert (row.n_edges, row.density) == (2, 0.0)
    assert hierarchy.density(edges, 3).first().density == round(2 * 2 / 6, 6)


def _small_index(spark, ids):
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, ["red fox and red hen", "blue fox", None, "the hen sleeps", "red red red"], strict=True)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "which red fox"), (2, "sleeping hens and a hen"), (3, "zzz")], "qid long, question string")
    return index.build(docs, "doc_id", "text", retrieve.wanted_terms(asked)), asked


@pytest.mark.parametrize("variants", [False, True])
def test_bm25_scans_texts_without_shuffling_postings(spark, variants):
    held, asked = _small_index(spark, range(5))
    scan = retrieve._scan(held, retrieve.query_terms(asked, variants), 2)
    assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()
    rows = lambda ix: {tuple(r) for r in retrieve.bm25(ix, asked, 2, variants).collect()}
    joined = index.Index(held.postings, held.terms, held.stats)
    assert rows(held) == rows(joined) != set()


def test_rows_of_one_id_are_counted_together(spark):
    held, asked = _small_index(spark, [0, 1, 2, 3, 0])
    assert held.held is None
    assert {(r.id, r.dl, r.token): r.tf for r in held.postings.collect()}[0, 3, "red"] == 3
    assert retrieve.bm25(held, asked, 2).where("qid = 1").count() == 2


def test_postings_are_counted_where_texts_are_read(spark):
    docs = spark.createDataFrame([(1, "a1 b2 a1"), (2, None)], "doc_id long, text string")
    made = index.build(docs, "doc_id", "text").postings
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.select("id", "token", "tf", "dl").collect()} == {(1, "a1", 2, 3), (1, "b2", 1, 3)}


def test_char_hash_counts_sequences_where_texts_are_read(spark):
    texts = ["Abab  ABAB ñandú", "ab", "", None, "".join(chr(0x4E00 + i) for i in range(5000)), "ab"]
    docs = spark.createDataFrame(list(zip([1, 2, 3, 4, 5, 2], texts, strict=True)), "doc_id long, text string")
    made = embedders.char_hash(docs, "doc_id", "text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "piece" not in plan  # rows by slot, not sequences
    want = {}
    for i, t in zip(docs.toPandas().doc_id, texts, strict=True):
        t = " ".join((t or "").split()).lower()
        for g in [t[k : k + 4] for k in range(len(t) - 3)] or [t] * bool(t):
            key = (int(i), embedders.bucket(g, embedders.CHAR_SLOTS))
            want[key] = want.get(key, 0) + 1
    norm = {i: sum(v * v for (j, _), v in want.items() if j == i) ** 0.5 for i, _ in want}
    got = {(r.doc_id, r.slot): r.weight for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v / norm[k[0]]) < 1e-12 for k, v in want.items())


def test_gold_pairs_shuffle_no_text(spark):
    docs = spark.createDataFrame([(1, "a quick brown fox jumps  over"), (2, "brown fox jumps"), (3, "fox"), (4, "brown cat jumps"), (5, None)], "doc long, text string")
    quotes = spark.createDataFrame([(7, "quick brown\nfox jumps"), (8, "no such fox here")], "qid long, quote string")
    found = evidence.gold_pairs(docs, quotes)
    assert {tuple(r) for r in found.collect()} == {(7, 1), (7, 2), (7, 3), (8, 3)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_a_block_against_sorting_all():
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (5000, 4)).astype(float)  # many ties
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    ids = np.arange(5000)
    row, at, score = dense._nearest(v[:300], ids[:300], v, ids, 5, 6)
    want = np.round(v[:300] @ v.T, 6)
    want[ids[:300], ids[:300]] = -np.inf
    best = np.argsort(-want, axis=1, kind="stable")[:, :5]
    assert (at.reshape(300, 5) == best).all() and (score.reshape(300, 5) == np.take_along_axis(want, best, 1)).all()
    assert dense._blocks(600_000) <= 74  # the bytes sent grow with their square


def test_edges_shuffle_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rare = sorted({(int(i), f"t{rng.integers(9)}") for i in rng.integers(0, 40, 160)}) + [(3, "t1"), (39, "twin"), (-5, "twin")]
    df = spark.createDataFrame([(i, t, 0.5 + int(t[1:]) / 8 if t != "twin" else 7.000001) for i, t in rare], "id int, token string, idf double")
    want = {}
    for a, t in rare:
        for b, u in rare:
            if t == u and a < b:
                want[a, b] = want.get((a, b), 0.0) + (0.5 + int(t[1:]) / 8 if t != "twin" else 7.000001)
    stats = spark.createDataFrame([(500,)], "n long")
    made = hierarchy.lexical_edges(df, stats)
    assert {(r.a, r.b): r.weight for r in made.collect()} == {k: round(v, 6) for k, v in want.items()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "keys=[a" not in plan and "hashpartitioning(a" not in plan
    monkeypatch.setattr(hierarchy, "PAIRS", 3)
    import pyarrow as pa

    chunks, lists = pa.table({"id": [1, 2, 1], "token": ["x", "x", "y"], "micro": [5, 5, 2]}), pa.table({"word": ["y", "x"], "ids": [[1, 4], [1, 2, 3, 4]]})
    parts = list(hierarchy._pairs(chunks, lists))
    assert len(parts) == 2 and pa.Table.from_batches(parts).to_pylist() == [{"a": a, "b": b, "micro": m} for a, b, m in [(1, 2, 5), (1, 3, 5), (1, 4, 7), (2, 3, 5), (2, 4, 5)]]


def test_frequent_terms_are_passed_over_before_the_join(spark, monkeypatch):
    texts = [(i, " ".join(["common", "usual"] + [f"w{i * j % 17}" for j in range(i % 5)])) for i in range(40)]
    ix = index.build(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    want = {tuple(r) for r in hierarchy.rare_terms(ix, 2).collect()}
    monkeypatch.setattr(hierarchy, "KNOWN_TERMS", 3)
    assert {tuple(r) for r in hierarchy.rare_terms(ix, 2).collect()} == want and len(want) == 80


@pytest.mark.parametrize("step, step_texts", [(1 << 20, 1 << 10), (7, 2)])
def test_char_hash_counts_portions_of_texts_and_shuffles_no_rows(spark, monkeypatch, step, step_texts):
    texts = ["Abab  ABAB ñandú und \U0001f600\U0001f600", "ab", "", None, "".join(chr(0x4E00 + i) for i in range(300)), "abcd", "x"]
    monkeypatch.setattr(embedders, "STEP", step)
    monkeypatch.setattr(embedders, "STEP_TEXTS", step_texts)
    columns = []
    monkeypatch.setattr(embedders, "_weighted", lambda docs, size, count, *a, f=embedders._weighted: columns.append((size, count)) or f(docs, size, count, *a))
    made = embedders.char_hash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    plain = [" ".join((t or "").split()).lower() for t in texts]
    want = np.zeros((len(texts), embedders.CHAR_SLOTS))
    for i, t in enumerate(plain):
        for g in [t[k : k + 4] for k in range(len(t) - 3)] or [t] * bool(t):
            want[i, embedders.bucket(g, embedders.CHAR_SLOTS)] += 1
    import pyarrow as pa

    (size, count), column = columns[0], pa.array(plain)
    parts = list(embedders._portions(size(column).to_numpy()))
    assert [p[0] for p in parts] + [len(texts)] == [0] + [p[1] for p in parts] and len(parts) == (1 if step > 7 else 5)
    assert (np.concatenate([count({}, column.slice(a, b - a)) for a, b in parts]) == want).all()
    norm = np.sqrt((want**2).sum(axis=1))
    assert {(r.doc_id, r.slot): r.weight for r in made.collect()} == {(int(i), int(k)): want[i, k] / norm[i] for i, k in zip(*np.nonzero(want), strict=True)}


def _drilled(docs, asked):
    """drill_down by loops: the sources of the best documents by BM25, the best covered of all documents of each."""
    words = lambda t: [w for w in (t or "").lower().split() if len(w) > 1]
    texts, source = {}, {}
    for i, t, s in docs:
        texts.setdefault(i, []).extend(words(t))
        source.setdefault(i, set()).update([s] if s else [])
    n, avg = len(docs), sum(max(1, len(words(t))) for _, t, _ in docs) / len(docs)
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    idf = {w: np.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = set()
    for q, question in asked:
        terms, best = set(words(question)), {}
        sizes = {i: [len(words(t)) for j, t, _ in docs if j == i][0] for i in texts}
        for i, t in texts.items():
            score = round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * max(1, sizes[i]) / avg)) for w in terms if w in t), 6)
            for s in source[i] if score > 0 else ():
                best[s] = min(best.get(s, (0, 0)), (-score, i))
        terms -= set(text.INTERROGATIVES)
        total = sum(idf.get(w, 1.0) for w in terms)
        for place, s in enumerate(sorted(best, key=lambda s: best[s])[:2], 1):
            out.add((q, place, None, s, 0))
            grade = {str(i): round(sum(idf[w] for w in terms if w in t) / total, 6) if terms else 0.0 for i, t in texts.items() if s in source[i]}
            out |= {(q, place, s, i, k) for k, i in enumerate(sorted(grade, key=lambda i: (-grade[i], i))[:3], 1)}
    return out


@pytest.mark.parametrize("several", [False, True])
def test_drill_down_takes_all_documents_of_a_source(spark, tmp_path, several):
    docs = [(i, "red fox", "a") for i in range(60)]  # more than any number of candidates
    docs += [(100, "red fox sleeps " + "far away " * 40, "a"), (101, "red " + "hill " * 30, "b"), (102, "fox sleeps " + "hill " * 90, "b"), (103, "nothing", "b")]
    docs += [(104, "sleeps red fox", None), (105, None, "c"), (106, "hen", "c"), (107, "hen hen which", "d")]
    docs += [(107, "hen hen which", "d")] * several  # an id of several rows is joined
    asked = [(1, "red fox sleeps"), (2, "hen"), (3, "which"), (4, "zzz"), (5, "red zzz hill")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = catalog.QUERIES["drill_down"](spark, str(tmp_path))
    assert made.columns == ["qid", "at", "expanded_from", "id", "place"]
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _drilled(docs, asked)
    assert (1, 2, None, "b", 0) in rows and (1, 1, "a", "100", 1) in rows  # beyond the 40 best documents


def test_members_and_owners_by_scans_as_by_joins(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 9))), f"s{rng.integers(9)}") for i in range(400)], "id long, text string, source string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 4))) for q in range(20)], "qid long, question string")
    scanned = index.build(docs, "id", "text", retrieve.wanted_terms(asked), "source")
    joined = index.Index(scanned.postings, scanned.terms, scanned.stats, None, scanned.owners)
    found = []
    for ix in (scanned, joined):
        kept = retrieve.best_owners(ix, asked, 3)
        found.append({tuple(r) for r in retrieve.drill_down(kept, retrieve.covered_members(ix, asked, kept, 4), 4).collect()})
    assert found[0] == found[1] and len(found[0]) == 20 * 3 * 5
    plan = retrieve._scan(scanned, retrieve.query_terms(asked), 3, by_owner=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
