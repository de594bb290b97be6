"""Scopes of questions inside retrieval, and the store of vectors."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import experiments, index, retrieve, scopes
from sheafline.plans.config import RetrievalConfig
from sheafline.sources.vector_store import Conflict, VectorStore


def test_spans_that_overlap(spark):
    rng = random.Random(5)
    day = lambda n: int((dt.date(2023, 12, 1) + dt.timedelta(days=n)).strftime("%Y%m%d"))
    spans = [(i, *sorted([rng.randrange(500), rng.randrange(500)])) for i in range(60)]
    rows = [(i, day(a), day(a + (b - a) % 90)) for i, a, b in spans] + [(90, 0, 0), (91, None, day(3)), (92, day(9), day(3)), (93, 20240230, 20240301), (94, day(0), day(499))]
    left = spark.createDataFrame(rows[:30] + rows[60:], "left_id int, span_from int, span_to int")
    right = spark.createDataFrame(rows[30:], "right_id int, span_from int, span_to int")
    good = [r for r in rows if r[1] and r[2] and r[1] <= r[2] and r[1] != 20240230]
    want = {(a[0], b[0]) for a in good if a in rows[:30] + rows[60:] for b in good if b in rows[30:] if a[1] <= b[2] and b[1] <= a[2]}
    got = [tuple(r) for r in scopes.overlapping(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_questions_speak_of_times(spark):
    asked = spark.createDataFrame([(1, "what happened yesterday", dt.date(2024, 5, 2)), (2, "sales in 2023", dt.date(2024, 5, 2)), (3, "no time", dt.date(2024, 5, 2)), (4, "yesterday", None), (5, None, dt.date(2024, 1, 1))], "qid int, question string, asked_at date")
    assert sorted(tuple(r) for r in scopes.question_scopes(asked).collect()) == [(1, 20240501, 20240501, "yesterday"), (2, 20230101, 20231231, "year")]
    assert {r.qid for r in scopes.question_scopes(asked.drop("asked_at"), dt.date(2020, 1, 2)).collect()} == {1, 2, 4}


@pytest.fixture(scope="module")
def corpus(spark):
    leaves = [(f"d{i}", ["apple pie recipe", "apple tree garden", "whale song ocean", "whale watching apple"][i % 4] + f" extra{i}", 20240100 + i, 20240100 + i, "en" if i % 2 else "de", "leaf", 0) for i in range(1, 13)]
    rows = leaves + [("s1", "apple things", 20240101, 20240112, None, "summary", 1), ("s2", "whale apple ocean", 0, 0, None, "summary", 2)]
    facts = spark.createDataFrame(rows, "id string, text string, span_from int, span_to int, lang string, layer string, level int").cache()
    chunks = facts.select("id", "text")
    members = spark.createDataFrame([("s1", f"d{i}") for i in (1, 4, 5, 8)] + [("s2", "s1"), ("s2", "d2")], "summary string, id string")
    return experiments.Corpus(chunks, index.build(chunks, "id", "text"), facts=facts, members=members)


def found(corpus, asked, config, **more):
    out = {}
    for r in experiments.retrieve_all(corpus, asked, config, **more).orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("retriever", ["bm25", "dense", "hybrid-rrf"])
def test_scopes_inside_retrieval(spark, corpus, retriever):
    asked = spark.createDataFrame([(1, "apple recipe"), (2, "whale ocean in january")], "qid int, question string")
    plain = RetrievalConfig(k=20, candidates=40, rerank_depth=40, retriever=retriever, reranker="none", max_context_chars=10**6)
    everything = found(corpus, asked, plain)
    assert "s1" in everything[1] and "d12" in everything[1]
    assert set(found(corpus, asked, plain, where={"lang": "en"})[1]) == {i for i in everything[1] if i[0] == "d" and int(i[1:]) % 2}
    # statistics stay those of the whole index: the order of what is left is the order of before
    few = found(corpus, asked, plain, where={"span_from": {"$lte": 20240106, "$gt": 0}})
    assert few[1] == [i for i in everything[1] if i == "s1" or i[0] == "d" and int(i[1:]) <= 6] or retriever == "hybrid-rrf"
    from dataclasses import replace

    timed = found(corpus, asked, replace(plain, time_filter=True), asked_on=dt.date(2024, 1, 5))
    assert timed[1] == everything[1] and "s2" not in timed[2]
    assert set(found(corpus, asked, replace(plain, summary_scope="leaves"))[1]) == {i for i in everything[1] if i[0] == "d"}
    assert set(found(corpus, asked, replace(plain, summary_scope="summaries", summary_levels=(1,)))[1]) == {"s1"}
    assert "s2" not in found(corpus, asked, replace(plain, summary_levels=(1,)))[2]
    assert found(corpus, asked, replace(plain, summary_boost=50.0))[1][0] in ("s1", "s2")
    deep = found(corpus, asked, replace(plain, summary_scope="drill-down", k=2))
    assert deep[1][0] in ("s1", "s2") and {"d1", "d5"} & set(deep[1]) == {"d1", "d5"} - ({"d1", "d5"} - set(deep[1])) and len(deep[1]) == len(set(deep[1])) > 2


def test_dense_scan_is_the_join_by_slots(spark, monkeypatch):
    rng = random.Random(8)
    words = "a1 b2 c3 d4 e5 f6 g7".split()
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(80)] + [(100, None)], "id int, text string").repartition(5)
    asked = spark.createDataFrame([(1, "a1 b2"), (2, "g7"), (3, ""), (4, "a1 a1 c3")], "qid int, text string")
    got = sorted(tuple(r) for r in retrieve.dense_scan(docs, asked, 6).collect())
    monkeypatch.setattr(retrieve, "SCAN_QUESTIONS", 0)
    assert got == sorted(tuple(r) for r in retrieve.dense_scan(docs, asked, 6).collect()) and {r[0] for r in got} == {1, 2, 4}


def test_index_of_wanted_terms(spark, corpus):
    asked = spark.createDataFrame([(1, "apple recipe"), (2, "what is the whale ocean")], "qid int, question string")
    part = index.build(corpus.chunks, "id", "text", retrieve.wanted_terms(asked))
    for variants in (False, True):
        whole = retrieve.bm25(corpus.index, asked, 9, variants)
        assert sorted(map(tuple, retrieve.bm25(part, asked, 9, variants).collect())) == sorted(map(tuple, whole.collect()))


def test_vector_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    vec = {i: rng.standard_normal(4).round(1).tolist() for i in range(30)}
    rows = lambda ids, text="t": spark.createDataFrame([(f"r{i:02d}", text, vec[i], {"kind": "odd" if i % 2 else "even"}, {"n": float(i)}, 1) for i in ids], "id string, text string, vec array<double>, labels map<string,string>, numbers map<string,double>, no int")
    store = VectorStore(spark, f"{tmp_path}/store")
    assert store.count() == 0 and store.nearest(spark.createDataFrame([(1, vec[0])], "qid long, vec array<double>")).count() == 0
    store.upsert(rows(range(20)))
    other = VectorStore(spark, f"{tmp_path}/store")
    store.delete(spark.createDataFrame([("r03",), ("none",), (None,)], "id string"))
    with pytest.raises(Conflict):
        other.upsert(rows([25]))
    assert other.count() == 20 and other.refresh().count() == 19
    vec[5] = [1.0, 2.0, 3.0, 4.0]
    store.upsert(rows([5, 21, 22], "new").unionByName(rows([22], "a")))  # of two rows of one id the larger text
    held = {r.id: r for r in store.rows().collect()}
    assert set(held) == {f"r{i:02d}" for i in [*range(20), 21, 22] if i != 3} and held["r05"].text == held["r22"].text == "new"
    assert [i for i, _ in sorted(held.items(), key=lambda x: x[1].no)] == sorted(held)
    queries = spark.createDataFrame([(k, vec[k + 7]) for k in range(5)] + [(9, [0.0] * 4)], "qid long, vec array<double>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    for where, keep in ((None, lambda i: True), ({"kind": "odd", "n": {"$lt": 15}}, lambda i: i % 2 and i < 15), ({"$or": [{"kind": {"$ne": "odd"}}, {"n": {"$in": [7, 9.0]}}]}, lambda i: not i % 2 or i in (7, 9)), ({"missing": {"$ne": "x"}}, lambda i: False)):
        own = sorted(int(i[1:]) for i in held if keep(int(i[1:])))
        got = {}
        for r in store.nearest(queries, 4, where).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
        for q in queries.collect():
            scores = [(round(float(unit(q.vec) @ unit(vec[i])), 6) + 0.0, i) for i in own]
            assert got.get(q.qid, []) == [(f"r{i:02d}", pytest.approx(s)) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:4]]
    asked = spark.createDataFrame([(0, "r22"), (1, "none"), (2, "r03"), (3, "r00"), (4, "r22")], "place int, id string")
    assert [(r.place, r.id) for r in store.get(asked).orderBy("place").collect()] == [(0, "r22"), (3, "r00"), (4, "r22")]
    store.compact()
    assert not store.changes and {r.id: r for r in store.rows().collect()} == held
    store.drop()
    assert store.count() == 0 and VectorStore(spark, f"{tmp_path}/store").version == store.version
