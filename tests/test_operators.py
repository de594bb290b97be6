"""Operators that SQL does not express, against plain loops; and small cases of the others."""

import collections
import datetime as dt
import difflib
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafline import catalog
from sheafline.functions import dates, embedders, text
from sheafline.operators import board, chunking, filters, hierarchy, index, metrics, retrieve
from sheafline.plans import split_plan
from sheafline.plans.config import IndexConfig, RetrievalConfig, fingerprint


@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 30))
def test_packing_keeps_all_words(t, size):
    out = chunking.pack_words(t, size)
    assert " ".join(out).split() == t.split()
    assert all(len(x) <= size or " " not in x for x in out)


@given(st.text(alphabet="abc ", max_size=200), st.integers(1, 30), st.integers(0, 40))
def test_windows_cover_all_words(t, size, overlap):
    out = chunking.windows(t, size, overlap)
    words = t.split()
    at = 0
    for x in out:
        part = x.split()
        while words[at : at + len(part)] != part:
            at += 1
            assert at <= len(words)
        assert len(x) <= size or len(part) == 1
    if words:
        assert out[-1].split() == words[len(words) - len(out[-1].split()) :]


def test_plans_round_trip():
    told = 'document / drift or "x / y" / part over-budget / role=user and "a"'
    plan = split_plan.parse(told)
    assert split_plan.canonical(plan) == told
    assert split_plan.parse(split_plan.canonical(plan)) == plan
    with pytest.raises(ValueError, match="unknown atom"):
        split_plan.parse("document / nonsense")
    with pytest.raises(ValueError, match="first stage"):
        split_plan.parse("drift")


def test_fingerprints_ignore_what_has_no_effect():
    assert IndexConfig(graph_knn=3).fingerprint() == IndexConfig().fingerprint()
    assert IndexConfig(hierarchy="label-prop", graph_knn=3).fingerprint() != IndexConfig(hierarchy="label-prop").fingerprint()
    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1})
    assert IndexConfig(embedder="none such").problems() and RetrievalConfig(k=0).problems()
    assert not IndexConfig().problems() and not RetrievalConfig().problems()
    with pytest.raises(ValueError):
        fingerprint({"a": float("nan")})


@pytest.mark.parametrize(
    "config",
    [
        IndexConfig(embedder="transformer"),
        IndexConfig(hierarchy="leiden"),
        IndexConfig(hierarchy="metadata", hierarchy_levels=2),
        IndexConfig(hierarchy="kmeans", summarizer="llm"),
        IndexConfig(split_plan="part / nothing"),
        RetrievalConfig(summary_scope="none"),
        RetrievalConfig(summary_boost=0.0),
        RetrievalConfig(summary_levels=(0,)),
    ],
)
def test_what_is_not_built_is_refused(config):
    assert config.problems()


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "b", None)], "id int, k string, n int")
    ids = lambda spec: sorted(r.id for r in df.where(filters.compile_filter(spec, F.col)).collect())
    assert ids({}) == ids(None) == [1, 2, 3]
    assert ids({"k": {"$ne": "a"}}) == [3]
    assert ids({"k": {"$nin": ["b"]}}) == [1]
    assert ids({"n": {"$gte": 5, "$lt": 7}}) == [1]
    assert ids({"k": {"$gt": 3}}) == []
    assert ids({"$or": [{"k": "a"}, {"n": 7}]}) == [1, 2]
    assert ids({"$and": [{"k": "a"}, {"n": 7}]}) == []
    with pytest.raises(ValueError):
        filters.compile_filter({"k": {"$like": "a"}}, F.col)


def test_filters_of_every_wrong_kind(spark):
    """Every operator with values of every kind on labels of every kind: what does not fit is not equal, and nothing fails."""
    rows = [(1, "a", 5, 1.5, True, 2**60 + 1), (2, "5", 0, 5.0, False, 2**60)]
    df = spark.createDataFrame(rows, "id int, s string, i int, d double, b boolean, l bigint")
    order = {"$gt": lambda x, y: x > y, "$gte": lambda x, y: x >= y, "$lt": lambda x, y: x < y, "$lte": lambda x, y: x <= y}

    def holds(x, op, v):
        if op in order:
            return isinstance(x, str) == isinstance(v, str) and order[op](x, v)
        return {"$eq": lambda: x == v, "$ne": lambda: x != v, "$in": lambda: x in v, "$nin": lambda: x not in v}[op]()

    specs = [(c, op, v) for c in "sidbl" for v in ("a", "5", 5, 1.5, True, False, 2**60 + 1) for op in ("$eq", "$ne", *order)]
    specs += [(c, op, v) for c in "sidbl" for v in (["a", 5], [1, 2], [], ["5", True]) for op in ("$in", "$nin")]
    # orderings of bigints go by their nearest double
    specs = [x for x in specs if not (x[0] == "l" and x[1] in order and x[2] == 2**60 + 1)]
    got = df.select("id", *[filters.compile_filter({c: {op: v}}, F.col).alias(f"x{k}") for k, (c, op, v) in enumerate(specs)]).collect()
    for r, row in zip(sorted(got), rows, strict=True):
        values = dict(zip("sidbl", row[1:], strict=True))
        for k, (c, op, v) in enumerate(specs):
            assert r[f"x{k}"] == holds(values[c], op, v), (row, c, op, v)


def test_hash_embedders(spark):
    texts = [(1, "Aa bb aa, cc! ünï ünï ünï"), (2, ""), (3, None), (4, "متن فارسی متن"), (5, "ab")]
    df = spark.createDataFrame(texts, "id int, text string")
    number = lambda s, n: int(hashlib.blake2b(s.encode(), digest_size=8).hexdigest(), 16) % n
    for kind, slots, pieces, weight in (
        (embedders.token_hash, 512, lambda t: [w for w in re.findall(r"[^\W_]+", t.lower()) if len(w) > 1], lambda n: 1 + math.log(n)),
        (embedders.char_hash, 1024, lambda t: [t.lower()[i : i + 4] for i in range(len(t) - 3)] or [t.lower()] * bool(t), float),
    ):
        got = {(r.id, r.slot): r.weight for r in kind(df, "id", "text").collect()}
        want = {}
        for i, t in texts:
            counts = {k: weight(n) for k, n in collections.Counter(number(p, slots) for p in pieces(t or "")).items()}
            norm = math.sqrt(sum(x * x for x in counts.values()))
            want |= {(i, k): x / norm for k, x in counts.items()}
        assert got == pytest.approx(want)


def test_rare_terms_and_edges(spark):
    """The 12 rarest of all tokens; of these, those that two to a fifth of the lists hold join chunks."""
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(3)) for _ in range(20)) for i in range(30)}
    ix = index.build(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text")
    df = collections.Counter(w for t in texts.values() for w in set(t.split()))
    top = {i: sorted(set(t.split()), key=lambda w: (df[w], w))[:12] for i, t in texts.items()}
    rare = hierarchy.rare_terms(ix)
    assert {(r.id, r.token) for r in rare.collect()} == {(i, w) for i, ws in top.items() for w in ws}
    held = collections.Counter(w for ws in top.values() for w in ws)
    weight = collections.Counter()
    for a in texts:
        for b in texts:
            for w in set(top[a]) & set(top[b]) if a < b else ():
                if 2 <= held[w] <= 6:
                    weight[a, b] += round(math.log(1 + (30 - df[w] + 0.5) / (df[w] + 0.5)), 6)
    assert {(r.a, r.b): r.weight for r in hierarchy.lexical_edges(rare, ix.stats).collect()} == pytest.approx(weight)


def test_refusals(spark):
    contexts = spark.createDataFrame([(1, 1, 7, "Short. A longer sentence.")], "qid int, rank int, doc int, text string")
    questions = spark.createDataFrame([(1,), (2,)], "qid int")
    got = {r.qid: r for r in retrieve.extractive_answer(contexts, questions).withColumn("no", retrieve.is_refusal(F.col("answer"))).collect()}
    assert got[1].answer == "A longer sentence. [7]" and not got[1].no
    assert got[2].answer == retrieve.REFUSALS["English"] and got[2].no


def test_global_rank_of_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, "a", "b", "c"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x int, y string, i int")
    got = {r.i: r._n for r in board.global_rank(df, ["x", "y", "i"], "_n").collect()}
    low = lambda v: (v is not None, v)
    want = sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2]))
    assert got == {r[2]: k for k, r in enumerate(want)}
    assert board.global_rank(df.where("false"), ["x"], "_n").count() == 0


def test_mmr_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(q, i, rng.random(), r + 1) for q in range(3) for r, i in enumerate(rng.sample(range(20), 10))]
    rows = [(q, i, 1 - r / 20, r) for q, i, _, r in rows]
    vec = {i: [rng.random() for _ in range(4)] for i in range(20)}
    cand = spark.createDataFrame(rows, "qid int, id int, score double, rank int")
    vecs = spark.createDataFrame(list(vec.items()), "id int, vec array<double>")
    got = {(r.qid, r.rank): r.id for r in retrieve.mmr(cand, vecs, 0.6, 5).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vec.items()}
    for q in range(3):
        left = [(i, s) for qq, i, s, _ in rows if qq == q]
        done = []
        for place in range(1, 6):
            best = max(left, key=lambda x: 0.6 * x[1] - 0.4 * max((float(unit[x[0]] @ unit[d]) for d in done), default=0.0))
            assert got[q, place] == best[0]
            left.remove(best)
            done.append(best[0])
    assert retrieve.mmr(cand, vecs, 1.0, 2).count() == 6


def test_budget_skips_what_does_not_fit(spark):
    kept = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "qid int, id string, rank int")
    sizes = spark.createDataFrame([("a", 70), ("b", 50), ("c", 30)], "id string, size int")
    assert sorted((r.qid, r.id) for r in retrieve.fit_budget(kept, sizes, 100).collect()) == [(1, "a"), (1, "c"), (2, "a")]
    assert retrieve.fit_budget(kept, sizes, 10).count() == 2  # the first always stays


def test_fuzzy_quotes(spark):
    df = spark.createDataFrame([("the quick brown fox", "xx the quick brown fox yy"), ("the quick brown fax!", "the quick brown fox"), ("quite other", "the quick brown fox"), ("", "x")], "quote string, text string")
    got = {r.quote: r.found for r in metrics.fuzzy_quotes(df, 0.75).collect()}
    assert got == {"the quick brown fox": True, "the quick brown fax!": True, "quite other": False, "": False}


def test_fuzzy_quotes_against_difflib(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        q = "".join(rng.choice("ab ä") for _ in range(rng.randint(1, 60)))
        cut = rng.randint(0, max(1, len(q) // 6))
        t = rng.choice(["x", "aä"]) + (q[cut:] if k % 2 else q[: len(q) - cut]) + rng.choice(["", "zz"])
        rows.append((k, q, t))
    rows += [(900, "abc", None), (901, None, "abc"), (902, "abcdefghij", "-abcdefghi"), (903, "abcdefghij", "abcdefgh")]
    got = {r.k: r.found for r in metrics.fuzzy_quotes(spark.createDataFrame(rows, "k int, quote string, text string")).collect()}
    share = lambda q, t: difflib.SequenceMatcher(None, q, t, autojunk=False).find_longest_match().size / len(q) if q and t else 0.0
    assert got == {k: share(q, t) >= 0.9 for k, q, t in rows}
    assert {*got.values()} == {True, False}


def test_fuzzy_quote_judges_whole_turns_and_all(spark, tmp_path):
    head = "the first forty characters are the same, "
    rows = [(1, 0, "user", head + "but then it goes another way altogether"), (1, 1, "assistant", head), (1, 2, "user", head), (2, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.found for r in catalog.QUERIES["fuzzy_quote"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): False, (1, 1): True}


@pytest.mark.parametrize("most", [0, 20_000])
def test_largest_overlap(spark, monkeypatch, most):
    monkeypatch.setattr(metrics, "OVERLAP_QUESTIONS", most)
    asked = spark.createDataFrame([(1, "red apple red pie"), (2, "whale"), (3, "?"), (4, None)], "item_id int, text string")
    told = spark.createDataFrame([("an apple",), ("Red, red apple!",), ("pie",), (None,), ("an apple",)], "text string")
    got = metrics.largest_overlap(asked, told)
    assert {r.item_id: r.overlap for r in got.collect()} == {1: 0.666667, 2: 0.0, 3: 0.0, 4: 0.0}
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_merge_board(spark):
    runs = spark.createDataFrame([(3, 7, 1.0), (4, None, None)], "id int, dataset int, decision double")
    ledger = spark.createDataFrame([(3, None, 9.0), (4, None, 5.0), (6, None, 2.0)], "id int, dataset int, decision double")
    alone = runs.unionByName(spark.createDataFrame([(9, 8, 4.0)], "id int, dataset int, decision double"))
    got = sorted(tuple(r) for r in board.merge_board(alone, ledger, "id", ["dataset", "decision"]).collect())
    assert got == [(3, 7, 1.0, "both"), (4, None, 5.0, "both"), (6, None, 2.0, "ledger"), (9, 8, 4.0, "run")]


def test_replies(spark):
    row = spark.createDataFrame([("1: 7\n2: 30\nx\n1: 2", '```json\n{"supported": true, "reason": "r"}\n```', "It was 12 days", "12 13 14")], "a string, b string, c string, d string").select(
        text.grade_lines(F.col("a")).alias("g"), text.verdict_json(F.col("b")).alias("v"), text.mutate_number(F.col("c"), F.col("d")).alias("m")
    ).first()
    assert row.g == {1: 0.7, 2: 1.0} and row.v.supported is True and row.m == "It was 15 days"


def test_leaf_documents_and_sentences(spark):
    sums = spark.createDataFrame([("s1", ["c1", "c2"]), ("s2", ["c3"]), ("t", ["s1", "s2"])], "id string, member_ids array<string>")
    leaves = spark.createDataFrame([("c1", 1), ("c2", 1), ("c3", 2)], "id string, doc int")
    got = sorted(tuple(r) for r in hierarchy.leaf_documents(sums, leaves, 2).collect())
    assert got == [("s1", 1), ("s2", 2), ("t", 1), ("t", 2)]
    rows = spark.createDataFrame([(1, 1, "abc"), (1, 2, "defg"), (1, 3, "h")], "g int, place int, sentence string")
    assert hierarchy.fit_sentences(rows, "g", 8).first().text == "abc defg"


def test_samples(spark):
    df = spark.range(97).withColumn("band", F.col("id") % 5)
    got = sorted(r.id for r in board.stride_sample(df, ["id"], 10, 97).collect())
    assert got == [i * 97 // 10 for i in range(10)]
    picked = board.balanced_sample(df, "band", ["id"], 13).groupBy("band").count().collect()
    assert sorted(r["count"] for r in picked) == [2, 2, 3, 3, 3]
    assert sorted(r._n for r in board.global_rank(df, ["id"], "_n").collect()) == list(range(97))


def test_time_scopes():
    a = dt.date(2024, 3, 15)
    assert dates.time_scope("what happened yesterday", a).start == dt.date(2024, 3, 14)
    assert dates.time_scope("in winter", a).end == dt.date(2024, 2, 29)
    assert dates.time_scope("in 2021?", a).start == dt.date(2021, 1, 1)
    assert dates.time_scope("two months ago", a).start == dt.date(2024, 1, 1)
    assert dates.time_scope("last month", a) == dates.Scope(dt.date(2024, 2, 1), dt.date(2024, 2, 29), "last month")
    assert dates.time_scope("in october", a).start == dt.date(2023, 10, 1)
    assert dates.time_scope("nothing", a) is None and dates.time_scope(None, a) is None


def test_drift_and_separators(spark):
    vec = {0: [1.0, 0.0], 1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    rows = [(1, i, f"t{i}", vec[i]) for i in range(4)] + [(2, 0, "a", vec[0]), (2, 1, "b", vec[2])]
    df = spark.createDataFrame(rows, "doc_id int, part_idx int, text string, vec array<double>")
    got = sorted((r.doc_id, r.text) for r in chunking.drift_chunks(df, 500, 0.2).collect())
    assert got == [(1, "t0\nt1"), (1, "t2\nt3"), (2, "a\nb")]


def test_nfkc(spark):
    texts = [None, "", "plain  text ", "ﬁne ①  Ａ\u3000b", "e\u0301 ½", "a\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", text.nfkc(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    got = [r.x for r in df.select("i", text.normalize(F.col("t"), compose=True).alias("x")).orderBy("i").collect()]
    assert got == [t if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]


def test_refusals_and_facts(spark):
    rows = [("\n No idea. \n", True), ("Cannot say. But 3.", True), ("It is 3. I cannot say more.", False), (None, False), ("", False), ("no idea.", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, want boolean")
    said = text.reads_as_refusal(F.col("a"), ("No idea.",), ("Cannot", "cannot"))
    assert all(r.got == r.want for r in df.select("want", said.alias("got")).collect())
    fixed = df.select("i", text.reads_as_refusal(F.col("a"), ("No idea.",)).alias("got")).where("got").collect()
    assert [r.i for r in fixed] == [0]
    replies = [("1: yes\n2: no\n3. TRUE", 3, "a", 2 / 3), ("1: no\n1 - yes", 1, "a", 1.0), ("maybe", 2, "a", None), (None, 2, "a", None),
               ("1: yes", 0, "a", None), ("1: yes", 2, "", None), ("1:\nyes\n2: yes", 2, "a", 0.5), ("99: yes", 1, "a", 0.0), ("9" * 30 + ": yes", 1, "a", 0.0)]
    df = spark.createDataFrame(replies, "r string, n int, a string, want double")
    for r in df.select("want", text.fact_coverage(F.col("r"), F.col("n"), F.col("a")).alias("got")).collect():
        assert r.got == r.want or abs(r.got - r.want) < 1e-9


def test_flattened_labels(spark):
    df = spark.createDataFrame([(["a", None, "b"], {"z": 1, "b": 2}, 7), (None, None, None), ([], {}, 0)], "l array<string>, m map<string,int>, n int")
    got = df.select(*[text.flattened(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a None b", '{"b":2,"z":1}', 7), (None, None, None), ("", "{}", 0)], key=repr)


def test_run_rows_and_screens(spark):
    run = spark.createDataFrame([(1, 1.0, False), (2, 0.5, None), (3, None, True), (4, 1.0, True)], "qid int, recall double, abstained boolean")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "qid int, question string")
    ids = lambda only: sorted((r.qid, r.question) for r in board.failures(run, asked, "qid", only).collect())
    assert ids("missed") == [(2, "b"), (3, None)] and ids("abstained") == [(3, None), (4, "d")] and len(ids("other")) == 4
    items = spark.createDataFrame([(True, 0.5), (True, 0.53), (False, 0.5)], "supported boolean, overlap double")
    assert tuple(board.lexical_signal(items).first()) == (0.515, 0.5, 0.015, True)
    assert tuple(board.lexical_signal(items.where("supported")).first()) == (0.515, None, None, False)
    assert tuple(board.lexical_signal(items.where("false")).first()) == (None, None, None, False)
    assert board.with_labels(asked, {"question": ["a", "d"], "qid": [4]}).count() == 1 and board.with_labels(asked, {"qid": []}).count() == 0
    assert metrics.expected_judge_calls(10, 8) == 140 and metrics.expected_judge_calls(10, 8, False) == 120 and metrics.expected_judge_calls(-1, 3) == 0
    both = board.pool(asked, spark.createDataFrame([("s", 2)], "note string, level int"))
    assert sorted((r.layer, r.level, r.question or "", r.note or "") for r in both.collect()) == [
        ("leaf", 0, "a", ""), ("leaf", 0, "b", ""), ("leaf", 0, "d", ""), ("summary", 2, "", "s")]
