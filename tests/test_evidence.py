"""Quotes in texts against plain searches."""

import difflib
import random

import pytest

from sheafline.operators import evidence


def collapse(t):
    return " ".join((t or "").split(None))


@pytest.fixture(scope="module")
def told():
    rng = random.Random(21)
    words = [f"w{rng.randrange(30)}" for _ in range(400)] + ["Ünï", "x", "a-b"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 60]))) + rng.choice(["", "\n ", "\t"]) for i in range(60)}
    texts |= {100: None, 101: "", 102: "  one\n two ", 103: texts[5], 104: "aaaa aaaa aaaa"}
    quotes = {}
    for k in range(50):
        t = collapse(texts[rng.randrange(60)])
        a = rng.randrange(len(t))
        q = t[a : a + rng.choice([1, 4, 20, 60, 200])]
        if k % 3 == 0 and len(q) > 10:  # a few characters other than in the text
            cut = rng.choice([1, len(q) // 10, len(q) // 5])
            q = q[:-cut] + "#" * cut if k % 2 else "#" * cut + q[cut:]
        quotes[k] = q.replace(" ", "  ", 1)
    quotes |= {60: "", 61: None, 62: "one two", 63: "w1 nowhere w2", 64: "aa", 65: collapse(texts[7]) + " and more words behind", 66: "aaaa aaaa"}
    return texts, quotes


def longest(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size


@pytest.mark.parametrize("least", [1.0, 0.9, 0.75])
def test_runs_of_quotes(spark, told, least):
    texts, quotes = told
    got = {(r.quote_id, r.id): r.exact for r in evidence.find_quotes(spark.createDataFrame(list(quotes.items()), "quote_id int, quote string"), spark.createDataFrame(list(texts.items()), "id int, text string"), least).collect()}
    want = {}
    for k, q in quotes.items():
        for i, t in texts.items():
            a, b = collapse(q), collapse(t)
            if a and b and (a in b or least < 1 and longest(a, b) / len(a) >= least):
                want[k, i] = a in b
    assert got == want and len(want) > 60


def test_gold_and_spans(spark, told):
    texts, quotes = told
    docs = spark.createDataFrame(list(texts.items()), "doc int, text string")
    rows = [(k % 20, q) for k, q in quotes.items()]
    got = [tuple(r) for r in evidence.gold_pairs(docs, spark.createDataFrame(rows, "qid int, quote string")).collect()]
    clean = [(k, collapse(q)) for k, q in rows if collapse(q)]
    want = {(k, d) for k, q in clean for d, t in texts.items() if collapse(t) and (q in collapse(t) or collapse(t) in q)}
    assert set(got) == want and len(got) == len(want) and any(collapse(texts[d]) in q and collapse(texts[d]) != q for k, d in want for kk, q in clean if kk == k)
    found = {}
    for r in evidence.spans(spark.createDataFrame(list(quotes.items()), "quote_id int, quote string"), docs.withColumnRenamed("doc", "id")).collect():
        found.setdefault(r.id, set()).add((r.start, r.end))
    for d, t in texts.items():
        marks = sorted((i, i + len(q)) for q in quotes.values() if collapse(q) for i in range(len(t or "")) if (t or "").startswith(q, i))
        merged = []
        for a, b in marks:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert found.get(d, set()) == {tuple(x) for x in merged}, d


def test_recall_on_text(spark):
    quotes = [(1, "red apple pie", "verbatim"), (1, "blue whale song in the deep ocean now", "verbatim"), (1, "never", "paraphrase"), (2, "only said otherwise", "computed"), (3, "no contexts at all", "verbatim"), (4, " ", "verbatim")]
    contexts = [(1, 2, "pie is good"), (1, 1, "a red\n apple"), (1, 3, "Xlue whale song in the deep ocean now"), (5, 1, "alone")]
    got = {r.qid: r.quote_recall for r in evidence.text_recall(spark.createDataFrame(quotes, "qid int, quote string, fidelity string"), spark.createDataFrame(contexts, "qid int, rank int, text string")).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.0, 4: None, 5: None}
