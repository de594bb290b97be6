"""Split plans carried out, against a loop over each document."""

import math
import random
import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import chunking, groups, split
from sheafline.plans.config import PRODUCTION, IndexConfig
from sheafline.plans.split_plan import parse


def embedding(text):
    v = np.zeros(128)
    for t in re.findall("[a-z0-9]+", text.lower()):
        v[int(md5(t.encode()).hexdigest()[-2:], 16) % 128] += 1
    n = math.sqrt((v * v).sum())
    return v / n if n else v


def loop(parts, plan, budget, overlap, join="\n", prefix=""):
    """One document: parts are (text, labels); gives (part_start, part_end, text)."""
    line = [f"{labels.get(prefix) or ''}: {t}" if prefix else t for t, labels in parts]
    render = lambda a, b: (join.join(line[a : b + 1]), a, b)

    def runs(a, b, opens):
        cuts = [a, *[i for i in range(a + 1, b + 1) if opens(i)], b + 1]
        return [render(x, y - 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def chosen(i, stage):
        holds = [parts[i][1].get(a.label) == a.value for a in stage.atoms if a.kind == "label"]
        return bool(holds) and (all(holds) if stage.join == "and" else any(holds))

    def drift(a, b, stage):
        if b - a + 1 <= 2:
            return [render(a, b)]
        sims = [float((embedding(parts[i][0]) * embedding(parts[i + 1][0])).sum()) for i in range(a, b)]
        edge, size, cuts = float(np.percentile(sims, 35)), len(parts[a][0]), set()
        markers = [x.value for x in stage.atoms if x.kind == "separator"]
        for i in range(a + 1, b + 1):
            t = parts[i][0]
            if sims[i - 1 - a] <= edge + 1e-12 or any(m in " ".join(t.split()) for m in markers) or size + len(t) > 2 * budget:
                cuts.add(i)
                size = 0
            size += len(t)
        return runs(a, b, cuts.__contains__)

    def separate(text, a, b, stage):
        literals = [x.value for x in stage.atoms if x.kind == "separator"]
        spans, cuts = [(None, 0, len(text))], []
        if a >= 0 and any(x.kind == "label" for x in stage.atoms):
            spans, at = [], 0
            for i in range(a, b + 1):
                spans.append((i, at, at + len(line[i])))
                at += len(line[i]) + len(join)
        for i, lo, hi in spans:
            if i is not None and stage.join == "and" and not chosen(i, stage):
                continue
            if i is not None and stage.join == "or" and chosen(i, stage) and i > a:
                cuts.append((lo, 0))
            for at in range(lo, hi):
                found = [x for x in literals if text.startswith(x, at) and at + len(x) <= hi]
                if found and (stage.join == "or" or len(found) == len(literals)):
                    cuts.append((at, max(map(len, found))))
        out, at = [], 0
        for place, n in sorted(set(cuts)):
            if place >= at:
                out.append(text[at:place])
                at = place + n
        return [(x.strip(), -1, -1) for x in [*out, text[at:]] if x.strip()]

    stages = parse(plan)
    pieces = [render(0, len(parts) - 1)]
    for stage in stages[1:]:
        kinds, new = {x.kind for x in stage.atoms}, []
        for text, a, b in pieces:
            if stage.over_budget and len(text) <= budget:
                new.append((text, a, b))
            elif "drift" in kinds:
                new += drift(a, b, stage) if a >= 0 else [(text, a, b)]
            elif "separator" in kinds:
                new += separate(text, a, b, stage)
            elif a < 0:
                new.append((text, a, b))
            else:
                new += [render(i, i) for i in range(a, b + 1)] if kinds == {"part"} else runs(a, b, lambda i, s=stage: chosen(i, s))
        pieces = new
    out = []
    for text, a, b in pieces:
        if len(text) <= budget:
            out.append((a, b, text))
        else:
            cut = chunking.windows(text, budget, overlap) if overlap else chunking.pack_words(text, budget)
            out += [(a if a == b else -1, b if a == b else -1, x) for x in cut]
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta, iota. kappa;  lambda\tmu".split(" ")
    docs = {}
    for d in range(9):
        n = [1, 2, 3, 5, 8, 13, 21, 60, 4][d]
        docs[d] = [(" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 6, 15]))), {"role": rng.choice(["user", "assistant", None]), "mood": rng.choice(["a", "b"])}) for _ in range(n)]
    docs[3][1] = ("one. two;. three. . four", {"role": "user", "mood": "a"})
    return docs


PLANS = [
    "part",
    "document / part over-budget",
    "document / role=user and mood=a over-budget / part over-budget",
    'document / ". " or ";" / "," over-budget',
    'document / "." and ". "',
    'document / ". " and role=user over-budget',
    'document / ". " or role=assistant / " " over-budget',
    'document / drift or "iota" over-budget / role=user or mood=b over-budget / "." over-budget',
    'document / "." over-budget / part',
]


@pytest.mark.parametrize("plan", PLANS)
def test_plans_against_a_loop(spark, monkeypatch, talks, plan):
    monkeypatch.setattr(groups, "BLOCK", 4)  # a document lies in many blocks
    rows = [(d, 10 * i, t, labels["role"], labels["mood"], "x") for d, parts in talks.items() for i, (t, labels) in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc_id long, part_idx int, text string, role string, mood string, extra string").repartition(3)
    n = PLANS.index(plan)
    budget, overlap, prefix = [(60, 0, ""), (90, 25, "role"), (40, 60, "")][n % 3]
    chunks, _ = split.carry_out(df, plan, budget, overlap, prefix=prefix)
    got = {}
    for r in chunks.orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.part_start, r.part_end, r.text))
        assert r.chunk_no == len(got[r.doc_id]) - 1 and r.chunk_id == f"{r.doc_id}:c{r.chunk_no}"
    want = {}
    for d, parts in talks.items():
        if plan == "part":
            line = [f"{labels['role'] or ''}: {t}" if prefix else t for t, labels in parts]
            want[d] = [(i, i, x) for i, t in enumerate(line) for x in ([t] if len(t) <= budget else chunking.windows(t, budget, overlap) if overlap else chunking.pack_words(t, budget))]
        else:
            want[d] = loop(parts, plan, budget, overlap, prefix=prefix)
    assert got == {d: x for d, x in want.items() if x}


def test_index_chunks(spark, talks):
    rows = [(d, i, t, labels["role"]) for d, parts in talks.items() for i, (t, labels) in enumerate(parts)]
    parts = spark.createDataFrame(rows, "doc_id long, part_idx int, text string, role string")
    docs = spark.createDataFrame([(d, None if d == 2 else f"d{d}", "") for d in talks], "doc_id long, name string, empty string")
    assert not PRODUCTION[0].problems()
    out = split.index_chunks(parts, docs, IndexConfig(split_plan="document / role=user", chunk_chars=100_000), ["name", "empty"], ["role"]).collect()
    for r in out:
        assert r.prefix == ("" if r.doc_id == 2 else f"[name: d{r.doc_id}]\n") and r.text.startswith(r.prefix)
        own = [labels["role"] for _, labels in talks[r.doc_id][r.part_start : r.part_end + 1]]
        assert r.role == list(dict.fromkeys(x for x in own if x))
    assert split.index_chunks(parts.limit(0), docs, IndexConfig()).count() == 0
    with pytest.raises(ValueError):
        split.index_chunks(parts, docs, IndexConfig(chunk_chars=0))


@pytest.mark.parametrize("block", [3, 4096])
def test_running_values_of_any_group(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([None, 1, 5])) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(4)
    got = {r.i: r for r in groups.with_running(groups.with_running(df, ["k"], ["i"], "sum", F.col("v"), "s"), ["k"], ["i"], "max", F.col("v"), "m").collect()}
    totals = {r.i: r for r in groups.with_totals(df, ["k"], "i", {"n": ("count", F.lit(1)), "low": ("min", F.col("v"))}).collect()}
    for k, i, _ in rows:
        seen = [v for kk, ii, v in rows if kk == k and ii <= i and v is not None]
        assert (got[i].s, got[i].m) == ((sum(seen), max(seen)) if seen else (None, None))
        own = [v for kk, _, v in rows if kk == k]
        assert (totals[i].n, totals[i].low) == (len(own), min(v for v in own if v is not None))
