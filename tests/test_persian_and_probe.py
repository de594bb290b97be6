"""Persian text against a plain version, and the probe against a loop."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafline.functions import persian
from sheafline.operators import probe

TEXTS = [
    None, "", "كتاب‌ها يك", "می‌خوام  برم\t۱۴۰۵ ٣", "آب أ إ ؤ ئ ة ۀ ٱ ء", "سَلامٌ عليكــم", "ﻛﺘﺎﺏ ﻱ", "English and کتاب 12", "به‌ از می‌شه", "ى ڪ گ", "a" + persian.HALF_SPACE + "bc de",
]


def plain(t):
    t = unicodedata.normalize("NFKC", t).translate(str.maketrans(dict(zip(persian.FROM, list(persian.TO) + [""] * (len(persian.FROM) - len(persian.TO)), strict=True))))
    return re.sub("[ \t ]+", " ", t).strip(" ")


def plain_tokens(t):
    out = []
    for w in re.findall(f"[^\\W_]+(?:{persian.HALF_SPACE}[^\\W_]+)*", plain(t or "").lower()):
        parts = w.split(persian.HALF_SPACE)
        out += [x for x in ["".join(parts), *(parts if len(parts) > 1 else [])] if len(x) >= 2 and x not in persian.STOP_WORDS]
    return out


def test_persian(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    once = df.select("i", "t", persian.normalize(F.col("t")).alias("n"), persian.tokens(F.col("t")).alias("k")).withColumn("g", persian.char_ngrams(F.col("n")))
    for r in once.withColumn("again", persian.normalize(F.col("n"))).collect():
        assert r.n == (None if r.t is None else plain(r.t)) and r.again == r.n
        assert r.k == plain_tokens(r.t)
        flat = re.sub(r"\s+", " ", plain(r.t or "").lower().replace(persian.HALF_SPACE, ""))
        assert r.g == ([flat[i : i + 4] for i in range(len(flat) - 3)] if len(flat) >= 4 else [flat] if flat else [])
    got = {r.i: (r.n, r.k) for r in once.collect()}
    assert got[2] == ("کتاب‌ها یک", ["کتابها", "کتاب", "ها", "یک"]) and got[3][1] == ["میخوام", "می", "خوام", "برم", "1405"]
    assert got[4][0] == "اب ا ا و ی ه ه ا" and got[5][0] == "سلام علیکم"


@given(st.text(alphabet=st.characters(min_codepoint=0x600, max_codepoint=0x6FF), max_size=30))
@settings(max_examples=200, deadline=None)
def test_folding_twice_changes_nothing(t):
    assert plain(plain(t)) == plain(t)


@pytest.mark.parametrize("shift", [0.0, 0.4])
def test_probe(spark, shift):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 8))
    b = a + shift * rng.standard_normal((20, 8))
    a[3] = a[4]
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    random.Random(1).shuffle(rows)
    got = probe.bilingual(spark.createDataFrame(rows, "pair_id int, a array<double>, b array<double>")).first()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    pool = np.round(np.vstack([unit(a), unit(b)]) @ np.vstack([unit(a), unit(b)]).T, 9)
    sims = unit(a) @ unit(b).T
    np.fill_diagonal(pool, -2)
    n, off = 20, sims[~np.eye(20, dtype=bool)]
    wins = [int((pool[:n].argmax(axis=1) == np.arange(n) + n).sum()), int((pool[n:].argmax(axis=1) == np.arange(n)).sum())]
    assert (got.n, got.a_wins, got.b_wins) == (n, *wins)
    assert [got.pair_mean, got.pair_min, got.other_mean, got.other_max] == pytest.approx([np.diag(sims).mean(), np.diag(sims).min(), off.mean(), off.max()], abs=1e-4)
    assert got.verdict == ("aligned" if wins == [n, n] and np.diag(sims).mean() - off.mean() >= 0.3 else "weak or no alignment")
