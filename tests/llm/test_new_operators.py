"""Token files, window panes and the filter audit against loops, on small tables with odd rows."""

import collections
import datetime
import hashlib
import itertools
import json
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafline.llm import filter_audit, panes, token_output
from sheafline.llm.components import Scratch
from sheafline.llm.oracles import ORACLES

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    tk = Tokenizer.from_file(BPE)
    tk.encode_special_tokens = True
    return tk


# ---------------------------------------------------------------- 11


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=100, deadline=None)
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a  b <|endoftext|> c", " x \n y", "it's 12 é"]
    if not hasattr(test_ids_of_any_text, "tk"):
        test_ids_of_any_text.tk = library()
    got = []
    for _, _, ids, counts in token_output._loaded(BPE).encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [test_ids_of_any_text.tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma's", "δελτα", "12,5"]) for _ in range(rng.randrange(80))) for i in range(-5, 60)}
    texts |= {7: None, 8: "", 9: "word " * 30000, 2**40: "last one"}
    rows = [(i, t, 1, "x") for i, t in texts.items()] + [(None, "no id", 1, "x"), (10, texts[10], 1, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, frame string").repartition(5)
    folder = f"{tmp_path}/ids"
    token_output.write(df, folder, BPE)
    back = token_output.read(spark, folder)
    tk, start = library(), 0
    got = back.orderBy("start", F.col("doc_id").asc_nulls_first()).collect()
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    # short access: conditions choose shards and frames
    told = json.loads(Path(folder, "manifest.json").read_text())
    assert told["tokens"] == start and len(told["shards"]) > 1
    some = back.where("doc_id in (3, 9, 77)")
    assert {r.doc_id for r in some.collect()} == {3, 9}
    assert {r.doc_id for r in back.where("doc_id >= 58").collect()} == {58, 59, 2**40}
    assert all(r.ids is None for r in token_output.read(spark, folder, ids=False).collect())
    # another dictionary is refused
    other = Path(folder, f"dictionary-{told['dictionary']}.zdict")
    assert hashlib.sha256(other.read_bytes()).hexdigest() == told["dictionary"]
    other.write_bytes(other.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="was not written with the dictionary"):
        back.collect()
    # a frame is read by zstandard alone
    none = f"{tmp_path}/none"
    token_output.write(df.limit(0), none, BPE)
    assert token_output.read(spark, none).count() == 0


def test_dictionary_makes_short_documents_smaller(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice([f"common{k}" for k in range(40)]) for _ in range(30))) for i in range(300)], "doc_id long, text string")
    raw = token_output.train_dictionary(df, BPE)
    assert raw == token_output.train_dictionary(df.repartition(3), BPE)
    with_it, without = (sum(len(r.frame) for r in token_output.frames(df, BPE, d).collect()) for d in (raw, b""))
    assert with_it < 0.8 * without
    frame = token_output.frames(df.where("doc_id = 5"), BPE, raw).first()
    ids = np.frombuffer(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(frame.frame), "<u2")
    assert len(ids) == frame.n_tokens


# ---------------------------------------------------------------- 12


def brute_panes(rows, n):
    """Batch after batch in plain Python, as the contract says; rows: click_id, kind, event, cents, batch."""
    hour = 3_600_000_000
    out, held, top = [], {}, None
    for b in range(n):
        passed = lambda h, behind: top is not None and top >= (h + 1) * hour + behind  # noqa: B023, E731
        old = {k: list(v) for k, v in held.items()}
        for click, kind, event, cents, batch in rows:
            if batch == b:
                h = event // hour
                if passed(h, 96 * hour):
                    out.append((b, h, click, 1, cents, "late", kind))
                else:
                    p = held.setdefault((kind, h), [0, 0, False])
                    p[0], p[1] = p[0] + 1, p[1] + cents
        for (kind, h), p in list(held.items()):
            was = old.get((kind, h), [0, 0, False])
            if p[2] and p[0] != was[0]:
                out += [(b, h, -1, was[0], was[1], "retract", kind), (b, h, -1, p[0], p[1], "replace", kind)]
            if not p[2] and passed(h, 6 * hour):
                p[2] = True
                out.append((b, h, -1, p[0], p[1], "emit", kind))
            if not p[2] and b == n - 1:
                out.append((b, h, -1, p[0], p[1], "final", kind))
            if passed(h, 96 * hour):
                del held[kind, h]
        top = max([top] * (top is not None) + [e for _, _, e, _, batch in rows if batch == b], default=None)
    return out


def test_panes(spark):
    rng = random.Random(3)
    hour = 3_600_000_000
    rows = []
    for i in range(120):
        b = rng.choice([0, 1, 1, 3, 4])
        rows.append((i, rng.choice(["a", "none"]), int((24 * b + rng.choice([-130, -40, -3, 0, 5, 20]) + rng.random()) * hour) // 1000 * 1000, rng.randrange(-500, 500), b))
    rows += [(200, "a", 5 * hour, 1, 0), (201, "a", 5 * hour - 1, 1, 0), (202, "edge", 101 * hour, 7, 3), (203, "edge", 0, 7, 4), (300, "r", 2 * hour, 5, 0), (301, "r", 30 * hour, 5, 1), (302, "r", 2 * hour + 1, 5, 3)]
    batches = [spark.createDataFrame([r[:4] for r in rows if r[4] == b], panes.EVENT) for b in range(6)]  # two are empty, one of them the last
    got = [tuple(r) for r in panes.run(spark, batches, Scratch(spark, "test")).collect()]
    want = brute_panes(rows, 6)
    assert collections.Counter(got) == collections.Counter(want)
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    assert panes.run(spark, [], Scratch(spark, "test")).count() == 0


def test_clicks_with_odd_rows(spark, tmp_path):
    t = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    rng = random.Random(9)
    rows = [(i, t(d, -rng.randrange(60)), t(d), 1, rng.choice(["view", None, ""]), rng.choice([None, 0.005, -1.235, 3.5, 99999.99]), "{}", 5) for i in range(40) for d in [rng.randrange(10)]]
    rows += rows[:6]  # repeated rows
    rows += [(50, None, t(1), 1, "view", 1.0, None, 5), (None, t(1), t(1), 1, "view", 1.0, None, 5), (51, t(1), None, None, "view", 1.0, None, 5), (52, t(1), t(2), 1, "view", float("nan"), None, 5)]
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour int")
    got = panes.click_panes(df)
    df.where("not isnan(value) or value is null").unionByName(df.where("isnan(value)").withColumn("value", F.lit(None).cast("double"))).coalesce(1).write.parquet(f"{tmp_path}/clicks")
    con = duckdb.connect()
    con.execute(f"create view clicks as select * from '{tmp_path}/clicks/*.parquet'")
    rel = con.execute(ORACLES["op12_window_panes"])
    names = [c[0] for c in rel.description]
    assert names == got.columns
    assert collections.Counter(map(tuple, rel.fetchall())) == collections.Counter(map(tuple, got.collect()))
    nothing = panes.click_panes(df.limit(0))
    assert nothing.count() == 0 and nothing.columns == got.columns


# ---------------------------------------------------------------- 13


def brute_audit(rows, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = word.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows),
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        first = collections.Counter(next((c for c in o if c in f), None) for o in itertools.permutations("ABCDE") for f, _, _ in own)
        for o in itertools.permutations("ABCDE"):
            for k, c in enumerate(o):
                gone = [not f.isdisjoint(o[:k]) for f, _, _ in own]
                now = [c in f and not g for (f, _, _), g in zip(own, gone, strict=True)]
                out.append((part, "".join(o), k + 1, sum(not g and not x for g, x in zip(gone, now, strict=True)), sum(now), sum(c in f and g for (f, _, _), g in zip(own, gone, strict=True)),
                            sum(f == {c} for f, _, _ in own), sum(x and g for x, (_, g, _) in zip(now, own, strict=True)), sum(x and t for x, (_, _, t) in zip(now, own, strict=True)), first[c]))
    return out


@pytest.fixture(scope="module")
def audited(spark):
    rng = random.Random(6)
    many = " ".join(f"w{i}" for i in range(250))
    long = "x" * 5000
    texts = [None, "", many, many + " $", many.replace("w", "W"), " ".join(["a"] * 300), long, long + "a", "y" + long[1:], "é𝒳 A", "a b", "a  b", long[:256] + "q" + long[257:], "z" * 300 + "é" * 70000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(3, rows[5][1], "en"), (70, many, "fr"), (70, many, "fr"), (None, many, "fr"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(4)
    return docs, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, lang string")


def test_audit(spark, audited):
    got = filter_audit.audit_documents(*tables(spark, *audited)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_audit(*audited))
    docs, labels = tables(spark, *audited)
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("weak", [False, True])
def test_copies(spark, audited, weak):
    """With a hash that joins different texts, full texts still tell them apart."""
    rows, _ = audited
    docs, _ = tables(spark, [r for r in rows if r[0] is not None and r[0] != 3], [])
    hashes = (lambda t: F.array(F.length(t).cast("long") % 2)) if weak else filter_audit.block_hashes
    got = {r.id for r in filter_audit.duplicates(docs, Scratch(spark, "copies"), hashes=hashes).where("later").collect()}
    own = [(d, t or "") for d, t, _ in rows if d is not None and d != 3]
    assert got == {d for d, t in own if any(e < d and u == t for e, u in own)}
