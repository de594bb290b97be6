import random

import pytest

from sheafline.operators import index, retrieve
from sheafline.operators.stored_index import StoredIndex, stored


@pytest.mark.parametrize(("size", "first"), [(7, 1), (7, 3), (4096, 4)])
def test_same_as_the_whole_index(spark, tmp_path, size, first):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(25) for _ in range(26 - i)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(120)] + [(500, None), (501, ""), (502, "t24 t24 t24")]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "t24 t23"), (2, "t0"), (3, "what is the t20 of t5"), (4, "nothing"), (5, None), (6, "t24")], "qid int, question string")
    held = StoredIndex(spark, f"{tmp_path}/index")
    assert not held.exists()
    held.build(docs, size, 4)
    assert held.exists()
    whole = index.build(docs, "id", "text")
    for variants in (False, True):
        for k in (3, 500):
            want = sorted(map(tuple, retrieve.bm25(whole, asked, k, variants).collect()))
            assert sorted(map(tuple, held.search(asked, k, variants, first).collect())) == want and want


def test_kept_by_files(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame([(1, "one two"), (2, "two three")], "id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    a = stored(spark, docs, {"of": "docs"})
    assert a.exists() and stored(spark, docs, {"of": "docs"}).path == a.path and stored(spark, docs, {"of": "other"}).path != a.path
    asked = spark.createDataFrame([(1, "three")], "qid int, question string")
    plan = a._asked(asked, False)[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert [r.id for r in a.search(asked, 5).collect()] == [2]


def test_ranges_are_made_where_texts_are_read(spark, tmp_path):
    from sheafline.operators import stored_index

    rows = [(1, "a1 b2 a1"), (2, "b2 c3"), (1, "b2 a1"), (1, "c3 a1 a1"), (3, None), (None, "a1"), (None, "a1 b2"), (4, "a1 c3")]
    docs = spark.createDataFrame(rows, "id long, text string")
    single = docs.where("id > 1").union(docs.where("id = 1").limit(1))
    assert "Exchange hashpartitioning(token" not in stored_index._blocks(single, 2)._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, "a1"), (2, "b2 c3")], "qid int, question string")
    held = StoredIndex(spark, f"{tmp_path}/several").build(docs, 2, 4)
    assert set(spark.read.parquet(f"{held.path}/blocks").columns) == {"token", "range", "most", "ids", "tfs", "dls", "bucket"}
    want = {tuple(r) for r in retrieve.bm25(index.build(docs, "id", "text"), asked, 9).collect()}
    assert {tuple(r) for r in held.search(asked, 9, first=1).collect()} == want and len(want) == 7
