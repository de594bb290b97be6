import json

import pytest
from pyspark.sql import functions as F

from sheafline.operators import index
from sheafline.sources import datasets, stores
from sheafline.streaming import incremental

CORPUS = {
    "corpus_dataset_metadata": {"dataset": "d1", "name": "n", "language": "en", "label_fields": {"role": {"type": "string"}}},
    "corpus_documents": [
        {"corpus_document_id": 1, "document_content": [{"text": "one", "labels": {"role": "a"}}, {"text": "two", "labels": {"mood": "b"}}], "document_metadata": {"day": "2024-01-02"}},
        {"corpus_document_id": 2, "document_content": [{"text": ""}], "document_metadata": {"day": "2024-01-05"}},
    ],
}
TRUTH = {
    "groundtruth_dataset_metadata": {"name": "n", "corpus_ref": {"dataset": "d1"}},
    "groundtruth_dataset": [
        {"groundtruth_question_id": 1, "question": "q?", "expected_answer": {"behavior": "answer", "derived_facts": [{"derived_fact_id": 1, "fact": "f"}]},
         "relevant_corpus_documents": [{"corpus_document_id": 7, "evidence": [{"text": "e", "fidelity": "verbatim", "supports": [1, 9]}]}]},
        {"groundtruth_question_id": 2, "question": "r?", "expected_answer": {"behavior": "shrug"}, "relevant_corpus_documents": []},
    ],
}


def test_files_are_paired_and_checked(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CORPUS))
    (tmp_path / "t.json").write_text(json.dumps(TRUTH))
    (tmp_path / "other.json").write_text("{not json")
    corpora, truths = datasets.read_corpora(spark, [str(tmp_path)]), datasets.read_truths(spark, [str(tmp_path)])
    assert datasets.pair(corpora, truths).where("truth_file is not null").count() == 1
    row = datasets.catalogue(datasets.documents(corpora), datasets.questions(truths), "day").first()
    assert (row.n_documents, row.n_parts, row.n_questions, row.first_day, row.last_day) == (2, 3, 2, "2024-01-02", "2024-01-05")
    rules = {(r.rule, r.place) for r in datasets.problems(corpora, truths).collect()}
    assert ("empty part", "2:0") in rules and ("cited document is missing", "1:7") in rules and ("supported fact is missing", "1:9") in rules
    assert ("unknown behaviour", "2") in rules and ("label not declared", "mood") in rules and ("label not declared", "day") in rules


def test_corpus_versions(spark, tmp_path):
    store = stores.CorpusVersions(spark, str(tmp_path / "v"))
    key = store.put(CORPUS, TRUTH)
    assert store.put(CORPUS, TRUTH) == key and store.versions().count() == 1
    assert store.get(key) == CORPUS
    store.put(CORPUS, None)
    with pytest.raises(LookupError):
        store.get(key)
    with pytest.raises(KeyError):
        store.get("none")


def test_archives(spark, tmp_path):
    store = stores.CorpusVersions(spark, str(tmp_path / "v"))
    whole = {"run": 1, "corpus": CORPUS}
    small = stores.shrink(whole, store)
    assert "corpus" not in small and stores.swell(small, store) == whole
    assert not stores.archive_problems(whole)
    assert stores.archive_problems({"a": {"api_key": 1}}) and stores.archive_problems({"rows": [0] * 5001}) and stores.archive_problems({"x": float("nan")})


def test_ledger_and_runs(spark, tmp_path):
    ledger = stores.Ledger(spark, str(tmp_path / "l"))
    assert ledger.experiments().count() == 0
    ledger.record({"id": "a", "kind": "run", "state": "running"})
    ledger.record({"id": "a", "kind": "run", "state": "done", "decision": 0.5})
    ledger.record({"id": "q", "kind": "question", "state": "done", "detail": {"annotates": "a"}})
    assert [(r.experiment_id, r.state) for r in ledger.experiments().collect()] == [("q", "done"), ("a", "done")]
    assert [r.experiment_id for r in ledger.annotations("a").collect()] == ["q"]
    stores.save_run(spark, {"run_id": "r1", "label": "x", "rows": [1]}, str(tmp_path / "r"))
    stores.save_run(spark, {"other": 1}, str(tmp_path / "r"))
    assert [r.run_id for r in stores.list_runs(spark, str(tmp_path / "r")).collect()] == ["r1"]
    assert stores.markdown(spark.range(1)).endswith("| 0 |")


def test_index_cache(spark, tmp_path):
    cache = index.IndexCache(spark, str(tmp_path), keep=1)
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "id int, text string")
    built = []
    make = lambda: built.append(1) or index.build(docs, "id", "text")
    cache.get("f1", "d", make)
    assert cache.get("f1", "d", make).terms.count() == 2 and len(built) == 1
    cache.hold("f1")
    cache.get("f2", "d", make)
    assert "f1" in cache.known
    cache.forget("d")
    assert not cache.known


def test_stream_follows_documents(spark, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb")], "id int, text string")
    docs.write.parquet(source)
    stream = spark.readStream.schema(docs.schema).parquet(source)
    for _ in range(2):  # the second pass finds nothing new
        incremental.follow(stream, "id", "text", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "token", "tf").collect())
    want = sorted(tuple(r) for r in index.build(docs, "id", "text").postings.select("id", "token", "tf").collect())
    assert got == want == [(1, "aa", 2), (1, "bb", 1), (2, "bb", 1)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert incremental.windowed_counts(events, "ts", "k").first().n == 2
