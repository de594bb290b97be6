"""Imports that are whole or absent, numbers that no two writers share."""

import json
import threading

import pytest

from sheafline.plans.config import fingerprint
from sheafline.sources import datasets
from sheafline.sources.imports import ImportedDatasets, Refused, SequencedLedger, ledger_rows
from sheafline.sources.versions import Conflict, Versions


def corpus(name="shop", text="alpha beta"):
    docs = [{"corpus_document_id": i, "document_content": [{"text": f"{text} {i}", "labels": {"role": "user"}}], "document_metadata": {"day": "2024-01-01"}} for i in (1, 2)]
    return {"corpus_dataset_metadata": {"dataset": name, "name": name, "language": "en", "label_fields": {"role": "{}", "day": "{}"}}, "corpus_documents": docs}


def truth(name="shop", doc=1, behavior="answer", **ref):
    q = {"groundtruth_question_id": 1, "question": "which?", "expected_answer": {"behavior": behavior, "text": "alpha"}, "relevant_corpus_documents": [{"corpus_document_id": doc, "evidence": [{"text": "alpha", "fidelity": "verbatim"}]}]}
    return {"groundtruth_dataset_metadata": {"name": "t", "corpus_ref": {"dataset": name, **ref}}, "groundtruth_dataset": [q]}


def test_imports(spark, tmp_path):
    store = ImportedDatasets(spark, f"{tmp_path}/store", builtin=("diary",))
    own = store.put(corpus(), truth())
    assert own == fingerprint(corpus()) and store.put(corpus(), truth()) == own and len(store.entries()) == 1
    bad = [
        (corpus("diary"), None, "built in"),
        (corpus("") | {"corpus_documents": []}, None, "no dataset"),
        (corpus(), truth("other"), "is of other"),
        (corpus(), truth(file_fingerprint="0" * 16), "another version"),
        (corpus(), truth(doc=9), "cited document is missing"),
        (corpus(), truth(behavior="guess"), "unknown behaviour"),
        (corpus(text="x") | {"corpus_documents": corpus()["corpus_documents"] * 2}, None, "document id twice"),
    ]
    for c, t, word in bad:
        with pytest.raises(Refused, match=word):
            store.put(c, t)
    with pytest.raises(Refused) as told:
        store.put(corpus(), truth(doc=9, behavior="guess"))
    assert len(told.value.problems) == 2
    assert len(store.entries()) == 1 and store.versions.version == 1
    second = store.put(corpus(text="gamma"), truth(file_fingerprint=fingerprint(corpus(text="gamma"))))
    store.put(corpus("other"))
    corpora, truths = store.newest()
    assert {r.dataset for r in corpora.collect()} == {"shop", "other"} and truths.count() == 1
    assert {r.text for r in datasets.documents(corpora.where("dataset = 'shop'")).collect()} == {"gamma 1", "gamma 2"}
    assert json.loads(store.get(own).first().corpus) == corpus() and second != own
    with pytest.raises(KeyError):
        store.get("f" * 16)
    assert ImportedDatasets(spark, f"{tmp_path}/none").newest()[0].count() == 0


def test_two_writers(spark, tmp_path):
    one, two = (Versions(spark, f"{tmp_path}/v") for _ in range(2))
    one.commit({"n": 1})
    with pytest.raises(Conflict):
        two.commit({"n": 2})
    assert two.refresh().told == {"n": 1}
    made = []
    rows = ledger_rows(spark.createDataFrame([('{"id": "x"}', "done")], "value string, state string"))

    def write():
        made.append(SequencedLedger(spark, f"{tmp_path}/ledger").record(rows))

    threads = [threading.Thread(target=write) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [1, 2, 3, 4]
    ledger = SequencedLedger(spark, f"{tmp_path}/ledger")
    assert sorted(r.seq for r in ledger.rows().collect()) == [1, 2, 3, 4] and [r.seq for r in ledger.experiments().collect()] == [4]
    assert SequencedLedger(spark, f"{tmp_path}/empty").experiments().count() == 0


def test_ledger_rows(spark):
    job = {
        "id": "j1", "kind": "run", "provider": "p", "config": {"index": {"dataset": "d", "split_plan": "document", "embedder": "ascii-hash"}, "retrieval": {"retriever": "bm25", "reranker": "none"}, "generation": {"answerer": "extractive"}},
        "result": {"run_id": "r1", "label": "one", "seconds": 1.5, "summary": {"n_questions": 7}, "ragas": {"decision": 0.5, "decision_spread": {"stderr": 0.1}}, "corpus": {"big": 1}, "rows": [1, 2]},
    }
    jobs = [(json.dumps(job), "done"), (json.dumps(job | {"kind": "index", "result": None, "error": "boom"}), "failed"), ("no json", "failed"), (None, None)]
    a, b, c, d = ledger_rows(spark.createDataFrame(jobs, "value string, state string")).collect()
    assert (a.experiment_id, a.label, a.seconds, a.dataset, a.retriever, a.n_questions, a.decision, a.decision_stderr, a.state) == ("r1", "one", 1.5, "d", "bm25", 7, 0.5, 0.1, "done")
    assert set(json.loads(a.detail)) == {"run_id", "label", "seconds", "summary", "ragas", "rows", "config"}
    assert (b.experiment_id, b.retriever, b.embedder, b.error, b.n_questions, b.decision) == ("j1", "", "ascii-hash", "boom", 0, None) and set(json.loads(b.detail)) == {"config"}
    assert c.experiment_id == d.experiment_id == "" and c.n_questions == 0
