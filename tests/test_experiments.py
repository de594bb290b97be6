from pyspark.sql import functions as F

from sheafline.operators import experiments, index
from sheafline.plans.config import RetrievalConfig


def test_runs_and_sweeps(spark):
    docs = spark.createDataFrame([(1, "the red apple grows"), (2, "a blue whale swims"), (3, "green leaves in spring 12")], "id long, text string")
    asked = spark.createDataFrame([(10, "red apple"), (11, "blue whale"), (12, "quantum zebra")], "qid long, question string")
    gold = spark.createDataFrame([(10, 1), (11, 2)], "qid long, doc long")
    corpus = experiments.Corpus(docs, index.build(docs, "id", "text"))
    config = RetrievalConfig(k=1, grade_threshold=0.5)
    rows = experiments.evaluate(experiments.retrieve_all(corpus, asked, config), gold, asked, 1)
    told = experiments.summary(rows).first()
    assert (told.n, told.recall, told.mrr, told.false_abstention, told.abstained_correctly) == (3, 1.0, 1.0, 0.0, 1.0)
    scores, word = experiments.sweep(corpus, asked, gold, {"one": config, "two": RetrievalConfig(k=1, retriever="bm25", reranker="none")})
    assert scores.count() == 2 and word.first().verdict == "tie"
    screen = experiments.judge_screen(spark.createDataFrame([(1, "it took 3 days")], "qid int, claim string"), spark.createDataFrame([(1, "3 or 4")], "qid int, context string"))
    assert {(r.claim, r.supported) for r in screen.select("claim", "supported").collect()} == {("it took 3 days", True), ("it took 5 days", False)}
