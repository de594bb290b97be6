"""Corpora and ground truths: files, their pairing, checks and catalogue.

A corpus file is one JSON object with corpus_dataset_metadata and corpus_documents;
a ground-truth file one with groundtruth_dataset_metadata and groundtruth_dataset.
Files are read whole, one row each; labels stay JSON text, as their names are data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = """corpus_dataset_metadata struct<dataset:string,name:string,language:string,label_fields:map<string,string>>,
corpus_documents array<struct<corpus_document_id:bigint,document_content:array<struct<text:string,labels:map<string,string>>>,document_metadata:map<string,string>>>"""
TRUTH_SCHEMA = """groundtruth_dataset_metadata struct<name:string,corpus_ref:struct<dataset:string,file_fingerprint:string>,language:string>,
groundtruth_dataset array<struct<groundtruth_question_id:bigint,question:string,
  expected_answer:struct<behavior:string,text:string,derived_facts:array<struct<derived_fact_id:bigint,fact:string>>>,
  relevant_corpus_documents:array<struct<corpus_document_id:bigint,evidence:array<struct<text:string,fidelity:string,role:string,supports:array<bigint>>>>>,question_metadata:map<string,string>>>"""
BEHAVIORS = ("answer", "abstain", "correct_premise")
FIDELITIES = ("verbatim", "paraphrase", "computed")


def _read(spark: SparkSession, folder: str, schema: str, body: str) -> DataFrame:
    raw = spark.read.text(folder, wholetext=True).withColumn("file", F.input_file_name())
    told = raw.select("file", F.from_json("value", schema).alias("d"))
    return told.where(f"d.{body} is not null").select("file", "d.*")  # other and unreadable files are passed over


def read_corpora(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The corpora of the folders: file, source (the folder's place), metadata, documents; of one dataset the later folder's."""
    from ..operators.board import latest

    rows = None
    for n, folder in enumerate(folders):
        part = _read(spark, folder, CORPUS_SCHEMA, "corpus_documents").withColumn("source", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("dataset", F.col("corpus_dataset_metadata.dataset"))
    return latest(rows, ["dataset"], [F.desc("source"), F.asc("file")])


def read_truths(spark: SparkSession, folders: list[str]) -> DataFrame:
    rows = None
    for folder in folders:
        part = _read(spark, folder, TRUTH_SCHEMA, "groundtruth_dataset")
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("dataset", F.col("groundtruth_dataset_metadata.corpus_ref.dataset"))


def pair(corpora: DataFrame, truths: DataFrame) -> DataFrame:
    """Each corpus with the ground truth that names its dataset, or with none."""
    return corpora.join(truths.select("dataset", F.col("file").alias("truth_file"), "groundtruth_dataset"), "dataset", "left")


def documents(corpora: DataFrame) -> DataFrame:
    """(dataset, doc_id, part_idx, text, labels, metadata): one row for each part."""
    docs = corpora.select("dataset", F.explode("corpus_documents").alias("d"))
    parts = docs.select("dataset", F.col("d.corpus_document_id").alias("doc_id"), F.col("d.document_metadata").alias("metadata"), F.posexplode("d.document_content").alias("part_idx", "p"))
    return parts.select("dataset", "doc_id", "part_idx", "p.text", "p.labels", "metadata")


def questions(truths: DataFrame) -> DataFrame:
    rows = truths.select("dataset", F.explode("groundtruth_dataset").alias("q"))
    return rows.select("dataset", F.col("q.groundtruth_question_id").alias("qid"), "q.question", F.col("q.expected_answer.behavior").alias("behavior"), F.col("q.question_metadata").alias("labels"))


def evidence(truths: DataFrame) -> DataFrame:
    """(dataset, qid, doc_id, ord, text, fidelity, role, supports)"""
    rows = truths.select("dataset", F.explode("groundtruth_dataset").alias("q")).select("dataset", F.col("q.groundtruth_question_id").alias("qid"), F.explode("q.relevant_corpus_documents").alias("r"))
    return rows.select("dataset", "qid", F.col("r.corpus_document_id").alias("doc_id"), F.posexplode("r.evidence").alias("ord", "e")).select("dataset", "qid", "doc_id", "ord", "e.*")


def facts(truths: DataFrame) -> DataFrame:
    rows = truths.select("dataset", F.explode("groundtruth_dataset").alias("q"))
    return rows.select("dataset", F.col("q.groundtruth_question_id").alias("qid"), F.explode("q.expected_answer.derived_facts").alias("f")).select("dataset", "qid", "f.*")


def catalogue(parts: DataFrame, asked: DataFrame, day: str = "") -> DataFrame:
    """Per dataset: documents, parts, questions, label names and, of a date label, the first and last day."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(F.coalesce("labels", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))))))
    days = [f(F.element_at("metadata", day)).alias(n) for f, n in ((F.min, "first_day"), (F.max, "last_day"))] if day else []
    told = parts.groupBy("dataset").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_parts"), names.alias("labels"), *days)
    return told.join(asked.groupBy("dataset").agg(F.count("*").alias("n_questions")), "dataset", "left").fillna(0, ["n_questions"])


def problems(corpora: DataFrame, truths: DataFrame) -> DataFrame:
    """(dataset, rule, place): every violation of the contract, all rules at once."""
    parts, asked, shown, told = documents(corpora), questions(truths), evidence(truths), facts(truths)

    def rows(found: DataFrame, rule: str, place) -> DataFrame:
        return found.select("dataset", F.lit(rule).alias("rule"), place.cast("string").alias("place"))

    ids = parts.select("dataset", "doc_id").distinct()
    all_docs = corpora.select("dataset", F.explode("corpus_documents.corpus_document_id").alias("doc_id"))
    declared = corpora.select("dataset", F.explode(F.map_keys("corpus_dataset_metadata.label_fields")).alias("name")).distinct()
    used = parts.select("dataset", F.explode(F.map_keys("labels")).alias("name")).unionByName(parts.select("dataset", F.explode(F.map_keys("metadata")).alias("name"))).distinct()
    out = [
        rows(all_docs.where("doc_id is null or doc_id < 1"), "document id below 1", F.col("doc_id")),
        rows(all_docs.groupBy("dataset", "doc_id").count().where("count > 1"), "document id twice", F.col("doc_id")),
        rows(parts.where("text is null or text = ''"), "empty part", F.concat_ws(":", "doc_id", "part_idx")),
        rows(used.join(declared, ["dataset", "name"], "left_anti"), "label not declared", F.col("name")),
        rows(asked.groupBy("dataset", "qid").count().where("count > 1"), "question id twice", F.col("qid")),
        rows(asked.where(~F.coalesce(F.col("behavior").isin(*BEHAVIORS), F.lit(False))), "unknown behaviour", F.col("qid")),
        rows(asked.where("question is null or trim(question) = ''"), "empty question", F.col("qid")),
        rows(shown.join(ids, ["dataset", "doc_id"], "left_anti"), "cited document is missing", F.concat_ws(":", "qid", "doc_id")),
        rows(shown.where(~F.coalesce(F.col("fidelity").isin(*FIDELITIES), F.lit(False))), "unknown fidelity", F.concat_ws(":", "qid", "doc_id", "ord")),
        rows(asked.where("behavior = 'answer'").join(shown.select("dataset", "qid").distinct(), ["dataset", "qid"], "left_anti"), "answer without evidence", F.col("qid")),
        rows(
            shown.select("dataset", "qid", F.explode("supports").alias("derived_fact_id")).join(told.select("dataset", "qid", "derived_fact_id"), ["dataset", "qid", "derived_fact_id"], "left_anti"),
            "supported fact is missing", F.concat_ws(":", "qid", "derived_fact_id"),
        ),
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown pages with front matter: key, summary, body."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").withColumn("file", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    name = F.regexp_extract(head, r"(?m)^name:\s*(.+)$", 1)
    return raw.select(
        F.when(name != "", name).otherwise(F.regexp_extract("file", r"([^/]+)\.md$", 1)).alias("key"),
        F.regexp_extract(head, r"(?m)^description:\s*(.+)$", 1).alias("summary"),
        F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"),
    )
