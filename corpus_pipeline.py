"""The corpus pipeline: documents filtered, cleaned and packed, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheafline.llm import packing, quality_rules, secret_scan
from sheafline.llm.blocks import Membership
from sheafline.llm.components import Scratch
from sheafline.llm.jaccard_join import jaccard_components
from sheafline.llm.substring_dedup import remove_repeats

#: Words of a passage that is removed where it repeats.
PASSAGE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decision list, learned from the quality labels, keeps.

    A null or empty text has no words and goes, as do all of fewer than 50. Repeated
    rows are judged alike and each stays or goes; columns of any name come back as
    they are; an empty table stays empty; without labels only the base tests decide.
    """
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply_list(_apart(docs), rules).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 of five-word shingles connect, that of the smallest id.

    Of rows of one id that with the smallest text stays (null first), of equal texts
    that whose row is first as JSON; rows without an id stay. Documents without
    words are linked with nothing and stay. Columns of any name come back as they
    are; an empty table stays empty.
    """
    classes = jaccard_components(docs, n=5, threshold=(4, 5))
    # ids that go, and ids that occur more than once; all other documents stay where they are
    judged = classes.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("first"), F.count("*").alias("many"))
    odd = Scratch(spark, "classes").save(judged.where("id <> first or many > 1").select("id", (F.col("id") == F.col("first")).alias("stays")))
    doubtful, sure = Membership(odd, "id").split(_apart(docs).select("id", "row"), "id")
    same = W.partitionBy("id").orderBy(F.col("row.text").asc_nulls_first(), F.to_json("row"))
    doubtful = doubtful.join(odd, "id", "left").where("coalesce(stays, true)").withColumn("place", F.row_number().over(same)).where("place = 1")
    return sure.select("row.*").unionByName(doubtful.select("row.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier place has; emptied ones stay, with no text.

    Earlier is a smaller id, or an earlier start in one document. A text from which
    nothing goes stays as it is, a null one null; of the others the words that stay are
    joined by blanks. Columns of any name come back as they are, but n_chars, which
    follows the text; an empty table stays empty.
    """
    out = remove_repeats(docs, size=PASSAGE_WORDS, keep_untouched=True)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = out.select("doc_id", F.col("kept_text").alias("text"), *[F.col(f"rest.`{c}`") for c in rest])
    return _counted(out).select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark, overlapping ones as one.

    A null text stays null, a text without secrets as it is. Repeated rows are each
    cleaned; columns of any name come back as they are, but n_chars, which follows
    the text; an empty table stays empty.
    """
    out = secret_scan.redact(_apart(docs))
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return _counted(out.select(*columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens.

    A null or empty text is one piece, the end token alone. Repeated rows have a place
    each; other columns are left out; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


def _apart(docs: DataFrame) -> DataFrame:
    """id, text, and the whole row as a struct, so that no name of its columns meets one of an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: A learned list decides in the first stage, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    scratch.retain(docs)
    return docs
