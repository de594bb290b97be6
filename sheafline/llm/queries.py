"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, filter_audit, langid, packing, panes, quality_rules, secret_scan, token_output, topk, warc
from .oracles import ORACLES as ORACLES
from .components import Scratch
from .jaccard_join import jaccard_components
from .substring_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, as digests of their spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = len(secret_scan.BASE_RULES)
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.digest_text("secrets", base), 256).alias("base_sha256"),
        secret_scan.digest_text("secrets").alias("spans"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rendered from an event log, digested as read back from the output."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"select -1L as conv_id, t.turn, t.role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    messages = chat.fold(chat.events_of_turns(turns.unionByName(extra)))
    back = chat.read_back(chat.render(messages))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    piece = F.struct(F.col("piece"), told.alias("told"), F.array_join("learned", "").alias("learned"))
    whole = back.groupBy("conv_id").agg(
        F.sum(F.size("turns").cast("long")).alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(piece)).alias("p")
    )
    learned = F.array_join(F.transform("p", lambda x: x["learned"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("p", lambda x: x["told"]), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.9 of their three-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, threshold=(9, 10))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back."""
    path = Scratch(spark, "warc").path()
    warc.write(warc.records_of_pages(table(spark, sf_dir, "pages")), path)
    records = warc.read(spark, path)
    own = F.col("record_type") == "response"
    return records.select(
        warc.page_number("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier too are removed from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, size=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of a decision list learned from the quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.apply_list(docs, rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"stats.{c}") for c in counts], "base_failed", "kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.round_trip(docs, *vocabulary)
    return out.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to compressed files in the shared folder and read back."""
    folder = Scratch(spark, "token-ids").path()
    token_output.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    told = token_output.read(spark, folder)
    return told.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panes of clicks in eight batches: emissions, revisions and late rows."""
    return panes.click_panes(table(spark, sf_dir, "clicks"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in every order, by language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit_documents(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_topk": op3_exact_topk,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_output": op11_token_output,
    "op12_window_panes": op12_window_panes,
    "op13_filter_audit": op13_filter_audit,
}
