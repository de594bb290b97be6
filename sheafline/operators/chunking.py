"""Cutting documents into chunks.

A document is a list of parts: rows (doc_id, part_idx, text, ...). What SQL states,
runs as SQL; cutting by budgets is sequential within a text and runs on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot


def join_parts(parts: DataFrame, join: str = "\n", prefix: str = "") -> DataFrame:
    """(doc_id, text): a document's parts in order, each with its label ``prefix`` before it if asked for."""
    line = F.concat(F.col(prefix), F.lit(": "), F.col("text")) if prefix else F.col("text")
    rows = parts.select("doc_id", F.struct("part_idx", line.alias("line")).alias("p"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["line"]), join).alias("text"))


def part_chunks(parts: DataFrame) -> DataFrame:
    """One chunk for each part: doc_id, chunk_idx, part_start, part_end, text."""
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("part_idx")) - 1
    return parts.select("doc_id", idx.alias("chunk_idx"), F.col("part_idx").alias("part_start"), F.col("part_idx").alias("part_end"), "text")


def label_chunks(parts: DataFrame, opens: Column, join: str = "\n") -> DataFrame:
    """A new chunk opens at every part for which ``opens`` holds; the first part opens one in any case."""
    w = W.partitionBy("doc_id").orderBy("part_idx")
    first = F.row_number().over(w) == 1
    group = F.sum(F.when(first | F.coalesce(opens, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    rows = parts.withColumn("chunk_idx", group)
    merged = rows.groupBy("doc_id", "chunk_idx").agg(
        F.min("part_idx").alias("part_start"), F.max("part_idx").alias("part_end"), F.array_sort(F.collect_list(F.struct("part_idx", "text"))).alias("p")
    )
    return merged.select("doc_id", "chunk_idx", "part_start", "part_end", F.array_join(F.transform("p", lambda x: x["text"]), join).alias("text"))


def separator_chunks(docs: DataFrame, separators: list[str]) -> DataFrame:
    """Texts cut at any of the literals, the longest first; trimmed, without empty ones: doc_id, chunk_idx, text."""
    pattern = "|".join(r"\Q" + s + r"\E" for s in sorted(separators, key=len, reverse=True))
    pieces = F.filter(F.transform(F.split("text", pattern, -1), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk_idx", "text"))


def pack_words(text: str, size: int) -> list[str]:
    """Words taken in order as long as they fit; a longer word stands alone."""
    out: list[str] = []
    line = ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > size:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*out, line] if line else out


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of as many whole words as fit into ``size`` characters; each begins about ``size - overlap`` behind the one before.

    The next one begins with the first word that ends no more than one character before that
    place or later, but behind the first word of this window and no later than its last. An overlap of the size or
    more counts as half of it; a longer word stands alone.
    """
    overlap = size // 2 if overlap >= size else overlap
    step = max(1, size - overlap)
    words = text.split()
    ends = np.cumsum([len(w) + 1 for w in words])
    out, start = [], 0
    while start < len(words):
        base = ends[start] - len(words[start]) - 1
        stop = max(start + 1, int(np.searchsorted(ends, base + size + 1, side="right")))
        out.append(" ".join(words[start:stop]))
        if stop >= len(words):
            break
        start = max(start + 1, min(stop - 1, int(np.searchsorted(ends, base + step))))
    return out


def _cut(docs: DataFrame, cutter) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, at, texts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                pieces = cutter(text or "")
                ids += [i] * len(pieces)
                at += range(len(pieces))
                texts += pieces
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "chunk_idx", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_idx int, text string")


def budget_chunks(docs: DataFrame, size: int = 500) -> DataFrame:
    return _cut(docs, lambda t: pack_words(t, size))


def window_chunks(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    return _cut(docs, lambda t: windows(t, size, overlap))


def drift_chunks(parts: DataFrame, budget: int = 500, quantile: float = 0.35) -> DataFrame:
    """Consecutive parts whose vectors drift apart are cut from each other: doc_id, chunk_idx, part_start, part_end, text.

    parts: doc_id, part_idx, text, vec (unit length). A cut falls before a part whose
    similarity to the one before is at most the document's quantile, or where the chunk
    would grow beyond twice the budget. Documents of up to two parts stay whole.
    """
    w = W.partitionBy("doc_id").orderBy("part_idx")
    rows = parts.withColumn("sim", dot(F.lag("vec").over(w), F.col("vec")))
    docs = rows.groupBy("doc_id").agg(
        F.percentile("sim", quantile).alias("edge"), F.array_sort(F.collect_list(F.struct("part_idx", "text", "sim"))).alias("p")
    )
    # one fold over a document's parts gives each its chunk
    numbered = F.expr(f"""aggregate(p, named_struct('n', -1, 'size', 0, 'o', cast(array() as array<int>)), (a, x) ->
      if(size(a.o) = 0 or (size(p) > 2 and (x.sim <= edge or a.size + length(x.text) > {2 * budget})),
        named_struct('n', a.n + 1, 'size', length(x.text), 'o', concat(a.o, array(a.n + 1))),
        named_struct('n', a.n, 'size', a.size + length(x.text), 'o', concat(a.o, array(a.n)))), a -> a.o)""")
    each = docs.withColumn("n", numbered).select("doc_id", F.inline(F.arrays_zip("p", "n"))).select("doc_id", F.col("n").alias("chunk_idx"), "p.part_idx", "p.text")
    merged = each.groupBy("doc_id", "chunk_idx").agg(
        F.min("part_idx").alias("part_start"), F.max("part_idx").alias("part_end"), F.array_sort(F.collect_list(F.struct("part_idx", "text"))).alias("p")
    )
    return merged.select("doc_id", "chunk_idx", "part_start", "part_end", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def contextual_prefix(labels: list[tuple[str, Column]]) -> Column:
    """``[name: value | ...]`` and a line end, of the labels that are present, in this order; empty without any."""
    parts = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in labels]
    body = F.concat_ws(" | ", *parts)
    return F.when(body != "", F.concat(F.lit("["), body, F.lit("]\n"))).otherwise(F.lit(""))


def importance(value: Column, low: float, high: float) -> Column:
    """A rank label scaled to 0-1, cut and rounded; 0 without one."""
    scaled = (value.cast("double") - low) / (high - low) if high > low else F.lit(0.0)
    # greatest and least pass nulls over, so a missing label is told apart first
    return F.when(value.isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), 3))


def label_flow(parts: DataFrame, chunks: DataFrame, label: str) -> DataFrame:
    """(doc_id, chunk_idx, values): the distinct values of a part label over each chunk's span, in order."""
    spans = chunks.select("doc_id", "chunk_idx", "part_start", "part_end")
    rows = parts.select("doc_id", "part_idx", F.col(label).alias("value")).join(spans, "doc_id").where("part_idx between part_start and part_end and value is not null")
    return rows.groupBy("doc_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("part_idx", "value"))).alias("p")).select(
        "doc_id", "chunk_idx", F.array_distinct(F.transform("p", lambda x: x["value"])).alias("values")
    )


def neighbours(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, before, after): the chunks next to each one in its document."""
    w = W.partitionBy("doc_id").orderBy("chunk_idx")
    return chunks.select("doc_id", "chunk_idx", F.lag("chunk_idx").over(w).alias("before"), F.lead("chunk_idx").over(w).alias("after"))
