"""Quotes looked for in texts: seeds, candidates, exact checks, spans.

A text that holds a run of k of a quote's n characters holds its middle, from n - k to k,
whole; so it has every word that lies inside this middle. The rarest of these words
leads to the candidates, by an equi-join; these alone are searched. Quotes without such a
word are so short that they are sent to all texts, behind a check of their size.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .board import merge_spans
from .index import NAMED_TOKENS
from .saved import saved
from .sizes import small


def collapsed(text: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _run(n: Column, least: float) -> Column:
    """The smallest whole k with k / n >= least."""
    some, k = F.greatest(n, F.lit(1)), F.ceil(n * least)
    # the product may be off by a rounding
    return F.when((k - 1) / some >= least, k - 1).when(k / some >= least, k).otherwise(k + 1).cast("int")


def _near(quote: Column, text: Column, least: float) -> Column:
    """Whether the text holds a run of ``least`` of the quote; both are made once, not for each run."""

    def held(both: Column) -> Column:
        n, k = F.length(both["q"]), _run(F.length(both["q"]), least)
        return (F.length(both["t"]) >= k) & F.exists(F.sequence(F.lit(1), n - k + 1), lambda i: F.contains(both["t"], F.substring(both["q"], i, k)))

    return F.transform(F.array(F.struct(quote.alias("q"), text.alias("t"))), held)[0]


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(text, " "))


def candidates(quotes: DataFrame, texts: DataFrame, least: float = 1.0) -> DataFrame:
    """(quote_id, id): every pair that can match, and others; quotes (quote_id, q), texts (id, t), both collapsed."""
    n = F.length("q")
    k = _run(n, least)
    cored = quotes.where("q <> ''").select("quote_id", F.substring("q", n - k + 1, 2 * k - n).alias("core"))
    # words that begin and end inside the middle
    inner = F.filter(F.slice(F.split("core", " "), 2, F.greatest(F.size(F.split("core", " ")) - 2, F.lit(0))), lambda w: w != "")
    seeded = cored.select("quote_id", F.array_distinct(inner).alias("seeds"))
    seeds = seeded.select("quote_id", F.explode("seeds").alias("word"))
    held = saved(_holding(texts, seeds.select("word").distinct()), "words")  # the texts are read once
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    # a quote of which some word is in no text is in none
    rated = seeds.join(counts, "word", "left")
    rarest = rated.groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0").select("quote_id", "r.word")
    found = held.join(small(saved(rarest, "rarest")), "word").select("quote_id", "id")
    bare = small(seeded.where(F.size("seeds") == 0).select("quote_id").join(cored, "quote_id").select("quote_id", "core"))
    scanned = texts.join(bare, F.contains("t", "core")).select("quote_id", "id")
    return saved(found.unionByName(scanned), "candidates")


def _holding(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word): the words (word) that a text (id, t) has, each once."""
    names = [r.word for r in words.limit(NAMED_TOKENS + 1).collect()]
    if len(names) > NAMED_TOKENS:
        return texts.select("id", F.explode(_words(F.col("t"))).alias("word")).join(small(words), "word", "left_semi")
    known = pa.array(names, pa.string())

    def run(batches):
        for batch in batches:
            words = batch.column("words")
            at = pc.indices_nonzero(pc.is_in(words.flatten(), known))
            row = pc.list_parent_indices(words).take(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), words.flatten().take(at)], ["id", "word"])

    return texts.select("id", _words(F.col("t")).alias("words")).mapInArrow(run, f"id {dict(texts.dtypes)['id']}, word string")


def find_quotes(quotes: DataFrame, texts: DataFrame, least: float = 0.9) -> DataFrame:
    """(quote_id, id, exact): the texts that hold a quote, or a run of at least ``least`` of its characters.

    quotes: quote_id, quote; texts: id, text. White space is collapsed on both sides first; empty quotes are
    in no text. Ids are unique.
    """
    asked = quotes.select("quote_id", collapsed(F.col("quote")).alias("q"))
    told = texts.select("id", collapsed(F.col("text")).alias("t")).where("t <> ''")
    pairs = candidates(asked, told, least)
    both = told.join(small(pairs), "id").join(small(asked), "quote_id")
    exact = F.contains("t", "q")
    near = _near(F.col("q"), F.col("t"), least)
    return both.withColumn("exact", exact).where(F.col("exact") | near if least < 1 else F.col("exact")).select("quote_id", "id", "exact")


def gold_pairs(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(qid, doc): documents that contain a quote or are contained in it, after white space is collapsed; empty texts mark nothing.

    docs: (doc, text); quotes: (qid, quote).
    """
    asked = quotes.select("qid", collapsed(F.col("quote")).alias("q")).where("q <> ''")
    told = docs.select(F.col("doc").alias("id"), collapsed(F.col("text")).alias("t")).where("t <> ''")
    one = asked.groupBy("q").agg(F.collect_set("qid").alias("qids"))  # questions with one quote
    named = saved(one.select(F.sha2("q", 256).alias("quote_id"), "q", "qids"), "quotes")
    down = candidates(named.select("quote_id", "q"), told)
    rows = told.join(small(down), "id").join(small(named), "quote_id").where(F.contains("t", "q")).select(F.explode("qids").alias("qid"), F.col("id").alias("doc"))
    # the other way only for texts that are no longer than the longest quote
    longest = asked.agg(F.max(F.length("q")).alias("m")).first().m or 0
    short = told.where(F.length("t") <= longest)
    # all words inside a text that a quote contains are words of quotes
    names = asked.select(F.explode(_words(F.col("q"))).alias("word")).distinct()
    inner = short.select("id", F.explode(F.array_distinct(F.slice(F.split("t", " "), 2, F.greatest(F.size(F.split("t", " ")) - 2, F.lit(0))))).alias("word"))
    strange = inner.join(small(saved(names, "names")), "word", "left_anti").select("id").distinct()
    short = saved(short.join(strange, "id", "left_anti"), "short")
    up = candidates(short.select(F.col("id").alias("quote_id"), F.col("t").alias("q")), named.select(F.col("quote_id").alias("id"), F.col("q").alias("t")))
    up = short.join(small(up.withColumnRenamed("id", "holder").withColumnRenamed("quote_id", "id")), "id").join(small(named.withColumnRenamed("quote_id", "holder")), "holder")
    up = up.where(F.contains("q", "t")).select(F.explode("qids").alias("qid"), F.col("id").alias("doc"))
    return rows.unionByName(up).distinct()


def spans(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, start, end long): where quotes stand in a text, in characters as written, overlapping and touching ones as one; end exclusive.

    quotes: quote_id, quote; texts: id, text. Here white space is not collapsed: a span marks just these characters. A quote of
    white space alone marks nothing.
    """
    pairs = candidates(quotes.select("quote_id", collapsed(F.col("quote")).alias("q")), texts.select("id", collapsed(F.col("text")).alias("t")).where("t <> ''"))
    both = texts.join(small(pairs.distinct()), "id").join(small(quotes.where("quote <> ''").select("quote_id", "quote")), "quote_id").where(F.contains("text", "quote"))
    kind = dict(texts.dtypes)["id"]

    def find(batches):
        for batch in batches:
            at, starts, ends = [], [], []
            for i, (text, quote) in enumerate(zip(batch.column("text").to_pylist(), batch.column("quote").to_pylist(), strict=True)):
                place = text.find(quote)
                while place >= 0:
                    at.append(i)
                    starts.append(place)
                    ends.append(place + len(quote))
                    place = text.find(quote, place + 1)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start", "end"])

    found = both.select("id", "text", "quote").mapInArrow(find, f"id {kind}, start long, end long")
    return merge_spans(found, ["id"])


def text_recall(quotes: DataFrame, contexts: DataFrame, least: float = 0.9) -> DataFrame:
    """(qid, quote_recall): the share of a question's verbatim quotes that its contexts hold, whole or a run of ``least``; null without any.

    quotes: qid, quote, fidelity; contexts: qid, rank, text. The contexts of a question are read as one text, joined by
    blanks; quotes that are not ``verbatim`` are not asked for. Every question of either table has a row.
    """
    # at most the k contexts of a question come together
    held = contexts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("text"))
    asked = quotes.where("fidelity = 'verbatim'").select("qid", collapsed(F.col("quote")).alias("q")).where("q <> ''")
    both = asked.join(held, "qid", "left").withColumn("t", collapsed(F.col("text")))
    hit = F.contains("t", "q") | ((F.length("t") >= F.length("q")) & _near(F.col("q"), F.col("t"), least))
    told = both.groupBy("qid").agg(F.round(F.avg(hit.cast("double")), 6).alias("quote_recall"))
    return quotes.select("qid").unionByName(contexts.select("qid")).distinct().join(told, "qid", "left")
