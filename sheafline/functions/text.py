"""Text functions on columns; all of them but nfkc() run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Question words that carry no content, for keyword queries (fixed values, our own choice).
INTERROGATIVES = ("what", "which", "who", "whom", "whose", "when", "where", "why", "how", "does", "did", "do", "is", "are", "was", "were", "the", "of")

#: Frequent short words by language, for detection (fixed values, our own choice).
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit"),
    "es": ("el", "los", "las", "del", "que", "una", "por"),
    "fr": ("le", "les", "des", "et", "est", "pour", "dans"),
    "en": ("the", "and", "of", "to", "is", "with", "for"),
}


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, which Spark has no function for. Texts of ASCII alone keep out of its result."""
    plain = text.rlike(r"^\p{ASCII}*\z")
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))


def normalize(text: Column, compose: bool = False) -> Column:
    """White space collapsed and trimmed, after nfkc() if asked for; null stays null."""
    return F.trim(F.regexp_replace(nfkc(text) if compose else text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least two characters; null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def char_ngrams(text: Column, n: int = 4) -> Column:
    """All sequences of n characters of the normalised lower-case text; a shorter text is its own only one."""
    return ngrams_of(F.lower(normalize(F.coalesce(text, F.lit("")))), n)


def ngrams_of(text: Column, n: int) -> Column:
    """All sequences of n characters; a shorter text is its own only one, an empty one has none. The text is made once, not for each sequence."""

    def cut(t: Column) -> Column:
        size = F.length(t)
        grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(size >= n, grams).when(size > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(text), cut)[0]


def sentences(text: Column) -> Column:
    """Cut after sentence ends that white space follows, and at line ends; trimmed, without empty ones."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?…])\s+|\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def keyword_query(question: Column) -> Column:
    """The question's tokens without interrogatives; the question itself if none is left."""
    kept = F.filter(tokens(question), lambda t: ~t.isin(*INTERROGATIVES))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(question)


def query_variants(question: Column) -> Column:
    """The question, its keywords and its longest words: distinct, in this order."""
    long_words = F.filter(tokens(question), lambda t: F.length(t) >= 6)
    return F.array_distinct(F.array_compact(F.array(question, keyword_query(question), F.when(F.size(long_words) > 0, F.array_join(long_words, " ")))))


def _one_of(listed: tuple[str, ...]):
    return lambda t: t.isin(*listed)


def language(text: Column) -> Column:
    """de, es, fr or en by the most frequent function words; ties in this order; und without any."""
    words = tokens(text)
    found = {lang: F.size(F.filter(words, _one_of(listed))) for lang, listed in FUNCTION_WORDS.items()}
    scored = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(found.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["lang"]).otherwise("und")


def token_overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct tokens that b has; 0 without tokens."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token lists as multisets."""
    common = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))
    )
    total = F.size(a) + F.size(b)
    return F.when((total > 0) & (common > 0), 2.0 * common / total).otherwise(F.lit(0.0))


def grade_lines(reply: Column) -> Column:
    """map<int,double> of lines ``n: score``, scores cut to 0-10 and divided by 10; the first of a number counts."""
    lines = F.regexp_extract_all(reply, F.lit(r"(?m)^\s*\d+\s*:\s*\d+(?:\.\d+)?"), F.lit(0))
    number = lambda s: F.regexp_extract(s, r"(\d+)\s*:", 1).cast("int")
    score = lambda s: F.least(F.lit(10.0), F.regexp_extract(s, r":\s*([\d.]+)", 1).cast("double")) / 10
    pairs = F.transform(lines, lambda s: F.struct(number(s).alias("k"), score(s).alias("v")))
    firsts = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(firsts)


def verdict_json(reply: Column) -> Column:
    """struct<supported:boolean,reason:string> from a reply that may stand in a code fence; null if it is no such JSON."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(body != "", body), "supported boolean, reason string")


def mutate_number(claim: Column, context: Column) -> Column:
    """The claim with its first number raised by the smallest of 1 to 9 that the context does not have; null without."""
    number = F.regexp_extract(claim, r"(\d+)", 1)
    value = F.when(number != "", number).cast("decimal(38,0)")
    others = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: (value + d).cast("string"))
    free = F.filter(others, lambda s: ~F.contains(context, s))
    return F.when(value.isNotNull() & (F.size(free) > 0), F.regexp_replace(claim, r"^(\D*)\d+", F.concat(F.lit("$1"), F.lit(""), F.element_at(free, 1))))


def reads_as_refusal(answer: Column, refusals: tuple[str, ...], markers: tuple[str, ...] = ()) -> Column:
    """Whether an answer declines: it is a refusal itself, or its first sentence holds a marker.

    Markers are for answers that a model words; others decline in fixed words only.
    A marker in a later sentence may be a quotation and does not count.
    """
    said = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    opening = F.coalesce(F.get(sentences(answer), 0), F.lit(""))
    out = said.isin(*refusals)
    for marker in markers:
        out = out | F.contains(opening, F.lit(marker))
    return out


def fact_coverage(reply: Column, n_facts: Column, answer: Column) -> Column:
    """The share of n numbered facts that a judge's lines ``1: yes`` affirm; the last line of a number counts.

    Null without facts, without an answer, or if the reply has no such line.
    """
    line = r"(?i)^\s*(\d+)\s*[:.\-]\s*(yes|no|true|false)"
    lines = F.filter(F.split(F.coalesce(reply, F.lit("")), r"[\r\n]"), lambda s: s.rlike(line))
    said = F.transform(
        lines, lambda s: F.struct(F.regexp_extract(s, line, 1).cast("decimal(38,0)").alias("k"), F.lower(F.regexp_extract(s, line, 2)).isin("yes", "true").alias("yes"))
    )
    last = lambda i: F.element_at(F.filter(said, lambda p: p["k"] == i), -1)["yes"]
    found = F.size(F.filter(F.sequence(F.lit(1), n_facts), lambda i: F.when(F.exists(said, lambda p: p["k"] == i), last(i)).otherwise(False)))
    return F.when((n_facts > 0) & (F.coalesce(answer, F.lit("")) != "") & (F.size(said) > 0), found / n_facts)


def flattened(value: Column, kind: T.DataType) -> Column:
    """A label value as filters compare it: a list joined by blanks, an object as JSON (a map's keys in order), a scalar as itself."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(value.cast("array<string>"), " ", "None")
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
    return F.to_json(value) if isinstance(kind, T.StructType) else value
