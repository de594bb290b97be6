"""Learned decision lists over text statistics, run as Spark expressions.

Statistics of a text are built-in SQL functions on its own row: no shuffle, no
Python. A list is learned by sequential covering (after Cohen's RIPPER): on two
thirds of the labelled rows a conjunction of thresholds grows by the condition of
the largest information gain; on the last third conditions are pruned from its
end; rules are added while they stay precise on the pruning rows. The list becomes
one ordered CASE expression. Learning reads a bounded sample of labelled rows
(``max_rows``, the smallest hashes of their ids); applying it reads every row.

The repeated three-word windows of a text are found within its row: 64-bit
hashes of all windows are sorted together with their positions, so that equal
ones are neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = " \t-\r"

# One array element bound to a name; Catalyst never copies it into the places that use it.
_STATS = f"""
transform(array(coalesce(cast(`{{text}}` as string), '')), t ->
transform(array(array_remove(split(t, '[{_WS}]+'), '')), w ->
transform(array(filter(split(t, '\\n'), l -> l rlike '[^{_WS}]')), n ->
named_struct(
  'n_words', cast(size(w) as bigint),
  'word_chars', cast(length(array_join(w, '')) as bigint),
  'n_symbols', cast(regexp_count(t, '[#*$%&|<>]') as bigint),
  'n_dup_lines', cast(size(n) - size(array_distinct(n)) as bigint),
  'n_lines', cast(size(n) as bigint),
  'n_upper', cast(regexp_count(t, '[A-Z]') as bigint),
  'n_repeat_words', if(size(w) < 3, 0L,
    transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
      transform(array(sort_array(transform(filter(s, (x, i) -> get(s, i - 1).h = x.h or get(s, i + 1).h = x.h), x -> cast(x.i as bigint)))), p ->
        aggregate(p, named_struct('n', 0L, 'end', 0L),
          (a, x) -> named_struct('n', a.n + x + 3 - greatest(a.end, x), 'end', x + 3), a -> a.n))[0])[0]))[0]))
)[0])[0])[0]
"""


def with_statistics(docs: DataFrame, text_column: str = "text", name: str = "stats") -> DataFrame:
    """Adds a struct of counts for every text.

    Words are runs of other than white space (20, 09-0D). n_words; word_chars:
    code points in words; n_symbols: characters of ``#*$%&|<>``; n_lines: lines
    with a word; n_dup_lines: those equal to an earlier one; n_upper: letters A-Z;
    n_repeat_words: words in three-word windows that the text has twice or more.
    A null text counts as empty; every count of an empty text is 0.
    """
    return docs.withColumn(name, F.expr(_STATS.format(text=text_column).replace("\n", " ").replace("'\\n'", "'\\\\n'")))


def base_failed(stats: str = "stats", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Fewer words than min_words, or too many of them in repeated windows."""
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < min_words) | (100 * repeated > max_repeat_percent * n)


#: Names of the measures that rules may test, as expressions of the counts.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


def feature(name: str, stats: str = "stats") -> Column:
    top, bottom = FEATURES[name]
    value = F.col(f"{stats}.{top}").cast("double")
    return value / F.greatest(F.col(f"{stats}.{bottom}"), F.lit(1)).cast("double") if bottom else value


@dataclass(frozen=True)
class Condition:
    """feature >= threshold (above) or feature < threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self, stats: str = "stats") -> Column:
        value = feature(self.feature, stats)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that meets all conditions of one is rejected, any other is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def keeps(self, stats: str = "stats") -> Column:
        """The ordered conditional expression of the list."""
        out = None
        for rule in self.rules:
            met = rule[0].column(stats)
            for condition in rule[1:]:
                met = met & condition.column(stats)
            out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    max_rows: int = 4000,
    min_precision: float = 0.95,
) -> DecisionList:
    """A list that rejects what the labels call 0 and keeps what they call 1.

    The sample is the ``max_rows`` labelled ids of the smallest hash, of whose rows at
    most twice as many are read, those of the smallest hash and measures; rows of null
    label or null id take no part, and of an id labelled twice the smaller label
    counts. With no labels, or labels of one kind, the list is empty: it keeps all.
    """
    chosen = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min(label_column).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # the sample has at most max_rows rows of two numbers: a proven bound for the broadcast
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = with_statistics(sample, "_text").select((F.col("_label") == 0).alias("bad"), F.xxhash64("_id").alias("hash"), *[feature(x).alias(x) for x in FEATURES])
    # rows of the same id could pass the bound: the first 2 * max_rows in order of hash and measures are taken
    rows = sorted(tuple(r) for r in sample.orderBy("hash", "bad", *FEATURES).limit(2 * max_rows).collect())
    if not rows:
        return DecisionList()
    values = np.array([r[2:] for r in rows], dtype=np.float64)
    reject = np.array([bool(r[0]) for r in rows])
    prune = np.array([r[1] % 3 == 0 for r in rows])
    return _cover(values, reject, prune, list(FEATURES), min_precision)


def _cover(values: np.ndarray, reject: np.ndarray, prune: np.ndarray, names: list[str], min_precision: float) -> DecisionList:
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(reject), bool)
    while (reject & left & ~prune).any():
        rule = _grow(values[left & ~prune], reject[left & ~prune], names)
        rule = _prune(rule, values[left & prune], reject[left & prune], names)
        met = _met(rule, values, names) & left
        good = int((met & reject).sum())
        if not rule or good < 3 or good < min_precision * met.sum():
            break
        rules.append(tuple(rule))
        left &= ~met
    return DecisionList(tuple(rules))


def _met(rule: list[Condition], values: np.ndarray, names: list[str]) -> np.ndarray:
    met = np.ones(len(values), bool)
    for c in rule:
        x = values[:, names.index(c.feature)]
        met &= x >= c.threshold if c.above else x < c.threshold
    return met


def _grow(values: np.ndarray, reject: np.ndarray, names: list[str]) -> list[Condition]:
    """Adds the condition of the largest gain until only rows to reject are covered."""
    rule: list[Condition] = []
    met = np.ones(len(reject), bool)
    while (met & ~reject).any() and len(rule) < 4:
        p0, n0 = int((met & reject).sum()), int((met & ~reject).sum())
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            x, y = values[met, j], reject[met]
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            cuts = np.flatnonzero(np.diff(x) > 0)
            if not len(cuts):
                continue
            p_low, size_low = np.cumsum(y)[cuts], cuts + 1
            for above in (True, False):
                p = p0 - p_low if above else p_low
                n = (len(y) - size_low if above else size_low) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    gain, best = float(g[k]), Condition(name, above, float((x[cuts[k]] + x[cuts[k] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        met = _met(rule, values, names)
    return rule


def _prune(rule: list[Condition], values: np.ndarray, reject: np.ndarray, names: list[str]) -> list[Condition]:
    """The beginning of the rule with the largest (p - n) / (p + n) on the pruning rows."""

    def worth(part: list[Condition]) -> float:
        met = _met(part, values, names)
        p, n = int((met & reject).sum()), int((met & ~reject).sum())
        return (p - n) / (p + n) if p + n else -1.0

    parts = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(parts, key=worth) if parts else rule


def apply_list(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """``docs`` with stats, base_failed and kept (false if the base test fails, else the list's verdict).

    A column of the input that has one of these names is replaced.
    """
    out = with_statistics(docs, text_column).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.keeps())
