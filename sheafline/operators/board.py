"""Runs, ledgers and leaderboards; samples of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of every key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_board(runs: DataFrame, ledger: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Runs and ledger rows by id, each once; on what both know the run counts. Adds source: both, run, ledger."""
    r = runs.select(key, *[F.col(c).alias(f"r_{c}") for c in shared], F.lit(1).alias("_r"))
    x = ledger.select(key, *[F.col(c).alias(f"l_{c}") for c in shared], F.lit(1).alias("_l"))
    both = r.join(x, key, "full_outer")
    source = F.when(F.col("_r").isNotNull() & F.col("_l").isNotNull(), "both").when(F.col("_r").isNotNull(), "run").otherwise("ledger")
    return both.select(key, *[F.coalesce(f"r_{c}", f"l_{c}").alias(c) for c in shared], source.alias("source"))


def by_dataset(board: DataFrame) -> DataFrame:
    """(dataset, n_runs, newest, best): per dataset the number of rows, the latest start and the best decision."""
    return board.groupBy("dataset").agg(F.count("*").alias("n_runs"), F.max("started_at").alias("newest"), F.max("decision").alias("best"))


def comparability(rows: DataFrame, run: str, question: str, same: list[str]) -> DataFrame:
    """(group_key, n_runs, runs): runs over the same questions under the same other conditions.

    The questions of a run are reduced to a digest of their sorted ids.
    """
    per = rows.groupBy(run, *same).agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.col(question).cast("string"))), ",")).alias("questions"))
    return per.groupBy(*same, "questions").agg(F.count("*").alias("n_runs"), F.array_sort(F.collect_list(run)).alias("runs"))


def stride_sample(rows: DataFrame, order: list[str], limit: int, total: int) -> DataFrame:
    """Every (total / limit)-th row in order: those at floor(i * total / limit).

    The order of all rows is a range partitioning; ranks are counts before a
    partition plus places within it, so no task sees all rows.
    """
    if total <= limit:
        return rows
    numbered = global_rank(rows, order, "_rank")
    i = F.floor((F.col("_rank") * limit + total - 1) / total)
    return numbered.where((F.floor(i * total / F.lit(limit)) == F.col("_rank")) & (i < limit)).drop("_rank")


#: Rows of a range of global_rank(), about; ranges that it cuts an order into at most, and keys drawn for each to place their bounds.
RANGE_ROWS, MOST_RANGES, DRAWN_EACH = 500_000, 4096, 20


def global_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in order, without one window over all.

    Ranges of the order are bounded by keys drawn by their hash, the same in every
    run, so a row's range follows from its own columns: however often the plan is
    run, and by which tasks, the ranks agree. Rows of equal keys are in one range.
    The number of ranges follows that of the rows; a row finds its own by bisection.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(partitions, -(-rows.count() // RANGE_ROWS)), MOST_RANGES)
    keys = rows.select(*order)
    drawn = keys.orderBy(F.xxhash64(*order), *order).limit(DRAWN_EACH * ranges).orderBy(*order).collect()  # a bounded number of keys
    picked = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if drawn else []
    bounds = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, keys.schema, strict=True)]) for x in picked])
    at = _place(bounds, len(picked), F.struct(*order)) if picked else F.lit(0)
    dealt = rows.withColumn("_range", at)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", F.coalesce(F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def _place(bounds: Column, many: int, value: Column) -> Column:
    """How many of the ascending bounds lie below a value, by bisection."""

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        open_, above = s["a"] < s["b"], value > F.get(bounds, middle)
        return F.struct(F.when(open_ & above, middle + 1).otherwise(s["a"]).alias("a"), F.when(open_ & ~above, middle).otherwise(s["b"]).alias("b"))

    start = F.struct(F.lit(0).alias("a"), F.lit(many).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(many.bit_length())), start, half)["a"]


def balanced_sample(rows: DataFrame, band: str, order: list[str], limit: int) -> DataFrame:
    """About limit rows, dealt to the bands one by one, a remainder to the earlier ones; within a band by strides."""
    counts = {r[band]: r["n"] for r in rows.groupBy(band).agg(F.count("*").alias("n")).collect()}  # one row for each band
    quota = dict.fromkeys(sorted(counts, key=str), 0)
    left = min(limit, sum(counts.values()))
    while left:
        for b in quota:
            if left and quota[b] < counts[b]:
                quota[b] += 1
                left -= 1
    n = F.row_number().over(W.partitionBy(band).orderBy(*order)) - 1
    out = rows.withColumn("_n", n)
    keep = F.lit(False)
    for b, q in quota.items():
        if q:
            i = F.floor((F.col("_n") * q + counts[b] - 1) / counts[b])
            same = F.col(band).eqNullSafe(F.lit(b))
            keep = keep | (same & (F.floor(i * counts[b] / F.lit(q)) == F.col("_n")) & (i < q))
    return out.where(keep).drop("_n")


def dangling(refs: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """References to ids that are not there."""
    return refs.join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def rates(rows: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    """Per label the count and the mean of every measure, nulls left out."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in measures.items()])


def screen_score(judged: DataFrame) -> DataFrame:
    """One row for each judge: accuracy, recall of both classes, failures, and whether all verdicts are the same.

    judged: judge, supported (the truth), verdict (null: no answer in the form asked for).
    """
    right = (F.col("supported") == F.col("verdict")).cast("double")
    return judged.groupBy("judge").agg(
        F.round(F.avg(F.coalesce(right, F.lit(0.0))), 6).alias("accuracy"),
        F.round(F.avg(F.when(F.col("supported"), F.coalesce(right, F.lit(0.0)))), 6).alias("recall_true"),
        F.round(F.avg(F.when(~F.col("supported"), F.coalesce(right, F.lit(0.0)))), 6).alias("recall_false"),
        F.sum(F.col("verdict").isNull().cast("long")).alias("failures"),
        (F.count_distinct("verdict") < 2).alias("degenerate"),
    )


def merge_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping or touching (start, end) of a key as one."""
    w = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def search_pages(pages: DataFrame, words: list[str], weights: dict[str, int], key: str, limit: int = 8) -> DataFrame:
    """A catalogue's pages by the weighted columns that hold each word; ties by key."""
    score = F.lit(0)
    for c, weight in weights.items():
        for word in words:
            score = score + F.when(F.contains(F.lower(F.col(c)), F.lit(word.lower())), weight).otherwise(0)
    return pages.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def history_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The latest turns of each conversation whose texts together stay within the budget."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")).rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= budget)


def lexical_signal(items: DataFrame) -> DataFrame:
    """One row: mean overlap of supported and of unsupported items, their difference, and whether a judge could not tell by it.

    items: supported, overlap. Blind is a difference of at most 0.03; without one of the classes there is none.
    """
    mean = lambda c: F.round(F.avg(F.when(c, F.col("overlap"))), 3)
    told = items.agg(mean(F.col("supported")).alias("supported"), mean(~F.col("supported")).alias("unsupported"))
    told = told.withColumn("difference", F.round(F.col("supported") - F.col("unsupported"), 3))
    return told.withColumn("blind", F.coalesce(F.abs("difference") <= 0.03, F.lit(False)))


def with_labels(questions: DataFrame, labels: dict[str, list]) -> DataFrame:
    """Questions that have one of the wanted values in every named column; a null is no value."""
    for name, wanted in labels.items():
        questions = questions.where(F.col(name).isin(*wanted) if wanted else F.lit(False))
    return questions


def selection_counts(questions: DataFrame, label: str) -> DataFrame:
    """(value, n): how many of the selected questions have each value of the label they were balanced on."""
    return questions.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n"))


def failures(rows: DataFrame, questions: DataFrame, key: str, only: str = "missed") -> DataFrame:
    """The rows of a run that a filter keeps, each with its question's columns (null where the question is not known).

    missed: recall is null or below 1; abstained; any other name keeps all. A report
    orders and limits them itself. Questions that share an id are an error of the
    data set, found by its validation, and would repeat the row.
    """
    recall = F.col("recall").cast("double")
    kept = {"missed": recall.isNull() | (recall < 1), "abstained": F.coalesce(F.col("abstained").cast("boolean"), F.lit(False))}
    return rows.where(kept.get(only, F.lit(True))).join(questions, key, "left")


def pool(leaves: DataFrame, summaries: DataFrame) -> DataFrame:
    """Leaves and summaries as rows of one index, told apart by layer; a leaf's level is 0, columns of one side are null on the other."""
    leaf = leaves.withColumn("layer", F.lit("leaf")).withColumn("level", F.lit(0))
    return leaf.unionByName(summaries.withColumn("layer", F.lit("summary")), allowMissingColumns=True)
