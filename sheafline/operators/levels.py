"""Summary rows above chunks, level by level.

A level groups the rows below it, sums every group up in a text and writes both as tables;
the next level groups these summaries. What a group of any size needs is
taken from bounded choices: the members that can still fit, or sentences in portions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens
from ..functions.vectors import dot
from ..plans.config import IndexConfig
from . import dense, hierarchy, index
from .groups import with_running
from .saved import saved
from .sizes import small

#: Characters of a summary.
BUDGET = 900
#: Sentences of a group that one step of lead_idf() looks at.
PORTION = 200
#: Terms of the smallest idf whose idf every task knows.
KNOWN_TERMS = 100_000
#: How many times more sentences set the next floor of lead_idf().
GROWTH = 8

# ---------------------------------------------------------------- summaries


def _fitted(ordered: DataFrame, budget: int) -> DataFrame:
    """(group, text): texts (group, place, text) in order as long as they fit; the first is kept whatever its size."""
    parts = ordered.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    taken = F.expr(f"""aggregate(p, named_struct('used', 0, 'done', false, 'o', cast(array() as array<string>)), (a, x) ->
      if(a.done or (size(a.o) > 0 and a.used + length(x.text) > {budget}), named_struct('used', a.used, 'done', true, 'o', a.o),
        named_struct('used', a.used + length(x.text), 'done', false, 'o', concat(a.o, array(x.text)))), a -> a.o)""")
    return parts.select("group", F.array_join(taken, "\n").alias("text"))


def _mean_of(members: DataFrame) -> DataFrame:
    """(group, mean): the mean vector of each group, of unit length unless it is zero."""
    cells = members.select("group", F.posexplode("vec").alias("slot", "x")).groupBy("group", "slot").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = cells.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda c: c["m"]).alias("mean"))  # a number for each slot
    size = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return whole.select("group", F.when(size > 1e-12, F.transform("mean", lambda x: x / size)).otherwise(F.col("mean")).alias("mean"))


def _texts_of(chosen: DataFrame, members: DataFrame) -> DataFrame:
    """(group, place, text) of chosen members (group, no, place): texts are read again for these alone."""
    chosen = small(saved(chosen, "chosen"))
    return members.select("group", "no", "text").join(chosen, ["group", "no"]).groupBy("group", "place").agg(F.max("text").alias("text"))


def centroid(members: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(group, text): members' texts by their product with the group's normalised mean, ties by no, as far as they fit.

    members: group, no, text, vec. Empty texts are passed over, so no more than ``budget`` + 1 can be taken.
    """
    scored = members.where("text <> ''").join(_mean_of(members), "group")
    place = F.row_number().over(W.partitionBy("group").orderBy(F.desc("score"), "no"))
    best = scored.select("group", "no", F.round(dot(F.col("vec"), F.col("mean")), 9).alias("score")).select("group", "no", place.alias("place")).where(F.col("place") <= budget + 1)
    return _fitted(_texts_of(best, members), budget)


def mmr(members: DataFrame, budget: int = BUDGET, weight: float = 0.5) -> DataFrame:
    """(group, text): members one after another by ``weight`` * relevance - (1 - weight) * likeness to what was taken, as far as they fit.

    Relevance is the product with the group's normalised mean; the first member is the most
    relevant; ties by no. All groups take a step at a time; a step is one maximum over members, so
    a group of any size is worked on by many tasks, and there are as many steps as texts fit. Steps carry
    lengths of texts; those that were taken are read at the end.
    """
    rows = members.where("text <> ''").select("group", "no", F.length("text").alias("size"), "vec")
    state = saved(rows.join(_mean_of(members), "group").select("group", "no", "size", "vec", F.round(dot(F.col("vec"), F.col("mean")), 9).alias("rel"), F.lit(None).cast("double").alias("like")), "mmr")
    taken, step = None, 0
    while True:
        score = F.when(F.col("like").isNull(), F.col("rel")).otherwise(F.round(weight * F.col("rel") - (1 - weight) * F.col("like"), 9))
        best = state.groupBy("group").agg(F.max_by(F.struct("no", "size", "vec"), F.struct(score, -F.col("no"))).alias("b")).select("group", "b.*")
        best = best.withColumn("place", F.lit(step))
        used = taken.groupBy("group").agg(F.sum("size").alias("used")) if taken is not None else None
        best = saved(best if used is None else best.join(used, "group").where(F.col("used") + F.col("size") <= budget).drop("used"), "mmr")
        if best.isEmpty():
            break
        picked = best.select("group", "place", "size", "no")
        taken = saved(picked if taken is None else taken.unionByName(picked), "mmr")
        # groups that go on, without what they took
        new = best.select("group", F.col("no").alias("last"), F.col("vec").alias("its"))
        state = state.join(new, "group").where("no <> last").withColumn("like", F.greatest(F.coalesce("like", F.lit(-2.0)), F.round(dot(F.col("vec"), F.col("its")), 9))).drop("last", "its")
        state = saved(state, "mmr")
        step += 1
    if taken is None:
        return members.select("group", "text").limit(0)
    return _fitted(_texts_of(taken.select("group", "no", "place"), members.where("text <> ''")), budget)


def _bounds(members: DataFrame, terms: DataFrame) -> DataFrame:
    """(group, no, at, most): of each sentence with tokens what lead_idf() can score it at most. Frequent tokens count their idf, others the largest there is."""
    most = max(0.0, terms.agg(F.max("idf").alias("m")).first().m or 0.0)
    known = terms.select("token", "idf").orderBy("idf", "token").limit(KNOWN_TERMS).toArrow()
    shared = members.sparkSession.sparkContext.broadcast((known.column("token").combine_chunks(), np.r_[known.column("idf").to_numpy(), most]))
    texts = members.select("group", "no", F.transform(sentences(F.col("text")), lambda t: F.array_distinct(tokens(t))).alias("tokens"))

    def run(batches):
        names, idf = shared.value
        for batch in batches:
            cut = batch.column("tokens")
            counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
            words = cut.flatten()
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            weight = idf[pc.index_in(coded.dictionary, names).fill_null(len(names)).to_numpy(zero_copy_only=False)]
            bound = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=weight[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(sizes))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            full = np.flatnonzero(sizes)
            picked = pa.array(row[full])
            yield pa.RecordBatch.from_arrays([batch.column("group").take(picked), batch.column("no").take(picked), pa.array(at[full].astype(np.int32)), pa.array(bound[full])], ["group", "no", "at", "most"])

    kinds = dict(members.dtypes)
    return texts.mapInArrow(run, f"group {kinds['group']}, no {kinds['no']}, at int, most double")


def _graded(chosen: DataFrame, members: DataFrame, terms: DataFrame) -> DataFrame:
    """(group, no, at, sentence, tokens, score) of chosen sentences (group, no, at); of equal ones in a group the first."""
    texts = members.select("group", "no", "text").join(small(saved(chosen.select("group", "no").distinct(), "lead")), ["group", "no"], "left_semi")
    cut = texts.select("group", "no", F.posexplode(sentences(F.col("text"))).alias("at", "sentence")).join(small(chosen.select("group", "no", "at")), ["group", "no", "at"], "left_semi")
    first = cut.groupBy("group", "sentence").agg(F.min(F.struct("no", "at")).alias("f")).select("group", "f.no", "f.at", "sentence", F.array_distinct(tokens(F.col("sentence"))).alias("tokens"))
    first = saved(first, "lead")
    weights = first.select("group", "no", "at", F.explode("tokens").alias("token")).join(terms.select("token", "idf"), "token", "left")
    weights = weights.groupBy("group", "no", "at").agg(F.round(F.sum(F.coalesce("idf", F.lit(0.0))), 6).alias("score"))
    return saved(first.join(weights, ["group", "no", "at"]), "lead")


def lead_idf(members: DataFrame, terms: DataFrame, budget: int = BUDGET, portion: int = PORTION) -> DataFrame:
    """(group, text): sentences by the idf of their distinct tokens, each only if it has a token that none before had.

    members: group, no, text; terms: token, idf, tokens that it lacks counting nothing. Ties go by no and by place. A sentence
    that would go beyond the budget ends the group, but for its first one. A group's sentences are taken in
    portions of the best ones left, and what was seen is carried on, so no group is gathered whole. Without a sentence
    that has tokens, a group has its texts as far as they fit.

    Only sentences that can be among the best are graded: the least score of those of the largest bounds is a floor, and
    all whose bound reaches it are graded. Groups that are not done above their floor go on with a lower one, down to all sentences.
    """
    bounds = saved(_bounds(members, terms), "lead")
    states = saved(bounds.select("group").distinct().select("group", F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("taken"), F.lit(0).alias("used")), "lead")
    told: DataFrame | None = None
    order = W.partitionBy("group").orderBy(F.desc("score"), "no", "at")
    floors, size = states.select("group", F.lit(None).cast("double").alias("above")), portion
    while not states.isEmpty():
        # equal sentences have equal bounds, so one of each bound
        mine = bounds.join(F.broadcast(states.select("group")), "group", "left_semi")
        top = mine.groupBy("group", "most").agg(F.min(F.struct("no", "at")).alias("f"))
        top = top.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(F.desc("most")))).where(F.col("place") <= size)
        least = _graded(saved(top.select("group", "f.no", "f.at"), "lead"), members, terms).groupBy("group").agg(F.min("score").alias("least"))
        counts = top.groupBy("group").agg(F.count("*").alias("n"))
        floors = saved(floors.join(counts, "group").join(least, "group").select("group", "above", F.when(F.col("n") >= size, F.col("least")).alias("floor")), "lead")
        wanted = mine.join(F.broadcast(floors), "group").where("floor is null or most >= floor - 0.00001")
        left = _graded(saved(wanted.select("group", "no", "at"), "lead"), members, terms)
        left = left.join(F.broadcast(floors), "group").where("(floor is null or score >= floor) and (above is null or score < above)").drop("above", "floor")
        waiting: DataFrame | None = None
        while not states.isEmpty():
            best = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= portion)
            held = best.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "tokens"))).alias("p"), F.count("*").alias("n"), F.max_by(F.struct("score", "no", "at"), "place").alias("last"))
            fold = F.expr(f"""aggregate(p, named_struct('seen', seen, 'taken', taken, 'used', used, 'done', false), (a, x) ->
              if(a.done or size(array_except(x.tokens, a.seen)) = 0, a,
                if(size(a.taken) > 0 and a.used + length(x.sentence) > {budget}, named_struct('seen', a.seen, 'taken', a.taken, 'used', a.used, 'done', true),
                  named_struct('seen', array_union(a.seen, x.tokens), 'taken', concat(a.taken, array(x.sentence)), 'used', a.used + length(x.sentence), 'done', false))))""")
            now = states.join(held, "group", "left").withColumn("p", F.coalesce("p", F.expr("filter(array(named_struct('place', 0, 'sentence', '', 'tokens', array(''))), x -> false)"))).withColumn("a", fold)
            now = saved(now.join(floors.select("group", "floor"), "group"), "lead")
            none = F.coalesce("n", F.lit(0)) < portion
            over = F.col("a.done") | (none & F.col("floor").isNull())
            done = now.where(over).select("group", F.array_join("a.taken", " ").alias("text"))
            told = done if told is None else told.unionByName(done)
            later = now.where(~over & none).select("group", "a.seen", "a.taken", "a.used")
            waiting = later if waiting is None else waiting.unionByName(later)
            states = saved(now.where(~over & ~none).select("group", "a.seen", "a.taken", "a.used"), "lead")
            if states.isEmpty():
                break
            # what is behind the last one looked at
            ends = now.where(~over & ~none).select("group", F.col("last.score").alias("s"), F.col("last.no").alias("n1"), F.col("last.at").alias("a1"))
            left = saved(left.join(ends, "group").where("score < s or score = s and (no > n1 or no = n1 and at > a1)").drop("s", "n1", "a1"), "lead")
        states = saved(waiting, "lead") if waiting is not None else states
        floors = floors.join(states.select("group"), "group", "left_semi").select("group", F.col("floor").alias("above"))
        size *= GROWTH
    bare = members.where("text <> ''")
    bare = bare if told is None else bare.join(told.where("text <> ''"), "group", "left_anti")
    place = F.row_number().over(W.partitionBy("group").orderBy("no"))
    rest = _fitted(bare.select("group", "text", place.alias("place")).where(F.col("place") <= budget + 1), budget)
    return rest if told is None else told.where("text <> ''").unionByName(rest)


def card(members: DataFrame, terms: DataFrame, documents: int = 40) -> DataFrame:
    """(group, text): how many members and documents a group has, its twelve heaviest terms and its first documents.

    members: group, no, text, document (string, may be null).
    """
    counts = members.groupBy("group").agg(F.count("*").alias("n"))
    own = members.where("document is not null").select("group", "document").distinct()
    many = own.groupBy("group").agg(F.count("*").alias("d"))
    listed = own.withColumn("p", F.row_number().over(W.partitionBy("group").orderBy("document"))).where(F.col("p") <= documents)
    listed = listed.groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("document")), " ").alias("names"))
    seen = members.select("group", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("group", "token").agg(F.count("*").alias("k"))
    heavy = seen.join(terms.select("token", "idf"), "token").withColumn("w", F.round(F.col("k") * F.col("idf"), 6))
    heavy = heavy.withColumn("p", F.row_number().over(W.partitionBy("group").orderBy(F.desc("w"), "token"))).where(F.col("p") <= 12)
    heavy = heavy.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"]).alias("t"))
    whole = counts.join(many, "group", "left").join(listed, "group", "left").join(heavy, "group", "left")
    line = F.concat(F.lit("[group of "), F.col("n").cast("string"), F.lit(" · "), F.coalesce("d", F.lit(0)).cast("string"), F.lit(" documents]\n"))
    return whole.select("group", F.concat(line, F.coalesce(F.array_join("t", " "), F.lit("")), F.lit("\n"), F.coalesce("names", F.lit(""))).alias("text"))


#: By the name that a configuration gives: members (group, no, text, vec, document) and the leaves' terms to texts.
SUMMARISERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "centroid": lambda m, _: centroid(m),
    "mmr": lambda m, _: mmr(m),
    "lead-idf": lead_idf,
    "card": card,
}

# ---------------------------------------------------------------- levels


@dataclass
class Hierarchy:
    """summaries (id, level, no, group, text, vec, document, importance, members), members (summary, id, level), notes."""

    summaries: DataFrame | None = None
    members: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def build(
    leaves: DataFrame,
    group_once: Callable[[DataFrame], DataFrame],
    embed: Callable[[DataFrame], DataFrame],
    levels: int = 1,
    min_group: int = 3,
    summarizer: str = "centroid",
) -> Hierarchy:
    """Every level of summaries above ``leaves`` (id string, no long, text, vec, document string, importance double).

    group_once(rows) gives (group, id) of rows (as leaves, with ``group``, null for leaves), a row in any number of groups. Groups of fewer than
    min_group rows are dropped. Those that are left are numbered by their smallest no, then by
    group, and are called ``summary:h<level>-<number>``; a group without a text has no summary. embed(rows) gives (id, vec) for
    the summaries' texts; the next level groups these summaries alone. It ends before ``levels``, with a
    note, when fewer than two or min_group rows are left to group, or no group is large enough. Leaves stay as they
    are: summaries are rows to be added to them. A summary has a document only if all members that have one agree.

    The number of rows and of groups of each level reach the driver.
    """
    out = Hierarchy()
    terms = saved(index.build(leaves.select("id", "text"), "id", "text").terms, "terms")
    rows = saved(leaves.select("id", "no", "text", "vec", "document", "importance", F.lit(None).cast("string").alias("group")), "rows")
    for level in range(1, levels + 1):
        n = rows.count()
        if n < max(2, min_group):
            out.notes.append(f"level {level}: only {n} rows to group")
            break
        pairs = saved(group_once(rows).select(F.col("group").cast("string").alias("group"), "id").distinct(), "groups")
        large = pairs.join(rows.select("id", "no"), "id").groupBy("group").agg(F.count("*").alias("members"), F.min("no").alias("first")).where(F.col("members") >= min_group)
        large = saved(large, "groups")
        if large.isEmpty():
            out.notes.append(f"level {level}: no group of {min_group} rows")
            break
        pairs = pairs.join(large.select("group"), "group", "left_semi")
        held = saved(pairs.join(rows.drop("group"), "id"), "members")
        texts = SUMMARISERS[summarizer](held, terms).where(F.length(F.trim("text")) > 0)
        facts = held.groupBy("group").agg(
            F.when(F.min("document") == F.max("document"), F.min("document")).alias("document"), F.round(F.avg("importance"), 3).alias("importance")
        )
        numbered = with_running(large.withColumn("_one", F.lit(1)), ["_one"], ["first", "group"], "sum", F.lit(1), "no").withColumn("no", F.col("no") - 1)
        name = F.concat(F.lit(f"summary:h{level}-"), F.lpad(F.col("no").cast("string"), 3, "0"))
        name = F.when(F.col("no") > 999, F.concat(F.lit(f"summary:h{level}-"), F.col("no").cast("string"))).otherwise(name)
        made = saved(numbered.join(texts, "group").join(facts, "group").select(name.alias("id"), F.lit(level).alias("level"), F.col("no").cast("long").alias("no"), "group", "text", "document", "importance", "members"), "summaries")
        vec = embed(made.select("id", "text"))
        made = saved(made.join(vec, "id", "left"), "summaries")
        belong = held.select("group", "id").join(made.select("group", F.col("id").alias("summary")), "group").select("summary", "id", F.lit(level).alias("level"))
        belong = saved(belong, "belong")
        out.summaries = made if out.summaries is None else out.summaries.unionByName(made)
        out.members = belong if out.members is None else out.members.unionByName(belong)
        rows = made.select("id", "no", "text", "vec", "document", "importance", "group")
    return out


def grouping(config: IndexConfig, labels: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """What build() groups a level by, as a configuration says.

    ``label-prop`` makes communities of a graph of nearest neighbours, of shared rare terms, or of both;
    ``kmeans`` and ``raptor`` groups of vectors, rows without one being in none; ``metadata`` groups leaves by the values of their
    labels (id, values array<string>).
    """
    problems = config.problems()
    if problems or not config.hierarchy:
        raise ValueError("; ".join(problems) or "the configuration has no hierarchy")

    def once(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("no").alias("group_no"), "id")
        if config.hierarchy == "metadata":
            return labels.select("id", F.explode("values").alias("group")).where("group is not null and group <> ''").join(rows.select("id"), "id", "left_semi").select("group", "id")
        vectors = rows.where("vec is not null").select(F.col("no").alias("id"), "vec")
        if config.hierarchy in ("kmeans", "raptor"):
            k = hierarchy.group_count(vectors.count(), config.granularity)
            found = hierarchy.kmeans_groups(vectors, k) if config.hierarchy == "kmeans" else hierarchy.mixture_groups(vectors, k)
            return found.withColumnRenamed("id", "group_no").join(named, "group_no").select("group", "id")
        edges = []
        if config.graph_source in ("knn", "hybrid"):
            edges.append(hierarchy.knn_edges(dense.cosine_top_k(vectors, vectors, config.graph_knn, "id", "vec")))
        if config.graph_source in ("lexical", "hybrid"):
            terms = index.build(rows.select(F.col("no").alias("id"), "text"), "id", "text")
            edges.append(hierarchy.lexical_edges(hierarchy.rare_terms(terms), terms.stats))
        graph = saved(hierarchy.hybrid_edges(*edges) if len(edges) == 2 else edges[0], "graph")
        found = hierarchy.label_propagation(graph)
        return found.select(F.col("label").alias("group"), F.col("id").alias("group_no")).join(named, "group_no").select("group", "id")

    return once


def speaks_for(members: DataFrame, levels: int) -> DataFrame:
    """(summary, leaf): the leaves of every summary, down through the levels. members: summary, id, level."""
    found = members.where("level = 1").select("summary", F.col("id").alias("leaf"))
    out = found
    for level in range(2, levels + 1):
        found = members.where(F.col("level") == level).select(F.col("summary").alias("upper"), F.col("id").alias("summary")).join(found, "summary").select(F.col("upper").alias("summary"), "leaf").distinct()
        out = out.unionByName(found)
    return out


def level_report(built: Hierarchy, leaves: DataFrame) -> DataFrame:
    """A row for each level: groups, smallest, median (whole) and largest size, and the share of the leaves it speaks for."""
    levels = built.summaries.agg(F.max("level").alias("m")).first().m
    sizes = built.summaries.groupBy("level").agg(
        F.count("*").alias("groups"), F.min("members").alias("smallest"), F.floor(F.percentile("members", 0.5)).cast("long").alias("median"), F.max("members").alias("largest")
    )
    reach = speaks_for(built.members, levels).join(built.summaries.select(F.col("id").alias("summary"), "level"), "summary")
    reach = reach.groupBy("level").agg(F.count_distinct("leaf").alias("reached"))
    total = leaves.agg(F.count("*").alias("n"))  # one row
    return sizes.join(reach, "level").crossJoin(F.broadcast(total)).select("level", "groups", "smallest", "median", "largest", F.round(F.col("reached") / F.col("n"), 4).alias("coverage"))


def drill(kept: DataFrame, members: DataFrame, coverage: DataFrame, k: int) -> DataFrame:
    """Summaries that were kept and, behind each, its k best covered members; through all levels, one below the other.

    kept: qid, id, rank; members: summary, id, level; coverage: qid, id, coverage of any row. Returns qid, rank, id,
    expanded_from, depth, place.
    """
    out = kept.select("qid", "rank", "id", F.lit(None).cast("string").alias("expanded_from"), F.lit(0).alias("depth"), F.lit(0).alias("place"))
    step, depth = out, 0
    while True:
        below = step.select("qid", "rank", F.col("id").alias("summary")).join(members.select("summary", "id"), "summary")
        graded = below.join(coverage, ["qid", "id"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
        place = F.row_number().over(W.partitionBy("qid", "rank", "summary").orderBy(F.desc("coverage"), "id"))
        depth += 1
        step = saved(graded.withColumn("place", place).where(F.col("place") <= k).select("qid", "rank", "id", F.col("summary").alias("expanded_from"), F.lit(depth).alias("depth"), "place"), "drill")
        if step.isEmpty():
            return out
        out = out.unionByName(step)
