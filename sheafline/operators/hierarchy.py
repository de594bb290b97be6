"""Groups of chunks and the rows that sum them up."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .index import Index
from .saved import saved

#: Frequent tokens whose df every task of rare_terms() knows.
KNOWN_TERMS = 100_000
#: Chunks of a block of lexical_edges().
EDGE_BLOCK = 8192
#: Pairs that a task of lexical_edges() adds up at a time, but for those of one chunk.
PAIRS = 1 << 21


def rare_terms(index: Index, top: int = 12) -> DataFrame:
    """(id, token, idf, place): each chunk's rarest tokens, ties by token.

    Every task knows the most frequent tokens. A batch's postings of them are passed over where a chunk has ``top`` others
    in it, all of them rarer; only what is left is joined with the terms and ordered.
    """
    terms = saved(index.terms.select("token", "df", "idf"), "terms")
    known = terms.orderBy(F.desc("df"), F.desc("token")).limit(KNOWN_TERMS).select("token").toArrow().column("token").combine_chunks()
    shared = index.postings.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        for batch in batches:
            others = ~pc.is_in(batch.column("token"), known).to_numpy(zero_copy_only=False)
            row = batch.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            few = np.bincount(row, weights=others, minlength=1) < top
            yield batch.filter(pa.array(others | few[row]))

    kept = index.postings.select("id", "token").mapInArrow(run, f"id {dict(index.postings.dtypes)['id']}, token string")
    order = W.partitionBy("id").orderBy("df", "token")
    rows = kept.join(terms, "token")
    return rows.select("id", "token", F.round("idf", 6).alias("idf"), F.row_number().over(order).alias("place")).where(F.col("place") <= top)


def surviving_terms(rare: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows of rare_terms() whose token is in the lists of two chunks at least, and of a fifth of all (or two) at most."""
    counts = rare.groupBy("token").agg(F.count("*").alias("held"))
    most = stats.select(F.greatest(F.lit(2), F.floor(F.col("n") / 5)).alias("most"))  # one row
    kept = counts.crossJoin(F.broadcast(most)).where("held between 2 and most").select("token")
    return rare.join(kept, "token", "left_semi")


def _written(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _pairs(chunks: pa.Table, lists: pa.Table):
    """(a, b, weight): of a block's rows (id, token, micro) with the lists (word, ids) of their tokens, a slice of chunks at a time."""
    place = pc.index_in(chunks.column("token"), lists.column("word")).to_numpy(zero_copy_only=False)
    held = lists.column("ids").combine_chunks()
    sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ids = np.cumsum(sizes) - sizes, held.flatten().to_numpy(zero_copy_only=False)
    own, micro = chunks.column("id").to_numpy(), chunks.column("micro").to_numpy()
    order = np.argsort(own, kind="stable")
    own, micro, place = own[order], micro[order], place[order].astype(np.int64)
    # lists are in order of ids: only what is behind one's own
    ends = starts[place] + sizes[place]
    begins = np.fromiter((x + np.searchsorted(ids[x:y], o, "right") for x, y, o in zip(starts[place], ends, own, strict=True)), np.int64, len(own))
    many = ends - begins
    upto = np.r_[0, np.cumsum(many)]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    edges = np.r_[first, len(own)]
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(upto[edges], upto[edges[i]] + PAIRS, "right")) - 1)
        p, q = edges[i], edges[j]
        n = many[p:q]
        if n.sum():
            at = np.arange(int(n.sum())) + np.repeat(begins[p:q] - (np.cumsum(n) - n), n)
            x, y, w = np.repeat(own[p:q], n), ids[at], np.repeat(micro[p:q], n)
            by = np.lexsort((y, x))
            x, y, w = x[by], y[by], w[by]
            new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), pa.array(np.add.reduceat(w, new))], ["a", "b", "micro"])
        i = j


def lexical_edges(rare: DataFrame, stats: DataFrame) -> DataFrame:
    """(a, b, weight): chunks by the idf of the rare terms they share, a < b; terms of many chunks join none. Ids are whole numbers.

    Chunks are dealt into blocks, and a token's list of chunks is sent once to each block that has the token. A block adds up its
    pairs in slices, so pairs, of which there may be more than rows squared over fifty, are never shuffled or held at once.
    """
    rare = saved(surviving_terms(rare, stats).where("id is not null").groupBy("id", "token").agg(F.sum(F.expr("cast(round(idf * 1000000) as long)")).alias("micro"), F.count("*").alias("times")), "rare")
    n = rare.select("id").distinct().count()
    block = F.pmod(F.xxhash64("id"), F.lit(max(8, math.ceil(n / EDGE_BLOCK)))).cast("int")
    lists = rare.groupBy("token").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.col("id").cast("long"), F.col("times").cast("int"))))).alias("ids"))
    mine = rare.select(block.alias("block"), F.col("id").cast("long").alias("id"), "token", "micro")
    sent = mine.select("block", "token").distinct().join(lists.where("size(ids) > 1"), "token").select(F.col("block").alias("to"), F.col("token").alias("word"), "ids")

    def pack(chunks: pa.Table, lists: pa.Table) -> pa.Table:
        chunks = chunks.filter(pc.is_in(chunks.column("token"), pc.unique(lists.column("word"))))
        return pa.table({"chunks": [_written(chunks.select(["id", "token", "micro"]))], "lists": [_written(lists.select(["word", "ids"]))]})

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                yield from _pairs(*[pa.ipc.open_stream(batch.column(c)[r].as_buffer()).read_all() for c in ("chunks", "lists")])

    packed = mine.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(pack, "chunks binary, lists binary")
    found = packed.mapInArrow(pairs, "a long, b long, micro long")
    kind = dict(rare.dtypes)["id"]
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), F.round(F.col("micro") / 1000000, 6).alias("weight"))


def knn_edges(ranking: DataFrame) -> DataFrame:
    """(a, b, weight): the undirected graph of nearest neighbours, the larger weight of both directions; none of 0 or less."""
    pair = ranking.where("score > 0").select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), "score")
    return pair.groupBy("a", "b").agg(F.max("score").alias("weight"))


def scaled(edges: DataFrame) -> DataFrame:
    most = edges.agg(F.max("weight").alias("most"))
    return edges.crossJoin(F.broadcast(most)).select("a", "b", F.round(F.col("weight") / F.col("most"), 6).alias("weight"))  # one row


def hybrid_edges(knn: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both graphs, each scaled by its largest weight, added."""
    rows = scaled(knn).unionByName(scaled(lexical))
    return rows.groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("weight"))


def bipartite_edges(index: Index) -> DataFrame:
    """(chunk, term, weight): every chunk with its terms, by idf."""
    return index.postings.join(index.terms, "token").select(F.col("id").alias("chunk"), F.col("token").alias("term"), "idf")


def label_propagation(edges: DataFrame) -> DataFrame:
    """(id, label): nodes take the label of the largest weight around them until none would change.

    A node moves only to a label of more weight than its own has around it, the smallest of
    equals. In a round those nodes move that want to and whose number for the round
    (a hash) is the largest among neighbours that want to as well. Neighbours thus never move together, so
    every move adds weight within labels; as that cannot grow for ever, this ends on every graph, though
    with a partition that may differ from that of nodes in another order. Weights are rounded to
    six places and must not be negative. Repeated edges add up; an edge from a node to itself counts for nothing.

    Steps are saved in the shared folder; one number reaches the driver in every round.
    """
    edges = edges.where("a <> b").select("a", "b", "weight")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    both = saved(both.groupBy("id", "other").agg(F.round(F.sum("weight"), 6).alias("weight")), "edges")
    labels = saved(both.select("id").distinct().withColumn("label", F.col("id")), "labels")
    step = 0
    while True:
        around = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        own = labels.select("id", F.col("label").alias("own"))
        told = around.join(own, "id").groupBy("id").agg(F.max(F.struct(F.col("w"), (-F.col("label")).alias("m"))).alias("best"), F.max(F.when(F.col("label") == F.col("own"), F.col("w"))).alias("held"))
        movers = saved(told.where("best.w > coalesce(held, 0)").select("id", (-F.col("best.m")).cast(dict(labels.dtypes)["label"]).alias("new"), F.xxhash64("id", F.lit(step)).alias("turn")), "movers")
        if movers.isEmpty():
            return labels
        near = both.join(movers.select("id", "turn"), "id").join(movers.select(F.col("id").alias("other"), F.col("turn").alias("its")), "other")
        behind = near.where("its > turn or its = turn and other > id").select("id").distinct()
        moved = movers.join(behind, "id", "left_anti").select("id", "new")
        labels = saved(labels.join(moved, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
        step += 1


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition."""
    x = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    inner = x.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("inside"))
    ends = x.select(F.col("la").alias("label"), "weight").unionByName(x.select(F.col("lb").alias("label"), "weight"))
    degree = ends.groupBy("label").agg(F.sum("weight").alias("degree"))
    total = edges.agg(F.sum("weight").alias("m"))
    rows = degree.join(inner, "label", "left").crossJoin(F.broadcast(total))  # one row
    part = F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return rows.agg(F.round(F.sum(part), 6).alias("modularity"), F.count("*").alias("n_groups"))


def density(edges: DataFrame, n_nodes: Column | int) -> DataFrame:
    n = (F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes).cast("double")  # n * n is beyond an int from 46341 nodes on
    return edges.agg(F.count("*").alias("n_edges"), F.round(2 * F.count("*") / (n * (n - 1)), 6).alias("density"))


def group_count(n: int, granularity: float) -> int:
    return max(2, min(n, round(granularity * math.sqrt(n / 2))))


def kmeans_groups(vectors: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(id, group): distributed k-means over ``vec``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("group"))


def mixture_groups(vectors: DataFrame, k: int, seed: int = 7, components: int = 50) -> DataFrame:
    """(id, group): every group that holds an id with a probability of at least 1/k, after a reduction to principal components."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    dim = len(rows.first().raw)
    rows = PCA(k=min(components, dim), inputCol="raw", outputCol="features").fit(rows).transform(rows) if dim > components else rows.withColumnRenamed("raw", "features")
    soft = GaussianMixture(k=k, seed=seed).fit(rows).transform(rows)
    return soft.select("id", F.posexplode(vector_to_array("probability")).alias("group", "p")).where(F.col("p") >= 1.0 / k).select("id", "group")


def metadata_groups(rows: DataFrame, id_column: str, labels: list[str]) -> tuple[str, DataFrame]:
    """The array label of the greatest recurrence (values per distinct value), and its groups (group, id).

    Two numbers for each label reach the driver.
    """
    told = {}
    for c in labels:
        counts = rows.select(F.explode(c).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
        r = counts.agg(F.sum("n").alias("n"), F.count("*").alias("d")).first()
        told[c] = (r.n or 0) / max(r.d, 1)
    best = max(labels, key=lambda c: (told[c], c))
    return best, rows.select(F.explode(F.array_distinct(best)).alias("group"), F.col(id_column).alias("id"))


def level_stats(groups: DataFrame, group: str) -> DataFrame:
    """One row: groups, smallest, median and largest size, single ones."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_groups"), F.min("n").alias("smallest"), F.floor(F.percentile("n", 0.5)).cast("long").alias("median"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("long")).alias("singles")
    )


def group_card(rows: DataFrame, group: str, number: str, day: str, kind: str) -> DataFrame:
    """A group's summary row: members, mean of a number, first and last day, distinct values of a kind."""
    return rows.groupBy(group).agg(
        F.count("*").alias("members"), F.round(F.avg(number), 3).alias("mean"), F.min(day).alias("first"), F.max(day).alias("last"), F.array_join(F.array_sort(F.collect_set(kind)), " ").alias("kinds")
    )


def leaf_documents(summaries: DataFrame, leaves: DataFrame, levels: int) -> DataFrame:
    """(summary, doc): all documents that a summary speaks for, down through its levels.

    summaries: (id, member_ids); leaves: (id, doc).
    """
    reached = summaries.select(F.col("id").alias("summary"), F.explode("member_ids").alias("id"))
    found = reached.join(leaves, "id").select("summary", "doc")
    below = summaries.select(F.col("id").alias("up"), F.explode("member_ids").alias("id"))
    for _ in range(levels - 1):
        reached = reached.withColumnRenamed("id", "up").join(below, "up").select("summary", "id")
        found = found.unionByName(reached.join(leaves, "id").select("summary", "doc"))
    return found.distinct()


def fit_sentences(ordered: DataFrame, group: str, budget: int = 900) -> DataFrame:
    """(group, text): each group's sentences in order up to the budget; the first that overflows ends it.

    ordered: (group, place, sentence).
    """
    w = W.partitionBy(group).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    kept = ordered.withColumn("_used", F.sum(F.length("sentence") + 1).over(w) - 1).where(F.col("_used") <= budget)
    parts = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("p"))
    return parts.select(group, F.array_join(F.transform("p", lambda x: x["sentence"]), " ").alias("text"))
