"""A BM25 index kept in files, of which a question reads its own tokens' and skips what cannot reach its best.

Chunks are dealt into ranges of RANGE_CHUNKS at most, as a task reads them. A row of the index is a token's postings in one
range, made by that task, with their largest impact. Rows lie in folders by a bucket of the token, so a
question reads the folders of its tokens. For each question the largest impacts of its
tokens bound what a range can give. The FIRST ranges by this bound are scored; the score at the k-th place is
then a threshold, and only ranges whose bound reaches it are read besides. A range is scored as a whole: the matrix of its
chunks times that of all questions' weights, of which each question keeps k rows. The result is that of retrieve.bm25().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.config import fingerprint
from . import index, retrieve
from .retrieve import K1, B
from .saved import saved, step_folder
from .sizes import small

RANGE_CHUNKS = 4096
#: Tokens of a range, but for its last chunk.
RANGE_TOKENS = 1 << 22
#: Rows of a batch that leaves a task at once.
ROWS = 1 << 16
BUCKETS = 64
#: Ranges of a question that are scored for its threshold.
FIRST = 4
#: Asked tokens that are named in the plan; beyond, they are joined.
NAMED_TOKENS = 5000


def _part(tf: Column, dl: Column, avg_len: Column) -> Column:
    """What a posting gives for an idf of 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / avg_len))


def _range_blocks(parts: list[pa.RecordBatch], number: int):
    """Batches of the blocks of one range: (token, range, ids, tfs, dls, copies), and a row without a token that counts its texts and their lengths."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    ids, rows = whole.column("id").combine_chunks(), whole.column("rows").combine_chunks()
    of = np.repeat(np.arange(len(ids)), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
    flat = rows.flatten()
    dl, words = pc.struct_field(flat, "dl").to_numpy(zero_copy_only=False).astype(np.int64), pc.struct_field(flat, "tokens")
    # texts of one id and length are counted together
    size = int(dl.max(initial=0)) + 1
    texts, text = np.unique(of * size + dl, return_inverse=True)
    coded = words.flatten().dictionary_encode()
    n = max(1, len(texts))
    cells = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(text, pc.list_value_length(words).to_numpy(zero_copy_only=False))
    cells, tf = np.unique(cells, return_counts=True)
    code, at = cells // n, texts[cells % n]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    ends = np.r_[starts, len(code)]
    copies = int(np.bincount(texts // size).max(initial=1))
    names = ["token", "range", "ids", "tfs", "dls", "copies", "n", "words"]
    for i in range(0, len(starts), ROWS):
        a, b = ends[i], ends[min(i + ROWS, len(starts))]
        offsets = pa.array((ends[i : i + ROWS + 1] - a).astype(np.int32))
        listed = [ids.take(pa.array(at[a:b] // size)), pa.array(tf[a:b].astype(np.int32)), pa.array((at[a:b] % size).astype(np.int32))]
        m = len(offsets) - 1
        none = pa.nulls(m, pa.int64())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in listed]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[starts[i : i + ROWS]])), pa.array(np.full(m, number)), *lists, pa.array(np.full(m, copies, np.int32)), none, none], names)
    blank = [pa.nulls(1, pa.list_(ids.type)), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.int32())]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), *blank, pa.array([len(dl)]), pa.array([int(np.maximum(dl, 1).sum())])], names)


def _blocks(chunks: DataFrame, range_chunks: int) -> DataFrame:
    """The blocks of chunks (id, text), made where these are read. Texts are shuffled only if an id has several; these have to fit into a row."""
    texts = chunks.select("id", tokens(F.col("text")).alias("tokens")).select("id", F.struct(F.size("tokens").alias("dl"), "tokens").alias("row"))
    if index.repeated(chunks):
        texts = texts.groupBy("id").agg(F.collect_list("row").alias("rows"))
    else:
        texts = texts.select("id", F.array("row").alias("rows"))

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        parts, n, words = [], 0, 0
        for batch in batches:
            rows = batch.column("rows")
            sizes = np.r_[0, np.cumsum(pc.struct_field(rows.flatten(), "dl").to_numpy(zero_copy_only=False).astype(np.int64))]
            upto = sizes[np.r_[0, np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))].astype(np.int64)]
            at = 0
            while at < batch.num_rows:
                end = min(at + range_chunks - n, int(np.searchsorted(upto, upto[at] + RANGE_TOKENS - words)), batch.num_rows)
                end = max(end, at + 1)
                parts.append(batch.slice(at, end - at))
                n, words, at = n + end - at, words + int(upto[end] - upto[at]), end
                if n >= range_chunks or words >= RANGE_TOKENS:
                    yield from _range_blocks(parts, (task << 32) + number)
                    parts, n, words, number = [], 0, 0, number + 1
        if parts:
            yield from _range_blocks(parts, (task << 32) + number)

    kind = dict(chunks.dtypes)["id"]
    return texts.mapInArrow(run, f"token string, range long, ids array<{kind}>, tfs array<int>, dls array<int>, copies int, n long, words long")


class StoredIndex:
    """The index in a folder: blocks (bucket, token, range, most, ids, tfs, dls), terms (token, df, idf), stats (n, avg_len, ranges)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def build(self, chunks: DataFrame, range_chunks: int = RANGE_CHUNKS, buckets: int = BUCKETS) -> StoredIndex:
        """Writes the index of chunks (id, text); the statistics come last, and without them there is no index."""
        made = saved(_blocks(chunks, range_chunks), "blocks")
        told = made.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("words").alias("words"), F.count("*").alias("ranges")).first()
        avg_len = told.words / told.n if told.n else 1.0
        made = made.where("token is not null")
        # an id's texts of different lengths add up
        most = F.array_max(F.zip_with("tfs", "dls", lambda tf, dl: _part(tf, dl, F.lit(avg_len)))) * F.col("copies")
        blocks = made.select("token", "range", most.alias("most"), "ids", "tfs", "dls", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"))
        blocks.repartition("bucket", F.pmod(F.xxhash64("range"), F.lit(8))).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks")
        terms = made.groupBy("token").agg(F.sum(F.size("ids")).alias("df")).select("token", "df", index.idf(F.lit(told.n), F.col("df")).alias("idf"))
        terms.repartition(1 if told.n < 10_000 else buckets, "token").write.mode("overwrite").parquet(f"{self.path}/terms")
        self.spark.createDataFrame([(told.n, float(avg_len), told.ranges, buckets)], "n long, avg_len double, ranges int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def _asked(self, questions: DataFrame, variants: bool) -> tuple[DataFrame, DataFrame]:
        """(qid, variant, token, idf) of the questions, and the blocks of their tokens: only their folders are read."""
        buckets = self.spark.read.parquet(f"{self.path}/stats").first().buckets
        asked = retrieve.query_terms(questions, variants)
        terms, blocks = self.spark.read.parquet(f"{self.path}/terms"), self.spark.read.parquet(f"{self.path}/blocks")
        names = [r.token for r in asked.select("token").distinct().limit(NAMED_TOKENS + 1).collect()]
        if len(names) <= NAMED_TOKENS:
            places = [r.b for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
            terms, blocks = terms.where(F.col("token").isin(names)), blocks.where(F.col("bucket").isin(places) & F.col("token").isin(names))
        else:
            wanted = asked.select("token").distinct()
            terms, blocks = terms.join(wanted, "token", "left_semi"), blocks.join(wanted, "token", "left_semi")
        return saved(asked.join(terms.select("token", "idf"), "token"), "asked"), blocks

    def search(self, questions: DataFrame, k: int = 40, variants: bool = False, first: int = FIRST) -> DataFrame:
        """(qid, id, score, rank): as retrieve.bm25() on the same chunks."""
        asked, blocks = self._asked(questions, variants)
        bounds = blocks.select("token", "range", "most").join(asked, "token").groupBy("qid", "variant", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        bounds = bounds.groupBy("qid", "range").agg(F.max("bound").alias("bound"))
        place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "range"))
        bounds = saved(bounds.withColumn("place", place), "bounds")

        avg_len = self.spark.read.parquet(f"{self.path}/stats").first().avg_len
        size = asked.agg(F.count_distinct("token").alias("t"), F.count_distinct(F.struct("qid", "variant")).alias("c")).first()
        shared = self.spark.sparkContext.broadcast((retrieve.weight_matrix(asked), avg_len)) if size.t and size.t * size.c <= retrieve.SCAN_CELLS else None
        kinds = dict(asked.dtypes)["qid"], dict(blocks.dtypes)["ids"][len("array<") : -1]

        def products(held: pa.Table, chosen: pa.Table) -> pa.Table:
            (weights, names, firsts, qids), avg_len = shared.value
            out = []
            if held.num_rows and chosen.num_rows:
                lists = held.column("ids").combine_chunks()
                code = np.repeat(pc.index_in(held.column("token"), names).to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                coded = lists.flatten().dictionary_encode(null_encoding="encode")
                row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                tf, dl = (held.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tfs", "dls"))
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(dl, 1) / avg_len))
                order = np.argsort(row, kind="stable")
                row, code, part = row[order], code[order], part[order]
                n = len(coded.dictionary)
                score = np.empty((len(qids), n))
                step = max(1, retrieve.STEP_CELLS // len(names))
                for i in range(0, n, step):
                    a, b = np.searchsorted(row, (i, i + step))
                    rows = min(step, n - i)
                    m = np.bincount((row[a:b] - i) * len(names) + code[a:b], weights=part[a:b], minlength=rows * len(names))
                    score[:, i : i + rows] = np.maximum.reduceat(m.reshape(rows, len(names)) @ weights, firsts, axis=1).T
                asks = pc.is_in(qids, pc.unique(chosen.column("qid"))).to_numpy(zero_copy_only=False)
                score[~asks] = 0
                out = list(retrieve.best_of(score, coded.dictionary, qids, k))
            return pa.Table.from_batches(out) if out else pa.table({"qid": qids.slice(0, 0), "id": held.column("ids").combine_chunks().flatten().slice(0, 0), "score": pa.array([], pa.float64())})

        def scored(chosen: DataFrame) -> DataFrame:
            chosen = chosen.select("qid", "range")
            if shared is not None:
                told = blocks.join(small(chosen.select("range").distinct()), "range", "left_semi").select("range", "token", "ids", "tfs", "dls")
                found = told.groupBy("range").cogroup(chosen.groupBy("range")).applyInArrow(products, f"qid {kinds[0]}, id {kinds[1]}, score double")
                return found.select("qid", "id", F.round("score", 6).alias("score")).where("score > 0")
            told = chosen.join(asked, "qid").join(blocks.select("token", "range", "ids", "tfs", "dls"), ["token", "range"])
            parts = told.select("qid", "variant", "idf", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
            whole = parts.groupBy("qid", "variant", F.col("p.ids").alias("id")).agg(F.sum(F.col("idf") * _part(F.col("p.tfs"), F.col("p.dls"), F.lit(avg_len))).alias("score"))
            return whole.groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score")).where("score > 0")

        best = saved(retrieve.ranked(scored(bounds.where(F.col("place") <= first)), k), "first")
        least = best.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        rest = bounds.where(F.col("place") > first).join(least, "qid", "left").where("least is null or bound >= least - 0.000001")
        return retrieve.ranked(best.select("qid", "id", "score").unionByName(scored(rest)), k)


def stored(spark: SparkSession, chunks: DataFrame, named: dict) -> StoredIndex:
    """The index of chunks that ``named`` and their files (names, sizes, times) identify; built if the shared folder does not have it yet."""
    told = []
    for name in sorted(chunks.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        told.append([name, int(status.getLen()), int(status.getModificationTime())])
    held = StoredIndex(spark, f"{step_folder(spark)}/bm25-{fingerprint([named, told])}")
    return held if held.exists() else held.build(chunks)
