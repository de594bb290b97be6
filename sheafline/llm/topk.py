"""Exact top-k by inner product, with vectors grouped by length.

Method (after Teflioudi and Gemulla, Exact and Approximate Maximum Inner Product
Search with LEMP, 2016): vectors fall into buckets of nearly equal length, the
long ones first. With t the k-th best product a query has so far and b the longest
vector of a bucket, the bucket can add nothing if t > |q| |b|; else its local
threshold is the cosine t / (|q| |b|). Where that is high, vectors are pruned by a
coordinate: a vector of unit length whose cosine with the query is at least c has in
the query's largest coordinate f a value between f c - sqrt((1 - f^2)(1 - c^2)) and
f c + sqrt((1 - f^2)(1 - c^2)). Where it is low, they are pruned by length alone.
What is left is verified with exact products of integers.

In Spark: the vectors of a bucket are cut into blocks of rows, the queries into
blocks of theirs, each block one row of packed numbers. A first round holds every
query against the blocks of longest vectors, until these hold k, for a first
threshold; a second against all other blocks. Pairs of blocks are joined on the
block's number, a few megabytes at a time; each gives k rows for a query at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import Scratch

#: Lengths within a bucket differ by this factor at most.
RATIO = 0.9
#: Vectors and queries of a block.
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
#: A local threshold from which coordinates prune.
HIGH_COSINE = 0.7


def quantize(vectors: DataFrame, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of every component x, as double.

    Vectors that are null or empty, or hold a null or non-finite component, are
    left out, as are null ids.
    """
    x = F.col(f"`{vector_column}`").cast("array<double>")
    base = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return base.where(finite).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _pack_block(table: pa.Table) -> pa.Table:
    """One row for the vectors of a block, in order of their ids."""
    table = table.sort_by("id")
    dim = table["dim"][0].as_py()
    v = table["v"].combine_chunks()
    values = v.values.to_numpy()[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(-1, dim)
    longest = float(np.sqrt((values.astype(np.float64) ** 2).sum(axis=1).max()))
    return pa.table(
        {
            "dim": table["dim"].slice(0, 1),
            "bucket": table["bucket"].slice(0, 1),
            "part": table["part"].slice(0, 1),
            "longest": pa.array([longest]),
            "many": pa.array([len(values)], pa.int64()),
            "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "v": pa.array([values.astype("<i8").tobytes()], pa.binary()),
        }
    )


def _blocks(table: DataFrame, rows: int, by_length: bool) -> DataFrame:
    """Rows (id, v) packed into blocks: dim, bucket, part, longest, many, ids, v."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    bucket = F.when(square > 0, F.floor(F.log(square) / (-2 * math.log(RATIO)))).otherwise(F.lit(-(1 << 20))).cast("int") if by_length else F.lit(0)
    table = table.select("id", "v", F.size("v").alias("dim"), bucket.alias("bucket"))
    # one row for each dimension and bucket of lengths: a bucket spans a factor, so there are few
    sizes = table.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    table = table.join(F.broadcast(sizes), ["dim", "bucket"])
    table = table.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    schema = "dim int, bucket int, part int, longest double, many long, ids binary, v binary"
    return table.select("dim", "bucket", "part", "id", "v").groupBy("dim", "bucket", "part").applyInArrow(_pack_block, schema)


def _best(products: np.ndarray, k: int, least: np.ndarray, ids: np.ndarray, queries: np.ndarray):
    """For every row of products its k largest that reach ``least``, ties to the smaller column; columns are in order of ids."""
    rows, columns, scores = [], [], []
    for i, row in enumerate(products):
        floor = least[i]
        at = np.flatnonzero(row >= floor)
        at = at[ids[at] != queries[i]]
        if len(at) > k:
            kth = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= kth]
            at = at[np.argsort(-row[at], kind="stable")][:k]
        rows.append(np.full(len(at), i))
        columns.append(at)
        scores.append(row[at])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; as floats where every sum on the way is a number that floats hold."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _search(k: int):
    """Rows with a block of queries (and their thresholds) and a block of vectors: the best of each query."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023,E731
                dim = batch.column("dim")[r].as_py()
                qids, q = get("qids", "<i8"), get("q", "<i8").reshape(-1, dim)
                ids, v = get("ids", "<i8"), get("v", "<i8").reshape(-1, dim)
                least = get("least", "<i8")
                q_length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                longest = batch.column("longest")[r].as_py()
                reach = q_length * longest * (1 + 1e-9) + 1e-9
                live = np.flatnonzero(least <= reach)
                if not len(live):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    local = np.where(reach[live] > 0, least[live] / reach[live], -1.0)
                out = []
                low = live[local < HIGH_COSINE]
                if len(low):
                    i, j, s = _best(_products(q[low], v), k, least[low], ids, qids[low])
                    out.append((qids[low][i], ids[j], s))
                high = live[local >= HIGH_COSINE]
                if len(high):
                    v_length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
                    unit = v / np.maximum(v_length, 1e-300)[:, None]
                    for i in high:
                        f = int(np.argmax(np.abs(q[i])))
                        x = q[i, f] / max(q_length[i], 1e-300)
                        c = min(1.0, least[i] / reach[i])
                        slack = math.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - c * c)) + 1e-9
                        # cosines above c only narrow the interval on the far side, so it stays one-sided
                        toward = unit[:, f] * (1 if x >= 0 else -1)
                        near = np.flatnonzero((toward >= abs(x) * c - slack) & (v_length * q_length[i] * (1 + 1e-9) >= least[i]))
                        if len(near):
                            _, j, s = _best(_products(q[i : i + 1], v[near]), k, least[i : i + 1], ids[near], qids[i : i + 1])
                            out.append((np.full(len(j), qids[i]), ids[near][j], s))
                for a, b, s in out:
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(a), "id": pa.array(b), "score": pa.array(s)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank int (from 1), id, score long: for each query its k candidates of the largest products.

    queries, candidates: (id, v array<bigint>), as of quantize(). Ties go to the
    smaller id; a candidate with the query's own id is left out; only vectors of the
    query's dimension are candidates; a query with fewer candidates has all. Ids
    should be distinct; of candidates of one id each counts, of queries of one id
    the answers are put together. Empty tables give an empty result.
    """
    scratch = Scratch(queries.sparkSession, "topk")
    blocks = scratch.save(_blocks(candidates, BLOCK_VECTORS, True))
    asked = _blocks(queries, BLOCK_QUERIES, False).select("dim", F.col("part").alias("qpart"), F.col("ids").alias("qids"), F.col("v").alias("q"))
    asked = scratch.save(asked.withColumn("least", F.lit(None).cast("binary")))

    # the longest blocks of each dimension that hold k vectors beside the query
    by_length = W.partitionBy("dim").orderBy(F.desc("longest"), "bucket", "part")
    ahead = F.coalesce(F.sum("many").over(by_length.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = blocks.select("dim", "bucket", "part", "longest", "many").withColumn("first", ahead <= k)
    listed = scratch.save(listed.select("dim", "bucket", "part", "longest", "first"))

    def searched(questions: DataFrame, first: bool) -> DataFrame:
        # a block of queries goes to the blocks of vectors of its dimension that are long enough for one of its thresholds
        targets = listed.where(F.col("first") == first).select("dim", "bucket", "part", F.col("longest").alias("reached"))
        sent = questions.join(targets, "dim")
        if not first:
            sent = sent.where("reached >= asks")
        sent = sent.drop("reached", "asks")
        pairs = sent.join(blocks, ["dim", "bucket", "part"])
        found = pairs.select("dim", "qids", "q", "least", "ids", "v", "longest").mapInArrow(_search(k), "query_id long, id long, score long")
        return _kept(found, k)

    opened = asked.drop("least").withColumn("least", _lowest("qids"))
    one = scratch.save(searched(opened, True))
    kth = one.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    spread = asked.select("dim", "qpart", "qids", "q")
    owners = queries.select(F.col("id").alias("query_id"), F.size("v").alias("dim"))
    parts = spread.groupBy("dim").agg(F.count("*").cast("int").alias("parts"))
    owners = owners.join(F.broadcast(parts), "dim").withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    told = owners.join(kth, "query_id", "left").select("dim", "qpart", "query_id", "kth")
    thresholds = told.groupBy("dim", "qpart").agg(F.collect_list(F.struct("query_id", "kth")).alias("t"))  # a block's queries at most
    bounded = spread.join(thresholds, ["dim", "qpart"]).mapInArrow(_bounded, "dim int, qids binary, q binary, least binary, asks double")
    two = searched(bounded, False)
    both = one.select("query_id", "id", "score").unionByName(two.select("query_id", "id", "score"))
    return _kept(both, k).select("query_id", "rank", "id", "score")


def _lowest(ids: str):
    """Thresholds below any product, 8 bytes for each of the packed ids: little-endian -(2**62)."""
    return F.unhex(F.repeat(F.lit((-(1 << 62) & (1 << 64) - 1).to_bytes(8, "little").hex()), F.floor(F.octet_length(ids) / 8).cast("int")))


def _bounded(batches):
    """Blocks of queries with their thresholds, and the length below which no vector can reach one of them."""
    for batch in batches:
        least, asks = [], []
        for r in range(batch.num_rows):
            ids = np.frombuffer(batch.column("qids")[r].as_buffer(), "<i8")
            q = np.frombuffer(batch.column("q")[r].as_buffer(), "<i8").reshape(len(ids), -1).astype(np.float64)
            known = {x["query_id"]: x["kth"] for x in batch.column("t")[r].as_py() if x["kth"] is not None}
            own = np.array([known.get(i, -(1 << 62)) for i in ids.tolist()], "<i8")
            least.append(own.tobytes())
            # as _search() has it: least <= length of the query * longest, with slack; a zero query reaches 0 with any vector
            size = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(size > 0, (own - 1e-9) / size * (1 - 1e-9), np.where(own <= 0, -np.inf, np.inf))
            need = np.where(own <= 0, -np.inf, need)
            asks.append(float(need.min(initial=np.inf)))
        yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("qids"), batch.column("q"), pa.array(least, pa.binary()), pa.array(asks, pa.float64())], ["dim", "qids", "q", "least", "asks"])


def _kept(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
