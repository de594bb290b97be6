"""Products of dense vectors in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import ranked

#: Rows of a block of vectors: at least and at most; between, a side has about 64 blocks.
LEAST_BLOCK, BLOCK = 2048, 8192
#: Queries and vectors of one matrix product.
TILE = 1024, 2048


def _blocks(n: int) -> int:
    return max(1, math.ceil(n / min(BLOCK, max(LEAST_BLOCK, n // 64))))


def _packed(table: DataFrame, blocks: int, id_column: str, vec_column: str, prefix: str) -> DataFrame:
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        rows = [np.asarray(v, "<f8") for v in t["v"].to_pylist()]
        m = np.array(rows)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return pa.table({f"{prefix}block": t["b"].slice(0, 1), f"{prefix}ids": pa.array([t["id"].to_numpy().astype("<i8").tobytes()]), f"{prefix}v": pa.array([m.tobytes()])})

    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vec_column).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return rows.groupBy("b").applyInArrow(pack, f"{prefix}block int, {prefix}ids binary, {prefix}v binary")


def _nearest(q: np.ndarray, qids: np.ndarray, v: np.ndarray, vids: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score): the k best of each by rounded product, ties to the earlier row of v; never one's own id.

    Only products that reach a query's k-th best so far are looked at, and k of a query stay after each tile.
    """
    row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(q), -np.inf)
    for i in range(0, len(v), TILE[1]):
        exact = q @ v[i : i + TILE[1]].T
        exact[qids[:, None] == vids[None, i : i + TILE[1]]] = -np.inf
        if i == 0 and exact.shape[1] > k:
            least = np.round(np.partition(exact, -k, axis=1)[:, -k], decimals)
        r, c = np.nonzero((exact >= (least - 10.0**-decimals)[:, None]) & (exact > -np.inf))
        row, at, score = np.r_[row, r], np.r_[at, i + c], np.r_[score, np.round(exact[r, c], decimals)]
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == k - 1
        least[row[last]] = score[last]
        row, at, score = row[place < k], at[place < k], score[place < k]
    return row, at, score


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_column: str, vec_column: str, decimals: int = 6) -> DataFrame:
    """(qid, id, score, rank): for every query its k nearest others by cosine, ties to the smaller id.

    Both sides are packed into blocks of unit vectors; every pair of blocks is multiplied in tiles, of which each
    query keeps k rows.
    """
    q_blocks = _blocks(queries.count())
    v_blocks = _blocks(vectors.count())
    asked = _packed(queries, q_blocks, id_column, vec_column, "q")
    held = _packed(vectors, v_blocks, id_column, vec_column, "v")
    # the blocks' numbers are known, so each query block is sent to every vector block by an equi-join
    sent = asked.withColumn("vblock", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    def products(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                qids, vids = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i8") for c in ("qids", "vids"))
                q, v = (np.frombuffer(batch.column(c)[r].as_buffer(), "<f8").reshape(len(i), -1) for c, i in (("qv", qids), ("vv", vids)))
                for i in range(0, len(qids), TILE[0]):
                    row, at, score = _nearest(q[i : i + TILE[0]], qids[i : i + TILE[0]], v, vids, k, decimals)
                    yield pa.RecordBatch.from_pydict({"qid": pa.array(qids[i + row]), "id": pa.array(vids[at]), "score": pa.array(score)})

    found = sent.join(held, "vblock").select("qids", "qv", "vids", "vv").mapInArrow(products, "qid long, id long, score double")
    return ranked(found, k)


def mean_vectors(vectors: DataFrame, by: str, vec_column: str) -> DataFrame:
    """(by, slot, mean): the mean vector of every group, by component."""
    rows = vectors.select(by, F.posexplode(vec_column).alias("slot", "x"))
    return rows.groupBy(by, "slot").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_order(vectors: DataFrame, id_column: str, by: str, vec_column: str) -> DataFrame:
    """(by, id, score, place): members by their product with the group's normalised mean."""
    from pyspark.sql import Window as W

    means = mean_vectors(vectors, by, vec_column)
    norm = means.groupBy(by).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    rows = vectors.select(by, F.col(id_column).alias("id"), F.posexplode(vec_column).alias("slot", "x"))
    # a group's mean is one row for each component
    scored = rows.join(means, [by, "slot"]).groupBy(by, "id").agg(F.sum(F.col("x").cast("double") * F.col("mean")).alias("s")).join(norm, by)
    scored = scored.select(by, "id", F.round(F.col("s") / F.col("norm"), 6).alias("score"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "id")))
