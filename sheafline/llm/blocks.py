"""Documents dealt into blocks, and packed questions from one block to another.

A block is a set of documents small enough for one task. Where documents must
be held against values from anywhere in the corpus, each block asks once for
every distinct value it has (packed arrays, one row for each bucket of values),
and the bucket answers with what the block must know. A value that fills a third
of the corpus thus costs one entry for each block, never one for each row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix

#: Bytes of input files that make one block.
BLOCK_BYTES = 8 << 20
#: A row group of this many rows stands in where Spark doesn't know the size of a table.
BLOCK_ROWS = 5000


def block_count(table: DataFrame) -> int:
    """Blocks for a table: by the size Spark knows of its files, and never fewer than its shuffle partitions."""
    spark = table.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        return max(floor, math.ceil(table.count() / BLOCK_ROWS))
    return max(floor, math.ceil(size / BLOCK_BYTES))


def with_block(table: DataFrame, key: str, blocks: int, name: str = "_block") -> DataFrame:
    """Adds the block of every row, from the hash of its key."""
    return table.withColumn(name, F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))


def bucket_bits(blocks: int) -> int:
    """Bits of a hash that name its bucket, for about as many buckets as blocks."""
    return max(1, math.ceil(math.log2(max(blocks, 2))))


def split_by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for every bucket that occurs; hashes must be in ascending order."""
    if len(hashes) == 0:
        return
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for part in np.split(np.arange(len(hashes)), cuts):
        yield int(buckets[part[0]]), part


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpack_column(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in one array, and how many each row has."""
    pieces = [np.frombuffer(x.as_buffer(), dtype=dtype) if x.is_valid else np.zeros(0, dtype) for x in column]
    counts = np.array([len(x) for x in pieces], dtype=np.int64)
    return (np.concatenate(pieces) if pieces else np.zeros(0, dtype)), counts


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every value its place in the ascending keys, or -1."""
    if len(keys) == 0:
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)


def answer_shared(asks: DataFrame) -> DataFrame:
    """Which of the values that blocks ask for are asked for twice or more.

    asks: bucket int, block int, hashes binary (unsigned 64-bit numbers; a value
    that its own block has twice is sent twice). Returns block, hashes (ascending
    within a row): those of the block's values that occur twice or more overall.
    """

    def answer(table: pa.Table) -> pa.Table:
        hashes, counts = unpack_column(table["hashes"], "<u8")
        distinct, where, times = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = times[where] > 1
        blocks = np.repeat(table["block"].to_numpy(), counts)[shared]
        hashes = hashes[shared]
        order = np.lexsort((hashes, blocks))
        blocks, hashes = blocks[order], hashes[order]
        names, first = np.unique(blocks, return_index=True)
        parts = np.split(hashes, first[1:]) if len(names) else []
        return pa.table({"block": pa.array(names, pa.int32()), "hashes": pa.array([pack(np.unique(x)) for x in parts], pa.binary())})

    return asks.groupBy("bucket").applyInArrow(answer, "block int, hashes binary")


def id_array(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; a null id stands below all others."""
    return column.fill_null(-(1 << 63)).to_numpy()


#: Bits of a membership filter: so many for each id, between the two bounds.
FILTER_BITS_EACH, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 27


class Membership:
    """A Bloom filter of the ids in a table: at most FILTER_MOST bits (16 MB), however many ids there are.

    Where it is full it takes more ids for members, never fewer. Null is none. The
    filter is broadcast once, packed, and serves any number of tables.
    """

    def __init__(self, ids: DataFrame, column: str) -> None:
        spark = ids.sparkSession
        bits = self.bits = 1 << max(FILTER_LEAST, min(FILTER_MOST, FILTER_BITS_EACH * max(ids.count(), 1))).bit_length() - 1
        def build(batches):
            seen = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                x = batch.column(0).drop_null().to_numpy()
                for at in _filter_places(x, bits):
                    np.bitwise_or.at(seen, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"filter": pa.array([seen.tobytes()], pa.binary())})

        def union(batches):
            whole = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                for x in batch.column(0):
                    whole |= np.frombuffer(x.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_pydict({"filter": pa.array([whole.tobytes()], pa.binary())})

        parts = ids.select(column).coalesce(8).mapInArrow(build, "filter binary")
        row = parts.coalesce(1).mapInArrow(union, "filter binary").first()
        self.shared = spark.sparkContext.broadcast(bytes(row[0]) if row else bytes(bits // 8))

    def test(self):
        """For executors: a function of an id column that tells which rows may be members."""
        bits, shared = self.bits, self.shared

        def may_hold(column) -> np.ndarray:
            seen = np.frombuffer(shared.value, np.uint8)
            good = column.is_valid().to_numpy(zero_copy_only=False).copy()
            for at in _filter_places(column.fill_null(0).to_numpy(), bits):
                good &= (seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            return good

        return may_hold

    def split(self, table: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows of ``table`` that may be members, and those that are surely none."""
        test, at = self.test(), table.columns.index(column)

        def keep(inside: bool):
            def run(batches):
                for batch in batches:
                    good = test(batch.column(at))
                    yield batch.filter(pa.array(good if inside else ~good))

            return run

        return table.mapInArrow(keep(True), table.schema), table.mapInArrow(keep(False), table.schema)


def _filter_places(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(x.astype(np.int64).view(np.uint64))
    return [(mix(h + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in (1, 2, 3)]
