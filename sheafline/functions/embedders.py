"""Hash embedders as sparse unit vectors: (id, slot, weight)."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_tokens, normalize, tokens
from .vectors import ASCII_HASH_SLOTS, hash_slots

#: Slots of the two embedders whose hash is BLAKE2b.
TOKEN_SLOTS = 512
CHAR_SLOTS = 1024


@lru_cache(maxsize=1 << 17)
def bucket(piece: str, slots: int) -> int:
    """The first eight bytes' BLAKE2b number modulo the slots."""
    return int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest()) % slots


#: Pieces whose slots a task remembers.
REMEMBERED = 1 << 17
#: Rows of a batch that leaves a task at once.
ROWS = 1 << 17
#: Letters or tokens, and texts, that a task counts at once; a longer text is counted in parts.
STEP, STEP_TEXTS = 1 << 20, 1 << 10


def _portions(sizes: np.ndarray):
    """(first, end) of rows that together have STEP letters or tokens at most, or of one row that has more."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (total + size > STEP or i - first >= STEP_TEXTS):
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes):
        yield first, len(sizes)


def _slots(known: dict, keys: list, piece, n_slots: int) -> np.ndarray:
    """The slots of distinct keys; piece(key) is its text. Slots are remembered by key."""
    if len(known) > REMEMBERED:
        known.clear()
    new = {k: bucket(piece(k), n_slots) for k in keys if k not in known}
    known.update(new)
    return np.fromiter((known[k] for k in keys), np.int64, len(keys))


def _weighted(texts: DataFrame, size, count, n_slots: int, id_column: str, damped: bool) -> DataFrame:
    """(id_column, slot, weight) of texts (id, text), null ids left out; a weight is 1 + ln(count) if damped, else the count.

    size(column) has the letters or tokens of each text, count(known, column) the numbers of a portion's texts by slots.
    Texts are counted and weighted where they are read; only if an id has several rows, their counts are shuffled and summed first.
    """
    texts = texts.where("id is not null")
    several = not texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    last, kind = ("n", pa.int64()) if several else ("weight", pa.float64())

    def run(batches):
        known: dict = {}
        for batch in batches:
            for first, end in _portions(size(batch.column("text")).to_numpy(zero_copy_only=False)):
                ids, found = batch.column("id").slice(first, end - first), count(known, batch.column("text").slice(first, end - first))
                rows, slots = np.nonzero(found)
                values = found[rows, slots]
                if not several:
                    w = 1 + np.log(values) if damped else values.astype(np.float64)
                    values = w / np.sqrt(np.bincount(rows, w * w, len(ids)))[rows]
                for i in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows[i : i + ROWS])), pa.array(slots[i : i + ROWS].astype(np.int32)), pa.array(values[i : i + ROWS], kind)], ["id", "slot", last]
                    )

    made = texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, slot int, {last} {'long' if several else 'double'}")
    if not several:
        return made.withColumnRenamed("id", id_column)
    counts = made.repartition("id").groupBy("id", "slot").agg(F.sum("n").cast("double").alias("n"))
    counts = counts.select("id", "slot", F.expr("1 + ln(n)" if damped else "n").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))  # a number for each slot at most
    return counts.select(F.col("id").alias(id_column), "slot", (F.col("w") / norm).alias("weight"))


def token_hash(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Tokens of any script in 512 slots, 1 + ln(count) each; a text without tokens has no vector."""

    def count(known, words):
        found = np.zeros(len(words) * TOKEN_SLOTS, np.int64)
        flat = words.flatten()
        rows = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        for i in range(0, len(flat), STEP):
            coded = flat.slice(i, STEP).dictionary_encode()
            slots = _slots(known, coded.dictionary.to_pylist(), str, TOKEN_SLOTS)[coded.indices.to_numpy(zero_copy_only=False)]
            found += np.bincount(rows[i : i + STEP] * TOKEN_SLOTS + slots, minlength=len(found))
        return found.reshape(len(words), TOKEN_SLOTS)

    return _weighted(docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("text")), pc.list_value_length, count, TOKEN_SLOTS, id_column, True)


def char_hash(docs: DataFrame, id_column: str, text_column: str, n: int = 4) -> DataFrame:
    """Sequences of n characters in 1024 slots, by count; a shorter text is its own only one."""
    letters_of = lambda key: key.decode("utf-32-le", "surrogatepass")

    def count(known, column):
        texts = column.to_pylist()
        ends = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        found = np.zeros(len(texts) * CHAR_SLOTS, np.int64)
        for low in range(0, len(points), STEP):
            part = points[low : low + STEP + n - 1]
            rows = np.repeat(np.arange(len(texts)), np.diff(np.clip(ends, low, low + STEP)))
            starts = np.flatnonzero(np.arange(low + n, low + n + len(rows)) <= ends[rows + 1])
            if not len(starts):
                continue
            at = (np.cumsum(np.bincount(part) > 0) - 1)[part]
            # a sequence's number grows letter by letter; before it could be too large, the numbers so far are made small
            codes, span, base = np.zeros(len(starts), np.int64), 1, int(at.max()) + 1
            for i in range(n):
                if span * base >= 1 << 62:
                    held = pa.array(codes).dictionary_encode()
                    codes, span = held.indices.to_numpy().astype(np.int64), len(held.dictionary)
                codes, span = codes * base + at[starts + i], span * base
            held = pa.array(codes).dictionary_encode()
            codes, one = held.indices.to_numpy(), np.empty(len(held.dictionary), np.int64)
            one[codes] = starts  # some place of each sequence
            raw = part[one[:, None] + np.arange(n)].tobytes()
            slots = _slots(known, [raw[i : i + 4 * n] for i in range(0, len(raw), 4 * n)], letters_of, CHAR_SLOTS)
            found += np.bincount(rows[starts] * CHAR_SLOTS + slots[codes], minlength=len(found))
        for i, t in enumerate(texts):
            if 0 < len(t) < n:
                found[i * CHAR_SLOTS + bucket(t, CHAR_SLOTS)] += 1
        return found.reshape(len(texts), CHAR_SLOTS)

    text = F.lower(normalize(F.coalesce(F.col(text_column), F.lit(""))))
    return _weighted(docs.select(F.col(id_column).alias("id"), text.alias("text")), pc.utf8_length, count, CHAR_SLOTS, id_column, False)


#: By the name that a configuration gives.
EMBEDDERS = {"ascii-hash": hash_slots, "token-hash": token_hash, "char-hash": char_hash}
SLOTS = {"ascii-hash": ASCII_HASH_SLOTS, "token-hash": TOKEN_SLOTS, "char-hash": CHAR_SLOTS}


def dense(rows: DataFrame, embedder: str = "ascii-hash") -> DataFrame:
    """(id, vec) of rows (id, text): the embedding as an array; a text without any has none."""
    sparse = EMBEDDERS[embedder](rows.select("id", "text"), "id", "text")
    whole = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"))  # a number for each slot at most
    return whole.select("id", F.transform(F.sequence(F.lit(0), F.lit(SLOTS[embedder] - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


def with_dense(rows: DataFrame) -> DataFrame:
    """Rows (id, text and others) with ``vec``, their ASCII-hash embedding as dense() has it; null for a text without any.

    Vectors are made where the rows are read; only if an id has several rows, or is null, they are joined.
    """
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
        return rows.join(dense(rows), "id", "left")
    size = SLOTS["ascii-hash"]

    def run(batches):
        known: dict = {}
        for batch in batches:
            words = batch.column("_tokens")
            coded = words.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            slots = np.zeros(len(coded.dictionary), np.int64)
            for i, t in enumerate(coded.dictionary.to_pylist()):
                slot = known.get(t)
                if slot is None:
                    slot = known[t] = hashlib.md5(t.encode()).digest()[-1] % size
                slots[i] = slot
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            cells = row * size + slots[coded.indices.to_numpy(zero_copy_only=False)]
            m = np.bincount(cells.astype(np.int64), minlength=batch.num_rows * size).reshape(batch.num_rows, size).astype(np.float64)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            full = norm[:, 0] > 0
            flat = (m[full] / norm[full]).ravel()
            vec = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full * size)].astype(np.int32)), pa.array(flat), mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], vec], [*names, "vec"])

    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    for f in schema.fields:
        f.nullable = True
    return rows.withColumn("_tokens", ascii_tokens(F.col("text"))).mapInArrow(run, schema)
