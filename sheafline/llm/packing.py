"""Packing of tokenized documents into sequences of fixed capacity.

Method: best-fit packing with large-item matching. At most two pieces longer
than a third of the capacity fit into one bin, so these are paired first, greedily:
the longest left takes the longest that still fits. All smaller pieces, longest
first, then go into the bin with the smallest gap that holds them, or open a new one.

The plan is made on the histogram of lengths alone: bins that are filled alike
are one entry with a count. The histogram has as many numbers as the capacity, so
the driver's work doesn't grow with the corpus. Executors then give every piece its
rank among the pieces of its length and read its place from the plan.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe_merges import MergeTable, Remembered
from .byte_bpe import UNICODE_SPACE
from .components import Scratch
from .textbytes import FOLD, ranges, text_chunks, word_spans

# ---------------------------------------------------------------- tokenizing


class WordBpe:
    """BPE with word ends, from a tokenizers file with a byte-level alphabet: lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.table = MergeTable(list(pairs), *zip(*pairs.values(), strict=True))
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pattern = next(x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}"))
        self.of_letter = {c: b for b, c in enumerate(letters)}
        self.memory = Remembered()
        self.path = path

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[list[bytes]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii()]
        # plain words are split as one text: no part has white space, and the parts of a word make up all of it
        found = self.split.findall(b" ".join(words[i] for i in plain).decode().lower())
        stops = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), np.cumsum(np.fromiter((len(words[i]) for i in plain), np.int64, len(plain)))) + 1
        found = [m.encode() for m in found]
        begin = 0
        for i, stop in zip(plain, stops.tolist(), strict=True):
            parts[i] = found[begin:stop]
            begin = stop
        for i, w in enumerate(words):
            if not parts[i]:
                parts[i] = self._matches(w.decode())
        distinct = list(dict.fromkeys(p for ps in parts for p in ps))
        counts = np.array([len(p) for p in distinct], np.int64)
        raw = np.frombuffer(b"".join(distinct), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(counts) - 1
        symbols[ends] = self.last[raw[ends]]
        ids, sizes = self.table.encode(symbols, counts)
        starts = np.cumsum(sizes) - sizes
        place = {p: i for i, p in enumerate(distinct)}
        at = np.fromiter((place[p] for ps in parts for p in ps), np.int64)
        groups = np.repeat(np.arange(len(words)), [len(ps) for ps in parts])
        taken = sizes[at]
        return ids[ranges(starts[at], taken)], np.bincount(groups, weights=taken, minlength=len(words)).astype(np.int64)

    def _matches(self, word: str) -> list[bytes]:
        """The parts of a word that are merged each by itself."""
        if word.isascii() or not any(unicodedata.category(c) == "Cn" for c in word):
            return [m.encode() for m in self.split.findall(_normal(word))]
        # letters newer than Python's tables are folded and split by the library's; merging is as for all
        library = _library(self.path)
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(word))
        return [bytes(self.of_letter[c] for c in part) for part, _ in found]

    def encode(self, texts: pa.Array):
        """Per run of texts: first row, row after the last, all ids, and how many each text has."""
        for row, last, data, offsets in text_chunks(texts):
            starts, ends, first = word_spans(data, offsets)
            if not len(starts):
                yield row, last, np.zeros(0, np.int32), np.zeros(last - row, np.int64)
                continue
            ids, counts = self.memory.look_up(
                FOLD[data],
                starts,
                ends,
                lambda at: self._encode_words([data[s:e].tobytes() for s, e in zip(starts[at], ends[at], strict=True)]),  # noqa: B023
            )
            before = np.r_[0, np.cumsum(counts)][first]
            yield row, last, ids, np.diff(before)


def _normal(word: str) -> str:
    """NFC, then lower case letter by letter (no rule for a word's last letter)."""
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [of[b] for b in range(256)]


@lru_cache(maxsize=1)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


def tokenize(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of every document: id, piece int, start long, length long, ids_crc32 long and, if asked for, ids binary.

    A document is its text's ids and then ``end_id``; only one longer than the
    capacity is cut, into pieces of the capacity and a last one that may be
    shorter. ids are packed as little-endian unsigned 32-bit numbers; ids_crc32
    is their CRC. A null or empty text has ``end_id`` alone; a null id stays null;
    extra columns are left out.
    """

    def run(batches):
        for batch in batches:
            names = batch.column(0)
            for row, last, ids, counts in _loaded(path).encode(batch.column(1)):
                at = np.cumsum(counts) + np.arange(len(counts))
                whole = np.full(len(ids) + len(counts), end_id, "<u4")
                keep = np.ones(len(whole), bool)
                keep[at] = False
                whole[keep] = ids
                sizes = counts + 1
                starts = np.cumsum(sizes) - sizes
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, sizes[owner] - piece * capacity)
                begin = starts[owner] + piece * capacity
                raw = whole.tobytes()
                parts = [raw[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = {
                    "id": names.slice(row, last - row).take(pa.array(owner)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(piece * capacity),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_column)


# ---------------------------------------------------------------- the plan


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many bins, the lengths in each of them) for pieces of these lengths and numbers."""
    if any(n < 1 or n > capacity for n, k in histogram.items() if k):
        raise ValueError("lengths must be from 1 to the capacity")
    large = {n: k for n, k in histogram.items() if 3 * n > capacity and k}
    bins: dict[tuple[int, tuple[int, ...]], int] = defaultdict(int)  # (gap, lengths) -> how many
    # greedy matching: the longest piece takes the longest other that fits
    lengths = sorted(large)
    while lengths:
        n = lengths[-1]
        k = bisect.bisect_right(lengths, capacity - n) - 1
        if k < 0:
            bins[capacity - n, (n,)] += large[n]
            lengths.pop()
            continue
        m = lengths[k]
        pairs = large[n] // 2 if m == n else min(large[n], large[m])
        if m == n and pairs == 0:
            # one left over; the next shorter one may still join it
            if k == 0:
                bins[capacity - n, (n,)] += 1
                lengths.pop()
                continue
            m, k, pairs = lengths[k - 1], k - 1, 1
        bins[capacity - n - m, (n, m)] += pairs
        large[n] -= pairs
        large[m] -= pairs
        lengths = [x for x in lengths if large[x]] if not large[n] or not large[m] else lengths
    # best fit, longest first, of the smaller ones
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for (gap, inside), k in bins.items():
        if k:
            gaps[gap][inside] = gaps[gap].get(inside, 0) + k
    order = sorted(gaps)
    for n in sorted((n for n, k in histogram.items() if 3 * n <= capacity and k), reverse=True):
        left = histogram[n]
        while left:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                gap, inside, count = capacity, (), left  # as many new bins as still needed
            else:
                gap = order[at]
                inside, count = next(iter(gaps[gap].items()))
            # one bin after another is filled as far as it goes, so alike bins take alike numbers
            each = gap // n
            full = min(count, left // each)
            rest = left - full * each
            made = []
            if full:
                made.append((full, each))
            if rest and full < count:
                made.append((1, rest))
            used = sum(k for k, _ in made)
            if inside or gap < capacity:
                if count == used:
                    del gaps[gap][inside]
                    if not gaps[gap]:
                        del gaps[gap]
                        order.remove(gap)
                else:
                    gaps[gap][inside] = count - used
            for k, times in made:
                new_gap, new_inside = gap - times * n, inside + (n,) * times
                if new_gap not in gaps or not gaps[new_gap]:
                    bisect.insort(order, new_gap)
                gaps[new_gap][new_inside] = gaps[new_gap].get(new_inside, 0) + k
                left -= k * times
    return sorted((k, inside) for classes in gaps.values() for inside, k in classes.items())


def slots(bins: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan by place: the pieces of ``length`` with ranks from ``rank`` on, ``many`` of them, go to
    the sequences from ``sequence`` on, one to each, at ``offset``. In order of length and rank."""
    rows, taken, sequence = [], defaultdict(int), 0
    for many, inside in bins:
        offset = 0
        for n in inside:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += many
            offset += n
        sequence += many
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), columns.T, strict=True))


# ---------------------------------------------------------------- packing in Spark


def pack(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), rows_per_bucket: int = 50_000) -> DataFrame:
    """``pieces`` (with a column length, from 1 to the capacity) and for each its sequence_id and offset.

    Offsets within a sequence are without gaps from 0. Pieces of equal length are
    told apart by ``keys``; rows that are equal in keys and length are
    interchangeable, and each has a place. An empty table gives an empty result.

    The pieces should be a saved table: they are read twice.
    """
    spark = pieces.sparkSession
    # at most ``capacity`` rows
    histogram = {r.length: r.many for r in pieces.groupBy("length").agg(F.count("*").alias("many")).collect()}
    places = slots(plan(histogram, capacity))
    total = sum(histogram.values())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_bucket))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # rank among equal lengths: pieces before this bucket, then the place within it
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_many"))
    by_length = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_many").over(by_length), F.lit(0))).drop("_many")
    within = W.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = dealt.withColumn("_within", F.row_number().over(within) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_within") + F.col("_before")).drop("_within", "_before", "_bucket")
    # the plan has an entry for each piece of each kind of bin; its size is bounded by the capacity
    shared = spark.sparkContext.broadcast(places)
    names = pieces.columns
    schema = T.StructType([*[ranked.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            low = np.searchsorted(p["length"], length)
            wide = int(rank.max()) + 2
            span = max(wide, int(p["rank"].max()) + 2)
            at = np.searchsorted(p["length"] * span + p["rank"], length * span + rank, side="right") - 1
            assert (at >= low).all()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], names=[*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the packed ids of every sequence; ``packed`` needs the column ids of tokenize()."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most a capacity of ids
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", whole.alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Documents tokenized, cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(tokenize(docs, path, capacity)), capacity)
