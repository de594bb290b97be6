"""Token ids of documents in binary files with a shared compression dictionary.

Method: a zstandard dictionary is trained on the serialized ids of a bounded sample
of documents; then every document is compressed by itself with this dictionary, so
that any one of them is read without the others. Files hold frames in ascending order
of ids; an index beside each names every document's frame and its place among all
tokens. Each file starts with the dictionary's SHA-256, which readers compare.

A data set is a folder:

* ``manifest.json``: format, number type, dictionary, and for each shard, in ascending
  order of ids, its files, its smallest and largest id, its documents and tokens and the tokens
  before it;
* ``dictionary-<sha256>.zdict``;
* ``<shard>-<attempt>.bin``: MAGIC, the 32 bytes of the dictionary's hash, frames;
* ``<shard>-<attempt>.idx``: the numbers of INDEX, one column after another.

Only files that the manifest names count, so those of lost or repeated attempts do no
harm. Documents go to shards by ranges of ids; what is shuffled is compressed already.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .bpe_merges import Remembered
from .byte_bpe import _BREAKS, _plain_end
from .components import small_batches
from .textbytes import text_chunks
from .warc import filesystem

MAGIC = b"sheafids"
MANIFEST = "manifest.json"
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
#: The index's columns: id, tokens of the shard before it, tokens, place of the frame, its bytes.
INDEX = ("doc_id", "start", "n_tokens", "place", "bytes")
LEVEL = 3
#: Documents and parts of 1024 ids of each that the dictionary is trained on at most; its size.
SAMPLE_DOCS, SAMPLE_PARTS, PART_IDS, DICTIONARY_BYTES = 512, 8, 1024, 64 << 10
#: Bytes of text that make one shard, about.
SHARD_BYTES = 256 << 20
_BATCH_BYTES = 4 << 20

# ---------------------------------------------------------------- tokenizing


class LibraryBpe:
    """Ids by the tokenizers library, which is asked once for every piece of text that is met.

    Texts are cut before blanks that follow other than white space, where no token of a
    byte-level vocabulary reaches across. The library reads many new pieces as one text; as
    tokens stand for bytes, their lengths tell where a piece ends. A piece that
    doesn't begin with a blank, or ends with white space, is read by itself. Strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b) for b in plain} | {chr(0x100 + i) for i in range(256 - len(plain))}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        if any(set(t) - letters for t in vocabulary):
            raise ValueError("the vocabulary is not byte-level")
        self.size = self.library.get_vocab_size()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.memory = Remembered()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        joins = np.array([p[:1] == b" " and p[-1] > 0x20 and (p[-1] < 0x80 or bool(_plain_end(np.frombuffer(p[-2:], np.uint8))[-1])) for p in pieces])
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        many = int(joins.sum())
        texts = [b"".join(pieces[i] for i in order[k : min(k + 4096, many)]).decode() for k in range(0, many, 4096)]
        ids = self._ids(texts + [pieces[i].decode() for i in order[many:]])
        joined = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.cumsum(self.bytes_of[joined])
        stops = np.searchsorted(ends, np.cumsum(sizes[order])) + 1
        counts = np.diff(np.r_[0, stops])
        if len(ends) and (ends[stops - 1] != np.cumsum(sizes[order])).any():
            raise ValueError("a token reaches across pieces")
        # back into the order of the pieces
        at = np.empty(len(pieces), np.int64)
        at[order] = np.arange(len(pieces))
        starts = (stops - counts)[at]
        counts = counts[at]
        total = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return joined[total], counts

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per run of texts: first row, row after the last, all ids, and how many each text has."""
        for row, last, data, offsets in text_chunks(texts):
            if not len(data):
                yield row, last, np.zeros(0, np.int32), np.zeros(last - row, np.int64)
                continue
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = (data[1:] == 0x20) & ~_BREAKS[data[:-1]] & _plain_end(data)[:-1]
            cut[offsets] = True
            starts = np.flatnonzero(cut)
            starts, ends = starts[:-1], starts[1:]
            ids, counts = self.memory.look_up(data, starts, ends, lambda at: self._encode_pieces([data[s:e].tobytes() for s, e in zip(starts[at], ends[at], strict=True)]))  # noqa: B023
            before = np.r_[0, np.cumsum(counts)]
            yield row, last, ids, np.diff(before[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=1)
def _loaded(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def number_type(path: str) -> str:
    """What ids are written as: two bytes where the vocabulary allows, else four."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _arrays(path: str, texts: pa.Array, end_id: int | None, kind: str) -> Iterator[tuple[int, bytes, int]]:
    """Row, serialized ids and their number for every text."""
    width = np.dtype(kind).itemsize
    for row, last, ids, counts in _loaded(path).encode(texts):
        whole = ids
        if end_id is not None:
            whole = np.full(len(ids) + len(counts), end_id, np.int64)
            keep = np.ones(len(whole), bool)
            keep[np.cumsum(counts) + np.arange(len(counts))] = False
            whole[keep] = ids
            counts = counts + 1
        raw = whole.astype(kind).tobytes()
        stops = np.cumsum(counts) * width
        for k, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist(), strict=True)):
            yield row + k, raw[stop - count * width : stop], count


# ---------------------------------------------------------------- the dictionary


def train_dictionary(docs: DataFrame, path: str, end_id: int | None = 0, kind: str = "<u2", id_column: str = "doc_id", text_column: str = "text") -> bytes:
    """A zstandard dictionary for the serialized ids of documents like these; empty if there is nothing to learn from.

    Learned from at most SAMPLE_DOCS documents, those of the smallest hashes of their ids,
    and SAMPLE_PARTS parts of PART_IDS ids of each, evenly spread over it. What is too
    little for training is taken as it is.
    """
    names = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"))
    named = names.where("id is not null").select(F.xxhash64("id").alias("h"), "id").distinct().orderBy("h", "id").limit(SAMPLE_DOCS)
    chosen = [r.id for r in named.collect()]  # at most SAMPLE_DOCS numbers
    if not chosen:
        return b""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).where(F.col("id").isin(chosen))

    def parts(batches):
        step = PART_IDS * np.dtype(kind).itemsize
        for batch in batches:
            kept = [(i, k, raw[k : k + step]) for i, raw, _ in _arrays(path, batch.column(1), end_id, kind) for k in _spread(len(raw), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in kept], pa.int64())), pa.array([k for _, k, _ in kept], pa.int64()), pa.array([x for _, _, x in kept], pa.binary())], ["id", "k", "part"])

    # one row of each id and place, whatever rows repeat
    told = rows.mapInArrow(parts, "id long, k long, part binary").groupBy("id", "k").agg(F.min("part").alias("part")).collect()
    samples = [bytes(r.part) for r in sorted(told, key=lambda r: (r.id, r.k)) if r.part]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _spread(size: int, step: int) -> list[int]:
    places = range(0, size, step)
    return [places[i * len(places) // min(len(places), SAMPLE_PARTS)] for i in range(min(len(places), SAMPLE_PARTS))]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None  # raw content, if it was not trained


# ---------------------------------------------------------------- writing


def frames(docs: DataFrame, path: str, dictionary: bytes, end_id: int | None = 0, kind: str = "<u2", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens long, frame binary) of every row: its ids, with ``end_id`` behind, as one compressed frame. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_checksum=True)
        for batch in batches:
            counts, out = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for i, raw, count in _arrays(path, batch.column(1), end_id, kind):
                counts[i], out[i] = count, packer.compress(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(out, pa.binary())], ["id", "n_tokens", "frame"])

    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return base.mapInArrow(run, "id long, n_tokens long, frame binary")


def shard_bounds(docs: DataFrame, shards: int, id_column: str = "doc_id") -> list[int]:
    """Ids that cut the documents into about even shards; at most shards - 1 numbers."""
    if shards < 2:
        return []
    cuts = [i / shards for i in range(1, shards)]
    row = docs.select(F.percentile_approx(F.col(f"`{id_column}`").cast("long"), cuts, 20 * shards).alias("c")).first()
    return sorted(set(row.c or []))


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = 0, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all documents to ``folder``, in ascending order of ids.

    A null or empty text has ``end_id`` alone. A null id comes before all others. Rows
    of one id, and repeated rows, are a document each, ordered by their frames; they share a
    shard, so one id's rows have to fit into one file. Extra columns are left out; an
    empty table gives a data set without shards.
    """
    spark = docs.sparkSession
    kind = number_type(path)
    dictionary = train_dictionary(docs, path, end_id, kind, id_column, text_column)
    text = F.col(f"`{text_column}`").cast("string")
    size = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("s")).first().s or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, math.ceil(size / shard_bytes)) if size else 1
    bounds = shard_bounds(docs, shards, id_column)
    told = frames(docs, path, dictionary, end_id, kind, id_column, text_column)
    if bounds:
        # the number of cuts at or below the id, by bisection in the sorted cuts
        shared = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
        shard = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b")), lambda s, _: _halved(s, shared))["a"]
        told = told.withColumn("shard", F.when(F.col("id").isNull(), 0).otherwise(shard).cast("int"))
    else:
        told = told.withColumn("shard", F.lit(0))
    register(spark)
    dealt = told.select("shard", "id", "n_tokens", "frame").repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "id", "frame")
    with small_batches(spark):
        dealt.write.format("token_ids").mode("overwrite").option("path", folder).option("kind", kind).option("dictionary", dictionary.hex()).save()


def _halved(s, cuts):
    """One step of a bisection for the first place from which all cuts are larger than the id."""
    middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
    right = (s["a"] < s["b"]) & (F.get(cuts, middle) <= F.col("id"))
    return F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["b"]), s["b"]).otherwise(middle).alias("b"))


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class TokenWriter(DataSourceArrowWriter):
    """Takes shard, id, n_tokens, frame, ordered by the first two within a task; a shard lies in one task."""

    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.dictionary = options["path"], options["kind"], bytes.fromhex(options["dictionary"])
        self.digest = hashlib.sha256(self.dictionary)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "digest"}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        done: list[dict] = []
        out, rows = None, []
        head = MAGIC + hashlib.sha256(self.dictionary).digest()

        def close() -> None:
            nonlocal out
            if out is None:
                return
            out.close()
            out = None
            columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
            ids, counts, sizes = columns
            has_id = ids > _NO_ID
            index = [ids, np.cumsum(counts) - counts, counts, len(head) + np.cumsum(sizes) - sizes, sizes]
            with fs.open_output_stream(posixpath.join(root, done[-1]["idx"])) as f:
                f.write(b"".join(x.astype("<i8").tobytes() for x in index))
            done[-1] |= {"docs": len(ids), "tokens": int(counts.sum()), "first": int(ids[has_id][0]) if has_id.any() else None, "last": int(ids[-1]) if has_id.any() else None, "null_ids": int((~has_id).sum())}
            rows.clear()

        try:
            for batch in iterator:
                shard = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if out is None or done[-1]["shard"] != int(shard[a]):
                        close()
                        name = f"{int(shard[a]):08d}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(posixpath.join(root, name + ".bin"))
                        done.append({"shard": int(shard[a]), "bin": name + ".bin", "idx": name + ".idx"})
                        out.write(head)
                    found = batch.column("frame").slice(a, b - a)
                    parts = [x.as_buffer() for x in found]
                    out.write(b"".join(parts))
                    rows.append((batch.column("id").slice(a, b - a).fill_null(_NO_ID).to_numpy(), batch.column("n_tokens").slice(a, b - a).to_numpy(), np.array([len(x) for x in parts], np.int64)))
            close()
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        digest = hashlib.sha256(self.dictionary).hexdigest()
        with fs.open_output_stream(posixpath.join(root, f"dictionary-{digest}.zdict")) as f:
            f.write(self.dictionary)
        shards = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: s["shard"])
        start = 0
        for s in shards:
            s["start"] = start
            start += s["tokens"]
        told = {"format": 1, "kind": self.kind, "dictionary": digest, "tokens": start, "shards": shards}
        # the manifest comes last: without it there is no data set
        with fs.open_output_stream(posixpath.join(root, MANIFEST)) as f:
            f.write(json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for s in (s for m in messages if m is not None for s in m.shards):
            for name in (s["bin"], s["idx"]):
                try:
                    fs.delete_file(posixpath.join(root, name))
                except FileNotFoundError:
                    continue


#: Stands for a null id in the index.
_NO_ID = -(1 << 63)

# ---------------------------------------------------------------- reading


@dataclass
class Piece(InputPartition):
    """Documents from ``begin`` up to ``end`` of a shard."""

    shard: dict
    begin: int
    end: int


class TokenReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path = options["path"]
        self.decode = str(options.get("ids", "true")).lower() == "true"
        self.piece_docs = int(options.get("pieceDocs", 20_000))
        self.names = [f.name for f in schema.fields]
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            if isinstance(f, known) and f.attribute == ("doc_id",):
                self.filters.append(f)
            else:
                yield f

    def _manifest(self) -> dict:
        fs, root = filesystem(self.path)
        with fs.open_input_stream(posixpath.join(root, MANIFEST)) as f:
            return json.loads(f.read())

    def partitions(self) -> list[Piece]:
        out = [
            Piece(s, a, min(a + self.piece_docs, s["docs"]))
            for s in self._manifest()["shards"]
            if not self.filters or s["first"] is not None and all(_may_meet(f, s["first"], s["last"]) for f in self.filters)
            for a in range(0, s["docs"], self.piece_docs)
        ]
        return out or [Piece({}, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.shard:
            return
        fs, root = filesystem(self.path)
        told = self._manifest()
        shard, wide = piece.shard, np.dtype(told["kind"]).itemsize
        # this piece's numbers of each column of the index
        with fs.open_input_file(posixpath.join(root, shard["idx"])) as f:
            columns = {c: np.frombuffer(f.read_at(8 * (piece.end - piece.begin), 8 * (shard["docs"] * k + piece.begin)), "<i8") for k, c in enumerate(INDEX)}
        keep = np.ones(piece.end - piece.begin, bool)
        for f in self.filters:
            keep &= _meets(f, columns["doc_id"]) & (columns["doc_id"] > _NO_ID)
        at = np.flatnonzero(keep)
        unpacker = None
        with fs.open_input_file(posixpath.join(root, shard["bin"])) as f:
            if self.decode and len(at):
                with fs.open_input_stream(posixpath.join(root, f"dictionary-{told['dictionary']}.zdict")) as d:
                    raw = d.read()
                if f.read_at(len(MAGIC) + 32, 0) != MAGIC + hashlib.sha256(raw).digest():
                    raise ValueError(f"{shard['bin']} was not written with the dictionary {told['dictionary']}")
                unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
            k = 0
            while k < len(at):
                # frames that lie together are read at once
                n = max(1, int(np.searchsorted(np.cumsum(columns["n_tokens"][at[k:]]) * 4, _BATCH_BYTES, side="right")))
                part = at[k : k + n]
                k += n
                ids: list[bytes | None] = [None] * len(part)
                if unpacker is not None:
                    ids = []
                    runs = np.split(part, np.flatnonzero(np.diff(part) != 1) + 1)
                    for run in runs:
                        first = int(columns["place"][run[0]])
                        block = f.read_at(int(columns["bytes"][run].sum()), first)
                        for i in run:
                            a = int(columns["place"][i]) - first
                            frame = unpacker.decompress(block[a : a + int(columns["bytes"][i])], max_output_size=int(columns["n_tokens"][i]) * wide)
                            ids.append(np.frombuffer(frame, told["kind"]).astype("<u4").tobytes())
                names = columns["doc_id"][part]
                made = {
                    "doc_id": pa.array(names, pa.int64(), mask=names == _NO_ID),
                    "start": pa.array(columns["start"][part] + shard["start"]),
                    "n_tokens": pa.array(columns["n_tokens"][part]),
                    "ids": pa.array(ids, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([made[c] for c in self.names], self.names)


def _may_meet(f, first: int, last: int) -> bool:
    if isinstance(f, In):
        return any(first <= v <= last for v in f.value if v is not None)
    v = f.value
    if v is None:
        return False
    return {EqualTo: first <= v <= last, GreaterThan: last > v, GreaterThanOrEqual: last >= v, LessThan: first < v, LessThanOrEqual: first <= v}[type(f)]


def _meets(f, ids: np.ndarray) -> np.ndarray:
    if isinstance(f, In):
        return np.isin(ids, np.array([v for v in f.value if v is not None], np.int64))
    if f.value is None:
        return np.zeros(len(ids), bool)
    v = f.value
    return {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}[type(f)](ids, v)


class TokenSource(DataSource):
    """Format ``token_ids``. Options for reading: path; ids (true), false leaves frames unread; pieceDocs."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push filters into it."""
    spark.dataSource.register(TokenSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document, ``start`` being the tokens of all documents before it.

    ids are little-endian unsigned 32-bit numbers, null if they are not asked for. Conditions on
    doc_id choose shards by the manifest and documents by the index; no other frame is read.
    """
    register(spark)
    return spark.read.format("token_ids").option("ids", str(ids).lower()).load(folder)
