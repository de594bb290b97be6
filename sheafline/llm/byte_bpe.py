"""Byte-level BPE: encoding and decoding with the ranks of a tiktoken file.

Each match of the splitting pattern is merged by itself (see bpe_merges). Texts
are cut before blanks that follow other than white space, where no match of the
pattern can reach across; a cut piece that a task has met before is not merged
again. Encoding and decoding are narrow: no row leaves its partition.

Letters that the library's tables know and Python's don't are split as the library
would: its own tables are asked for their category, and a letter of this category
stands for them while the pattern is matched. They are merged like all others.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_merges import MergeTable, Remembered
from .textbytes import ranges, text_chunks

#: White space as Unicode has it; tiktoken's \s.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


class ByteBpe:
    """A rank file with its splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = _read_ranks(path)
        keys, ranks = array("q"), array("q")
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        self.table = MergeTable(keys, ranks, ranks)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(r"\s", f"[{UNICODE_SPACE}]").replace(r"\S", f"[^{UNICODE_SPACE}]"))
        self.memory = Remembered()
        self.tokens = TokenBytes(self.ranks)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        matches = [[m.encode() for m in self._matches(t)] for t in texts]
        distinct = list(dict.fromkeys(m for ms in matches for m in ms))
        whole = {m: self.ranks[m] for m in distinct if m in self.ranks}
        rest = [m for m in distinct if m not in whole]
        symbols = self.of_byte[np.frombuffer(b"".join(rest), np.uint8)]
        ids, counts = self.table.encode(symbols, np.array([len(m) for m in rest], np.int64))
        ids = np.concatenate([ids, np.fromiter(whole.values(), np.int32, len(whole))])
        counts = np.concatenate([counts, np.ones(len(whole), np.int64)])
        starts = np.cumsum(counts) - counts
        place = {m: i for i, m in enumerate([*rest, *whole])}
        at = np.fromiter((place[m] for ms in matches for m in ms), np.int64)
        sizes = counts[at]
        groups = np.repeat(np.arange(len(pieces)), [len(ms) for ms in matches])
        return ids[ranges(starts[at], sizes)], np.bincount(groups, weights=sizes, minlength=len(pieces)).astype(np.int64)

    def _matches(self, text: str) -> list[str]:
        """The matches of the splitting pattern, as the library finds them."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text):
            return self.split.findall(text)
        known = "".join(stand_in(c) if unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.split.finditer(known)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of every text as little-endian unsigned 32-bit numbers."""
        out = []
        for _, _, data, offsets in text_chunks(texts):
            cut = np.zeros(len(data) + 1, bool)
            if len(data):
                cut[1:-1] = (data[1:] == 0x20) & ~_BREAKS[data[:-1]] & _plain_end(data)[:-1]
            cut[offsets] = True
            starts = np.flatnonzero(cut)
            starts, ends = starts[:-1], starts[1:]
            ids, counts = self.memory.look_up(
                data, starts, ends, lambda at: self._encode_pieces([data[s:e].tobytes() for s, e in zip(starts[at], ends[at], strict=True)])  # noqa: B023
            ) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            before = np.r_[0, np.cumsum(counts)]
            stops = before[np.searchsorted(starts, offsets)]
            raw = ids.astype("<u4").tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        return pa.array(out, pa.binary())

    def decode(self, packed: pa.Array) -> pa.Array:
        return self.tokens.decode(packed)


class TokenBytes:
    """The bytes of every id, all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.counts = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, packed: pa.Array) -> pa.Array:
        """The bytes that packed ids stand for."""
        out = []
        for x in packed:
            if not x.is_valid:
                out.append(None)
                continue
            ids = np.frombuffer(x.as_buffer(), "<u4")
            out.append(self.bytes[ranges(self.starts[ids], self.counts[ids])].tobytes())
        return pa.array(out, pa.binary())


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: A letter of each general category of Unicode, none of which the pattern of a tokenizer names by itself.
_OF_CATEGORY = {
    "Lu": "\u00c0", "Ll": "\u00e0", "Lt": "\u01c5", "Lm": "\u02b0", "Lo": "\u05d0", "Mn": "\u0300", "Mc": "\u0903", "Me": "\u0488",
    "Nd": "\u0660", "Nl": "\u16ee", "No": "\u00b2", "Pc": "\u203f", "Pd": "\u2010", "Ps": "\u0f3a", "Pe": "\u0f3b", "Pi": "\u00ab", "Pf": "\u00bb",
    "Po": "\u00a1", "Sm": "\u00ac", "Sc": "\u00a2", "Sk": "\u00a8", "So": "\u00a9", "Cf": "\u00ad",
}


@lru_cache(maxsize=1)
def _categories() -> dict[str, tiktoken.Encoding]:
    """For every category an encoding of bytes that finds its letters alone, by the library's tables."""
    every = {bytes([i]): i for i in range(256)}
    return {k: tiktoken.Encoding(k, pat_str=rf"\p{{{k}}}", mergeable_ranks=every, special_tokens={}) for k in _OF_CATEGORY}


@lru_cache(maxsize=1 << 12)
def stand_in(letter: str) -> str:
    """A letter known to Python of the category that the library has for ``letter``; one that is nowhere assigned, if the library knows none."""
    return next((_OF_CATEGORY[k] for k, e in _categories().items() if e.encode_ordinary(letter)), "\u0378")


def _plain_end(data: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is surely no white space; False where in doubt."""
    plain = data < 0x80
    two = np.zeros(len(data), bool)
    two[1:] = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)  # two-byte characters from U+00C0 on
    return plain | two


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> TokenBytes:
    return TokenBytes(_read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary) of every row: the text's ids as little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Special tokens are ordinary text. Rows stay
    in their partitions and are not merged; extra columns are left out.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _loaded(path, pattern).encode(batch.column(1))], ["id", "ids"])

    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return base.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes of packed ids; null ids give null."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _token_bytes(path).decode(batch.column(1))], ["id", "ids", "decoded"])

    base = encoded.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{ids_column}`").alias("ids"))
    return base.mapInArrow(run, "id long, ids binary, decoded binary").withColumnRenamed("id", id_column).withColumnRenamed("ids", ids_column)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, decoded): as decode(encode(...)), by one Python worker for both, in pieces of few rows."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = _loaded(path, pattern).encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _loaded(path, pattern).decode(ids)], ["id", "ids", "decoded"])

    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return base.mapInArrow(run, "id long, ids binary, decoded binary").withColumnRenamed("id", id_column)
