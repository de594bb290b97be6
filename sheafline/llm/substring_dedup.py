"""Removal of word sequences that an earlier place of the corpus already has.

Method: a Rabin-Karp hash of every window of ``size`` consecutive words; windows
are counted over the whole corpus, every occurrence but the first is marked, and
overlapping marks merge into maximal intervals of words, which are removed.

A window can only be repeated if its smallest hash of ``size // 3`` consecutive
words (its anchor) is. Blocks of documents first ask which of their anchors occur
twice or more; only windows with such an anchor are hashed twice and
counted. Both rounds send one entry for each distinct value of a block, so
neither a passage that a third of the documents share nor a large group of copies
gathers in one task. The texts are shuffled once; the three steps share that.

Equality of windows is taken from two Rabin-Karp hashes modulo 2**61 - 1, with
different bases and of independent hashes of the words (122 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answer_shared, block_count, bucket_bits, find, id_array, pack, split_by_bucket, unpack_column, with_block
from .textbytes import span_hashes, text_chunks, window_hashes, window_starts, word_spans


def remove_repeats(docs: DataFrame, size: int = 50, id_column: str = "doc_id", text_column: str = "text", keep_untouched: bool = False) -> DataFrame:
    """Every row of ``docs`` with the words removed that repeat an earlier window.

    A word goes if some window of ``size`` words that covers it also starts
    earlier: in a document of smaller id, or earlier in its own. Windows are
    judged on the input, not on what is left.

    Returns (id, kept_text, n_words long, n_removed long, removed
    array<struct<start,end>> in words, end exclusive, rest struct<the other
    columns>). kept_text is the kept words joined by one blank; with
    keep_untouched, a text of which nothing goes comes back as it is.

    Defined results: a null or wordless text has no words and an empty kept_text;
    a null id counts as smaller than all others; rows of equal id are ordered by
    their text (null first) and count as separate documents; extra columns, of
    any name, come back in ``rest``; an empty table gives an empty result.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("string").alias("none"))
    blocks = block_count(docs)
    bits = bucket_bits(blocks)
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"), rest.alias("rest"))
    base = with_block(base, "id", blocks, "block")
    texts = base.select("block", "id", "text", "rest").groupBy("block")

    asks = texts.applyInArrow(_ask_anchors(size, bits), "bucket int, block int, hashes binary")
    anchors = answer_shared(asks).groupBy("block")
    ask_windows = texts.cogroup(anchors).applyInArrow(
        _ask_windows(size, bits), "bucket int, block int, high binary, low binary, ids binary, starts binary, many binary"
    )
    windows = ask_windows.groupBy("bucket").applyInArrow(_answer_windows, "block int, high binary, low binary, own binary")
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("rest", base.schema["rest"].dataType),
        ]
    )
    return texts.cogroup(windows.groupBy("block")).applyInArrow(_remove(size, keep_untouched), schema).withColumnRenamed("id", id_column)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


def _chunks(table: pa.Table, size: int) -> Iterator[tuple]:
    """For every run of documents: first row, row after the last, words' starts and ends, words before each document, word hashes, window starts."""
    for row, last, data, offsets in text_chunks(table["text"]):
        starts, ends, first = word_spans(data, offsets)
        yield row, last, data, starts, ends, first, span_hashes(data, starts, ends), window_starts(first, size)


def _anchors(words: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window the position of its anchor, and the hashes of all short sequences.

    The anchor is the short sequence of the window with the smallest hash, the
    leftmost of equals; it depends on the window's words alone.
    """
    short = max(1, size // 3)
    grams = window_hashes(words, short, seed=7)
    width = size - short + 1
    lowest, place = grams, np.arange(len(grams))
    span = 1
    while span < width:
        step = min(span, width - span)
        if len(lowest) <= step:
            return np.zeros(0, np.int64), grams
        left = lowest[:-step] <= lowest[step:]
        lowest, place = np.where(left, lowest[:-step], lowest[step:]), np.where(left, place[:-step], place[step:])
        span += step
    return place[windows], grams


def _second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Another hash of every window, from other hashes of its words."""
    return window_hashes(span_hashes(data, starts, ends, seed=1), size, seed=2)


def _ask_anchors(size: int, bits: int):
    def ask(table: pa.Table) -> pa.Table:
        found = []
        for *_, words, windows in _chunks(table, size):
            if len(windows):
                at, grams = _anchors(words, windows, size)
                found.append(grams[at[np.r_[True, at[1:] != at[:-1]]]])
        hashes, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hashes = np.repeat(hashes, np.minimum(times, 2))
        parts = list(split_by_bucket(hashes, bits))
        block = table["block"][0].as_py() if table.num_rows else 0
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in parts], pa.int32()),
                "block": pa.array([block] * len(parts), pa.int32()),
                "hashes": pa.array([pack(hashes[x]) for _, x in parts], pa.binary()),
            }
        )

    return ask


def _ask_windows(size: int, bits: int):
    def ask(table: pa.Table, anchors: pa.Table) -> pa.Table:
        shared = np.sort(unpack_column(anchors["hashes"], "<u8")[0])
        table = _ordered(table.select(["block", "id", "text"]))
        ids = id_array(table["id"])
        high, low, doc, start = [], [], [], []
        for row, _, data, starts, ends, first, words, windows in _chunks(table, size):
            if not len(windows) or not len(shared):
                continue
            at, grams = _anchors(words, windows, size)
            turn = np.r_[True, at[1:] != at[:-1]]
            known = find(shared, grams[at[turn]]) >= 0
            windows = windows[known[np.cumsum(turn) - 1]]
            if len(windows):
                owner = np.searchsorted(first, windows, side="right") - 1
                high.append(window_hashes(words, size, seed=1)[windows])
                low.append(_second(data, starts, ends, size)[windows])
                doc.append(ids[row + owner])
                start.append(windows - first[owner])
        if not high:
            return _asked([], [], np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        high, low, doc, start = (np.concatenate(x) for x in (high, low, doc, start))
        order = np.lexsort((low, high))  # stable: the earliest occurrence comes first
        high, low = high[order], low[order]
        new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        at = np.flatnonzero(new)
        many = np.diff(np.r_[at, len(high)]) > 1
        high, low, doc, start = high[at], low[at], doc[order[at]], start[order[at]]
        parts = list(split_by_bucket(high, bits))
        return _asked(parts, [table["block"][0].as_py()] * len(parts), high, low, doc, start, many)

    return ask


def _asked(parts, blocks, high, low, doc, start, many) -> pa.Table:
    columns = {"high": (high, "<u8"), "low": (low, "<u8"), "ids": (doc, "<i8"), "starts": (start, "<i8"), "many": (many, "u1")}
    return pa.table(
        {"bucket": pa.array([b for b, _ in parts], pa.int32()), "block": pa.array(blocks, pa.int32())}
        | {k: pa.array([pack(x[at].astype(kind)) for _, at in parts], pa.binary()) for k, (x, kind) in columns.items()}
    )


def _answer_windows(table: pa.Table) -> pa.Table:
    """To each block, its windows that occur twice or more, and whether the first occurrence is its own."""
    high, counts = unpack_column(table["high"], "<u8")
    low, doc, start, many = (unpack_column(table[k], kind)[0] for k, kind in (("low", "<u8"), ("ids", "<i8"), ("starts", "<i8"), ("many", "u1")))
    block = np.repeat(table["block"].to_numpy(), counts)
    order = np.lexsort((start, doc, low, high))
    high, low, many, block = high[order], low[order], many[order], block[order]
    new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    shared = (np.diff(np.r_[at, len(high)]) > 1) | (np.maximum.reduceat(many, at) > 0) if len(at) else np.zeros(0, bool)
    keep = shared[np.cumsum(new) - 1] if len(at) else shared
    high, low, own, block = high[keep], low[keep], new[keep].astype("u1"), block[keep]
    order = np.argsort(block, kind="stable")
    high, low, own, block = high[order], low[order], own[order], block[order]
    names, first = np.unique(block, return_index=True)
    cut = lambda x: [pack(y) for y in np.split(x, first[1:])] if len(names) else []
    return pa.table({"block": pa.array(names, pa.int32()), "high": pa.array(cut(high), pa.binary()), "low": pa.array(cut(low), pa.binary()), "own": pa.array(cut(own), pa.binary())})


def _remove(size: int, keep_untouched: bool):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table)
        high, low, own = (unpack_column(answers[k], kind)[0] for k, kind in (("high", "<u8"), ("low", "<u8"), ("own", "u1")))
        order = np.lexsort((low, high))
        high, low, own = high[order], low[order], own[order].astype(bool)
        # a number for each pair of hashes; equal high halves are told apart by the low ones
        tie = len(high) > 1 and bool((high[1:] == high[:-1]).any())
        unseen = np.ones(len(high), bool)  # of own first occurrences, in the order of documents
        kept, n_words, n_removed, spans, span_counts = [], [], [], [], []
        for row, last, data, starts, ends, first, words, windows in _chunks(table, size):
            cover = np.zeros(len(words) + 1, np.int64)
            if len(windows) and len(high):
                at = find(high, window_hashes(words, size, seed=1)[windows])
                windows, at = windows[at >= 0], at[at >= 0]
                second = _second(data, starts, ends, size)[windows] if len(windows) else np.zeros(0, np.uint64)
                if tie:
                    for _ in range(len(high)):
                        step = (low[at] != second) & (at + 1 < len(high)) & (high[np.minimum(at + 1, len(high) - 1)] == high[at])
                        if not step.any():
                            break
                        at = at + step
                same = low[at] == second
                windows, at = windows[same], at[same]
                seen, place = np.unique(at, return_index=True)
                mine = own[seen] & unseen[seen]
                unseen[seen] = False
                drop = np.ones(len(windows), bool)
                drop[place[mine]] = False
                windows = windows[drop]
                np.add.at(cover, windows, 1)
                np.add.at(cover, windows + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            before = np.r_[0, np.cumsum(gone)]
            n_words.append(np.diff(first))
            n_removed.append(before[first[1:]] - before[first[:-1]])
            joined = _joined(data, starts, ends, ~gone, first)
            if keep_untouched:
                joined = pc.if_else(pa.array(n_removed[-1] == 0), table["text"].slice(row, last - row).combine_chunks(), joined)
            kept.append(joined)
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = first[:-1][first[:-1] < first[1:]]
            edge[heads] = gone[heads]
            begin = np.flatnonzero(edge)
            edge = gone.copy()
            edge[:-1] &= ~gone[1:]
            tails = first[1:][first[:-1] < first[1:]] - 1
            edge[tails] = gone[tails]
            end = np.flatnonzero(edge) + 1
            owner = np.searchsorted(first, begin, side="right") - 1
            spans.append((begin - first[owner], end - first[owner]))
            span_counts.append(np.bincount(owner, minlength=len(first) - 1))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(join([x for x, _ in spans])), pa.array(join([y for _, y in spans]))], ["start", "end"])
        removed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(join(span_counts))].astype(np.int32)), pairs)
        return pa.table(
            {
                "id": table["id"],
                "kept_text": pa.chunked_array(kept, pa.string()),
                "n_words": pa.array(join(n_words)),
                "n_removed": pa.array(join(n_removed)),
                "removed": removed,
                "rest": table["rest"],
            }
        )

    return remove


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of every document, joined by one blank."""
    before = np.r_[0, np.cumsum(keep)]
    counts = before[first[1:]] - before[first[:-1]]
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1  # with a blank behind
    total = int(sizes.sum())
    stops = np.cumsum(sizes)
    out = np.full(total, 0x20, np.uint8)
    # copy by run: the distance between source and target changes at each word only
    target = stops - sizes
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - target, sizes)
    out[:] = data[np.minimum(index, max(len(data) - 1, 0))] if total else out
    out[stops - 1] = 0x20
    # drop each document's last blank
    last = np.cumsum(counts)[counts > 0] - 1
    live = np.ones(total, bool)
    live[stops[last] - 1] = False
    out = out[live]
    ends_at = np.r_[0, stops][np.r_[0, np.cumsum(counts)]]
    lost = np.r_[0, np.cumsum(counts > 0)]
    offsets = (ends_at - lost).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
