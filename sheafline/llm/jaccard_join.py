"""Groups of near-equal documents: an exact Jaccard self-join on word shingles.

Method: T-occurrence search over inverted lists by DivideSkip (Li, Lu and Lu,
Efficient Merging and Filtering Algorithms for Approximate String Searches,
2008). Two sets of sizes s and t are similar enough only if they share
T = ceil(c (s + t) / (1 + c)) shingles. All shingles are put in one order, rare ones
first. The first of a set's shingles make its short lists, the others are its l
long ones. The short lists of a set are merged with a heap, which counts the
occurrences of every other set in them; a set that occurs fewer than T - l times is
dropped. For the others the long remainder is probed by binary search in the
partner's sorted shingles, and the pair is kept if the occurrences in short
and long lists together reach T. The short lists are longer by a share of
1 / EXTRA of the set than one occurrence would need, so that passages shared
by chance don't suffice.

For scale:

* Rarity comes from counts of all words and all shingles of the corpus in buckets,
  two tables of fixed size: what a shingle's words let expect, or its own bucket if
  that is much fuller than the mean. Any order gives the same result; this one keeps
  what many documents share out of the short lists.
* Equal sets are one node, known by a digest of the set, from the first step on.
* A node of whose short lists fewer hold another one than any partner asks for is
  left out with all its entries. How many do (``many``) bounds its occurrences with any.
* Two nodes of one component need no comparison. So each list first names a leader,
  the node with the most shared entries, which the others are held against; in a
  group of n near copies most are one component after n comparisons. Leaders
  change in the next rounds. Only then are the lists of which nodes are still in
  several components merged, and each pair is looked for from its smaller
  component alone. No link between different components is left out.
* Merged lists travel packed, one row for a node and a list, filtered where the list is.
  A list of more than LIST_ROWS entries is dealt by node, and each part gets the
  nodes that look for others.
* Sets are extracted once, for nodes that may have a partner, and pairs are compared
  by sets; texts are never moved.
* Links and components are Spark tables throughout.

Shingles are compared by hashes: 57 bits and the seven bits of their rarity in the
short lists, 64 bits in the long ones. Nodes are 64-bit digests; that no two sets share
one is checked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Membership, block_count, bucket_bits, pack, split_by_bucket, unpack_column
from .components import Scratch, connected_components, release
from .textbytes import mix, ranges, sequence_hashes, span_hashes, text_chunks, window_starts, word_spans

#: log2 of the buckets in which shingles are counted.
SKETCH_BITS = 18
_PARTS = 16
#: A bucket so many times fuller than the mean holds a hot shingle.
HOT_FACTOR = 16
#: The short lists take one shingle more for every so many of the set.
EXTRA = 20
#: Rounds of leaders before lists are merged.
LEADER_ROUNDS = 3
#: A list with more entries is merged in parts.
LIST_ROWS = 4096
#: Entries of short lists that a task holds before it sends them.
HELD_ENTRIES = 200_000


def shingle_sets(texts: pa.Array, n: int, of_words=None, second: bool = False) -> Iterator[tuple]:
    """Per run of texts: first row, row after the last, then owner and hash of every distinct shingle, by owner and hash.

    Words are folded to a-z; a text of fewer than n words has its whole sequence
    as its one shingle. of_words(hashes of all words) may give each word a number;
    then the sum over each shingle's words follows, else None. With ``second`` there
    follows instead another hash of each shingle, made from other hashes of its words.
    """
    for row, last, data, offsets in text_chunks(texts):
        starts, ends, first = word_spans(data, offsets)
        words = span_hashes(data, starts, ends, fold=True)
        value = of_words(words) if of_words else None
        sums = np.r_[0, np.cumsum(value)] if value is not None else None
        at = window_starts(first, n)
        sizes = [np.full(len(at), n)]
        places = [at]
        hashes = [sequence_hashes(words, n)[at]] if len(at) else []
        owners = [np.searchsorted(first, at, side="right") - 1] if len(at) else []
        counts = np.diff(first)
        for size in range(1, n):
            short = np.flatnonzero(counts == size)
            if len(short):
                hashes.append(sequence_hashes(words, size, seed=size)[first[short]])
                owners.append(short)
                places.append(first[short])
                sizes.append(np.full(len(short), size))
        if not hashes:
            yield row, last, np.zeros(0, np.int64), np.zeros(0, np.uint64), None
            continue
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
        weight = None
        if second:
            others = span_hashes(data, starts, ends, fold=True, seed=1)
            place, size = np.concatenate(places)[order][new], np.concatenate(sizes)[order][new]
            weight = np.zeros(len(place), np.uint64)
            for k in np.unique(size):
                weight[size == k] = sequence_hashes(others, int(k), seed=int(k))[place[size == k]]
        elif sums is not None:
            place, size = np.concatenate(places)[order][new], np.concatenate(sizes)[order][new]
            weight = sums[place + size] - sums[place]
        yield row, last, o[new], h[new], weight


def _digest(owner: np.ndarray, hashes: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, 64-bit digest and a second digest, from ``others``, of the sets of k rows; hashes are in the order of their owners."""
    size = np.bincount(owner, minlength=k)
    d = np.zeros((2, k), np.uint64)
    if len(owner):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        d[0, owner[heads]] = np.add.reduceat(mix(hashes), heads)
        d[1, owner[heads]] = np.add.reduceat(mix(others), heads)
    return size.astype(np.int64), mix(d[0] + size.astype(np.uint64)).view(np.int64), d[1].view(np.int64)


def _digests(n: int):
    """(id, n_shingles, node, check) of every document; then this task's counts of shingles and words by bucket."""

    def run(batches):
        shingles, words = np.zeros((2, 1 << SKETCH_BITS), np.int64)

        def count_words(hashes):
            np.add(words, np.bincount(_bucket(hashes), minlength=1 << SKETCH_BITS), out=words)

        for batch in batches:
            for row, last, owner, hashes, others in shingle_sets(batch.column("text"), n, count_words, second=True):
                k = last - row
                np.add(shingles, np.bincount(_bucket(hashes), minlength=1 << SKETCH_BITS), out=shingles)
                size, node, check = _digest(owner, hashes, others, k)
                empty = size == 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(row, k),
                        "n_shingles": pa.array(size),
                        "node": pa.array(node, mask=empty),
                        "check": pa.array(check, mask=empty),
                        "part": pa.nulls(k, pa.int32()),
                        "counts": pa.nulls(k, pa.binary()),
                    }
                )
        parts = [x.astype("<u4") for x in np.split(np.minimum(np.concatenate([shingles, words]), (1 << 32) - 1), 2 * _PARTS)]
        none = pa.nulls(2 * _PARTS, pa.int64())
        yield pa.RecordBatch.from_pydict(
            {"id": none, "n_shingles": none, "node": none, "check": none, "part": pa.array(range(2 * _PARTS), pa.int32()), "counts": pa.array([pack(x) for x in parts], pa.binary())}
        )

    return run


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), "<u4").astype("<i8") for x in table["counts"])
    return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([pack(total)], pa.binary())})


def _least(size: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """ceil(size * top / bottom)"""
    return -(-size * top // bottom)


class Rarity:
    """The order of shingles, from the counts of all shingles and of all words by bucket."""

    def __init__(self, shingles: np.ndarray, words: np.ndarray) -> None:
        self.mean = max(float(shingles.mean()), 1.0)
        # in whole quarters, so that sums over a shingle's words are the same wherever it occurs
        quarters = lambda x: np.round(4 * np.log2(x + 1.0)).astype(np.int64)
        self.shingles = np.where(shingles > 4 * self.mean, quarters(shingles), 0)
        self.total = int(quarters(words.sum()))
        self.words = quarters(words) - self.total  # of the share of all words
        self.hot = shingles > max(HOT_FACTOR * self.mean, 64)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return self.words[_bucket(hashes)]

    def levels(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Quarters of log2 of how many documents may have a shingle; the same for equal shingles."""
        return np.clip(np.maximum(weight + self.total, self.shingles[_bucket(hashes)]), 0, 127).astype(np.uint64)

    def ordered(self, texts: pa.Array, n: int) -> Iterator[tuple]:
        """As shingle_sets(), with each text's shingles in the common order: first row, row after the last, size of each
        set, node of each set, then owner, key and hash of every shingle. Ascending keys are the order."""
        for row, last, owner, hashes, weight in shingle_sets(texts, n, self.of_words):
            size, node, _ = _digest(owner, hashes, hashes, last - row)
            if len(owner):
                key = (self.levels(hashes, weight) << np.uint64(57)) | (hashes >> np.uint64(7))
                order = np.lexsort((key, owner))
                owner, key, hashes = owner[order], key[order], hashes[order]
                yield row, last, size, node, owner, key, hashes


def _long(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many shingles of a set of this size are left to the long lists."""
    return np.maximum(_least(size, num, den) - 1 - size // EXTRA, 0)


def _long_sql(size: str, num: int, den: int) -> str:
    return f"greatest(ceil({size} * {num} / {den}) - 1 - floor({size} / {EXTRA}), 0)"


def _need_sql(a: str, b: str, num: int, den: int) -> str:
    return f"greatest(ceil({num} * ({a} + {b}) / {num + den}) - greatest({_long_sql(a, num, den)}, {_long_sql(b, num, den)}), 1)"


def _need(size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Occurrences in the short lists below which two sets of these sizes cannot reach T.

    The set whose short lists end earlier in the order of shingles has all of its
    common ones there that are not in its long lists.
    """
    t = _least(size_a + size_b, num, num + den)
    return np.maximum(np.minimum(t - _long(size_a, num, den), t - _long(size_b, num, den)), 1)


def _postings(n: int, num: int, den: int, shared, bits: int):
    """The short lists' entries of every set, packed by bucket of the shingle; a task sends a set once."""

    def run(batches):
        rarity = shared.value
        found: list[tuple] = []
        held, sent = 0, set()
        for batch in batches:
            valid = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            for row, last, size, node, owner, key, hashes in rarity.ordered(batch.column("text"), n):
                fresh = np.zeros(last - row, bool)
                for i in np.flatnonzero((size > 0) & valid[row:last]):
                    if (x := int(node[i])) not in sent:
                        sent.add(x)
                        fresh[i] = True
                first = np.cumsum(size) - size
                take = (np.arange(len(owner)) - first[owner] < (size - _long(size, num, den))[owner]) & fresh[owner]
                warm = rarity.hot[_bucket(hashes[take])]
                found.append((key[take], node[owner[take]], size[owner[take]], warm))
                held += int(take.sum())
                if held > HELD_ENTRIES:
                    yield from _packed(found, bits)
                    found, held = [], 0
            if len(sent) > 1 << 20:
                sent = set()
        if found:
            yield from _packed(found, bits)

    return run


_COLUMNS = {"key": "<u8", "node": "<i8", "size": "<i4", "hot": "u1"}


def _packed(found: list[tuple], bits: int):
    key, node, size, warm = (np.concatenate(x) for x in zip(*found, strict=True))
    place = mix(key + np.where(warm, mix(node.view(np.uint64)) & np.uint64(255), np.uint64(0)))
    order = np.argsort(place, kind="stable")
    parts = list(split_by_bucket(place[order], bits))
    columns = {c: x[order].astype(t) for (c, t), x in zip(_COLUMNS.items(), (key, node, size, warm), strict=True)}
    yield pa.RecordBatch.from_pydict(
        {"bucket": pa.array([b for b, _ in parts], pa.int32())} | {c: pa.array([pack(x[at]) for _, at in parts], pa.binary()) for c, x in columns.items()}
    )


def _lists(table: pa.Table) -> pa.Table:
    """The entries of lists that have two or more, or may have them elsewhere."""
    key, node, size, hot = (unpack_column(table[c], t)[0] for c, t in _COLUMNS.items())
    order = np.lexsort((node, key))
    key, node, size, hot = key[order], node[order], size[order], hot[order]
    if len(key):
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # tasks send a set once each
        key, node, size, hot = key[once], node[once], size[once], hot[once]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[heads, len(key)])
        keep = (np.repeat(times, times) > 1) | (hot > 0)
        key, node, size = key[keep], node[keep], size[keep]
    return pa.table({"key": pa.array(key.view(np.int64)), "node": pa.array(node), "size": pa.array(size, pa.int32())})


def merge_lists(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(document, in how many of the ascending lists it is), by a heap of the lists' heads."""
    for doc, hits in groupby(heapq.merge(*lists)):
        yield doc, sum(1 for _ in hits)


#: Entries of a list: "asks" look for others, "asked" may be found; small lists have entries that are both.
_ASKS, _ASKED, _BOTH = 1, 2, 3
#: Lists of up to so many entries are looked through many at once.
_FEW = 64


def _gather(num: int, den: int, shards: int):
    """For rows in order of (key, part): per node that asks, the list's nodes that it may be linked with.

    A node looks for those of larger components only (by size, then by name), whose
    size and entries allow a link. One row per node, list and shard of the found.
    """

    def fits(q, t):
        """Which pairs of entries (columns: node, size, many, weight, comp) may be linked and are asked for by the first."""
        return (
            ((t[3] > q[3]) | ((t[3] == q[3]) & (t[4] > q[4])))
            & (den * np.minimum(t[1], q[1]) >= num * np.maximum(t[1], q[1]))
            & (np.minimum(t[2], q[2]) >= _need(t[1], q[1], num, den))
        )

    def of_list(table, low, high):
        """Pairs of places (of the node that asks, of the found) of one list; sizes that c allows are a range."""
        asked = low + np.flatnonzero(table[2][low:high] & _ASKED)
        asked = asked[np.argsort(table[4][asked], kind="stable")]
        sizes = table[4][asked]
        for i in low + np.flatnonzero(table[2][low:high] & _ASKS):
            size = table[4][i]
            near = asked[np.searchsorted(sizes, _least(size, num, den)) : np.searchsorted(sizes, size * den // num, side="right")]
            good = near[fits([x[i] for x in table[3:]], [x[near] for x in table[3:]])]
            if len(good):
                yield np.full(len(good), i), good

    def of_lists(table, heads, ends):
        """The same of all lists; those of few entries at once, by blocks of pairs."""
        lengths = ends - heads
        for low, high in zip(heads[lengths > _FEW].tolist(), ends[lengths > _FEW].tolist(), strict=True):
            yield from of_list(table, low, high)
        heads, lengths = heads[(lengths > 1) & (lengths <= _FEW)], lengths[(lengths > 1) & (lengths <= _FEW)]
        for block in np.split(np.arange(len(heads)), np.flatnonzero(np.diff(np.cumsum(lengths * lengths) // 200_000)) + 1):
            each = lengths[block]
            first = ranges(heads[block], each)
            asks, found = np.repeat(first, np.repeat(each, each)), ranges(np.repeat(heads[block], each), np.repeat(each, each))
            good = (table[2][asks] & _ASKS > 0) & (table[2][found] & _ASKED > 0)
            asks, found = asks[good], found[good]
            good = fits([x[asks] for x in table[3:]], [x[found] for x in table[3:]])
            yield asks[good], found[good]

    def rows_of(table, heads, ends):
        """One row for a node that asks, its list and a shard of the found, which ascend."""
        pairs = list(of_lists(table, heads, ends))
        asks, found = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        nodes = table[3][found]
        shard = (mix(nodes.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((nodes, shard, asks))
        asks, shard, nodes, sizes = asks[order], shard[order], nodes[order], table[4][found][order].astype("<i4")
        first = np.flatnonzero(np.r_[True, (asks[1:] != asks[:-1]) | (shard[1:] != shard[:-1])]) if len(asks) else np.zeros(0, np.int64)
        cuts = np.r_[first, len(asks)]
        return pa.RecordBatch.from_pydict(
            {
                "a": pa.array(table[3][asks[first]]),
                "shard": pa.array(shard[first], pa.int32()),
                "size_a": pa.array(table[4][asks[first]], pa.int32()),
                "nodes": pa.array([pack(nodes[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                "sizes": pa.array([pack(sizes[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    def run(batches):
        held: list[np.ndarray] | None = None

        def lists(table, final):
            """Of the rows held, whole lists; the last one waits unless no rows follow."""
            nonlocal held
            key, part = table[0], table[1]
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[heads[1:], len(key)]
            if not final:
                held = [x[heads[-1] :] for x in table]
                heads, ends = heads[:-1], ends[:-1]
            return rows_of(table, heads, ends)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "part", "role", "node")] + [batch.column(c).to_numpy().astype(np.int64) for c in ("size", "many", "weight", "comp")]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(new[0]):
                yield lists(new, False)
        if held is not None and len(held[0]):
            yield lists(held, True)

    return run


def _merge(num: int, den: int):
    """For rows in order of (a, shard): the nodes that occur often enough in the lists of a, with their occurrences."""

    def run(batches):
        out: list[tuple[int, int, int]] = []
        current, lists, sizes = None, [], {}

        def close():
            if current is None or len(lists) < int(_need_least(current[2], num, den)):
                return
            found = [(b, hits) for b, hits in merge_lists(lists)]
            b = np.array([x for x, _ in found], np.int64)
            hits = np.array([x for _, x in found])
            size_b = np.array([sizes[x] for x in b.tolist()])
            good = hits >= _need(np.int64(current[2]), size_b, num, den)
            out.extend((current[0], x, h) for x, h in zip(b[good].tolist(), hits[good].tolist(), strict=True))

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "hits": pa.array(columns[2], pa.int32())})

        for batch in batches:
            for a, shard, size, nodes, of in zip(*(batch.column(c).to_pylist() for c in ("a", "shard", "size_a", "nodes", "sizes")), strict=True):
                if current is None or (a, shard) != current[:2]:
                    close()
                    current, lists, sizes = (a, shard, size), [], {}
                lists.append(np.frombuffer(nodes, "<i8").tolist())
                sizes.update(zip(lists[-1], np.frombuffer(of, "<i4").tolist(), strict=True))
            if len(out) > 100_000:
                yield flush()
        close()
        yield flush()

    return run


def _need_least(size: int, num: int, den: int) -> int:
    """Occurrences that a set of this size needs with the partner that asks for the fewest."""
    return max(int(_least(np.int64(size), num, den)) - int(_long(np.int64(size), num, den)), 1) if size else 1


def _probe(num: int, den: int):
    """Keeps the pairs whose occurrences reach T: those in short lists, if counted (hits), and those found by probes.

    The side whose short lists end earlier has all common ones of its short lists
    in the other's, so what remains are its long lists, probed in the other's set.
    Without a count its short lists are probed as well.
    """

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            hits = batch.column("hits").to_pylist()
            ends = [batch.column(c).to_pylist() for c in ("end_a", "end_b")]
            for i, (x, y) in enumerate(zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if ends[0][i] > ends[1][i]:
                    x, y = y, x
                need = int(_least(np.int64(len(x) + len(y)), num, num + den))
                count = hits[i] or 0
                rest = x[len(x) - int(_long(np.int64(len(x)), num, den)) :] if hits[i] is not None else x
                if min(len(x), len(y)) < need or count + len(rest) < need:
                    continue
                y = np.sort(y)
                at = np.searchsorted(y, rest)
                at[at == len(y)] = 0
                keep[i] = count + int((y[at] == rest).sum()) >= need
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    return run


def _sets(n: int, num: int, den: int, shared, wanted):
    """(node, last key of its short lists as a signed number, hashes in the common order) of every text with words whose id may be wanted."""

    def run(batches):
        rarity = shared.value
        for batch in batches:
            texts = batch.column("text").filter(pa.array(wanted(batch.column("id"))))
            for _, _, size, node, owner, key, hashes in rarity.ordered(texts, n):
                full = np.flatnonzero(size > 0)
                first = (np.cumsum(size) - size)[full]
                end = key[first + (size - _long(size, num, den))[full] - 1] ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_pydict(
                    {"node": pa.array(node[full]), "end": pa.array(end.view(np.int64)), "hashes": pa.array([pack(x) for x in np.split(hashes, first[1:])], pa.binary())}
                )

    return run


def jaccard_components(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the classes of documents that links connect.

    A document's set has its distinct sequences of n words (A-Z read as a-z); with
    fewer words, its whole sequence; with none it is empty. Two documents link if
    the sets' intersection is at least threshold (a fraction: top, bottom) of their
    union; empty sets link with nothing. component_id is the smallest id reachable.

    Defined results: a null text is empty; rows of equal id are one document with
    several texts, which links by each of them, each row returned; a null id links
    with nothing and has a null component; extra columns are left out; an empty table
    gives an empty result. A text may have any length; one text's shingles must fit
    in a task's memory.

    The tables between steps lie in the shared folder and are removed before this
    returns, but for the two that the result is read from.
    """
    num, den = threshold
    if not 0 < num <= den or n < 1:
        raise ValueError("threshold must be a fraction of at most 1, n at least 1")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    told = scratch.save(base.mapInArrow(_digests(n), "id long, n_shingles long, node long, check long, part int, counts binary"))
    counts = told.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_sum_counts, "part int, counts binary")
    # 2 * _PARTS rows of fixed size, whatever the corpus; the broadcast has two tables of 2**SKETCH_BITS numbers
    sketch = [np.frombuffer(r.counts, "<i8") for r in counts.orderBy("part").collect()]
    rarity = spark.sparkContext.broadcast(Rarity(np.concatenate(sketch[:_PARTS]), np.concatenate(sketch[_PARTS:])))

    told = told.where("part is null").select("id", "n_shingles", "node", "check")
    filled = told.where("node is not null and id is not null")
    of_set = filled.groupBy("node").agg(
        F.min("id").alias("first"), (F.min(F.struct("n_shingles", "check")) != F.max(F.struct("n_shingles", "check"))).alias("shared")
    )
    nodes = scratch.save(of_set)
    if nodes.where("shared").limit(1).count():
        raise RuntimeError("two sets of shingles have one digest of 64 bits")

    lists, sizes = _wanted_lists(base, n, num, den, rarity, scratch)
    firsts = sizes.join(nodes, "node").select("node", F.col("first").alias("id"))
    firsts = scratch.save(firsts)
    texts = base.mapInArrow(_sets(n, num, den, rarity, Membership(firsts, "id").test()), "node long, end long, hashes binary")
    sets = texts.join(firsts.select("node"), "node", "left_semi").groupBy("node").agg(F.first("end").alias("end"), F.first("hashes").alias("hashes"))
    sets = scratch.save(sets)
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b, hits or null)."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("end").alias(f"end_{side}"), F.col("hashes").alias(f"hashes_{side}")), side)
        return pairs.select("a", "b", "hits", "end_a", "end_b", "hashes_a", "hashes_b").mapInArrow(_probe(num, den), "a long, b long")

    # texts of one id are one document
    several = filled.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    found = [scratch.save(filled.join(several, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct())]
    parts = _components(found, scratch)
    tried: DataFrame | None = None
    need = _need_sql("size", "b_size", num, den)
    fits = f"{den} * least(size, b_size) >= {num} * greatest(size, b_size) and least(many, b_many) >= {need}"
    turn, linked = 0, 1
    while True:
        merged = turn >= LEADER_ROUNDS or not linked  # the last round
        if linked or parts is None:
            entries = lists
            if parts is None:
                entries = entries.withColumns({"comp": F.col("node"), "weight": F.lit(1).cast("long")})
            else:
                entries = lists.join(parts, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "weight": F.coalesce("weight", F.lit(1).cast("long"))})
                entries = scratch.save(entries)
        # the first leader is the node with the largest share of entries that others have too: near copies' centre
        prio = -F.col("many") / (F.col("size") - F.expr(_long_sql("size", num, den))) if turn == 0 else F.lit(0.0)
        leader = F.struct(prio.alias("prio"), F.xxhash64("node", F.lit(turn)).alias("salt"), "node", "size", "many", "comp")
        heads = entries.groupBy("key").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("length"), F.max(F.struct("weight", "comp")).alias("top"), F.min(leader).alias("leader")
        )
        heads = heads.where("low <> high").select(
            "key", "length", "top", F.col("leader.node").alias("b"), F.col("leader.size").alias("b_size"), F.col("leader.many").alias("b_many"), F.col("leader.comp").alias("b_comp")
        )
        heads = scratch.save(heads)
        most = heads.agg(F.max("length")).first()[0]
        if most is None:  # no list has nodes of two components
            break
        if merged:
            pairs = scratch.save(_often(entries, heads, most, num, den))
        else:
            near = entries.join(heads.drop("length", "top"), "key").where(f"node <> b and comp <> b_comp and {fits}")
            # held against a leader where the lists it leads bring half of what is needed; any choice is right here, the rest is left to the merge
            best = near.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("common"), F.min("size").alias("size"), F.min("b_size").alias("b_size"))
            best = best.where(f"2 * common >= {need}")
            if tried is not None:
                best = best.join(tried, ["a", "b"], "left_anti")
            best = best.groupBy("a").agg(F.max(F.struct("common", "b")).alias("x")).select("a", F.col("x.b").alias("b"), F.lit(None).cast("int").alias("hits"))
            pairs = scratch.save(best)
            tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links = scratch.save(verified(pairs))
        linked = links.count()
        if linked:
            found.append(links)
            parts = _components(found, scratch)
        if merged:
            break
        turn += 1
    if parts is None:
        parts = _components(found, scratch, none=False)
    # the smallest id of every node's component
    linked = nodes.join(parts, "node").select("node", "first", "comp")
    least = linked.groupBy("comp").agg(F.min("first").alias("component"))
    named = nodes.select("node", "first").join(linked.join(least, "comp").select("node", "component"), "node", "left")
    named = scratch.save(named.select("node", F.coalesce("component", "first").alias("component")))
    out = told.select("id", "n_shingles", "node").join(named, "node", "left")
    out = scratch.save(out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")))
    # an id whose texts are linked, but for an empty one
    mixed = out.where("id is not null").groupBy("id").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    mixed = scratch.save(mixed.select("id", "least"))
    scratch.retain(out, mixed)
    out = out.join(mixed, "id", "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("least", "component").alias("component_id"))


def _wanted_lists(base: DataFrame, n: int, num: int, den: int, rarity, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The short lists' entries (key, node, size, many) of nodes that may have a partner; and these nodes.

    many: how many of the node's entries are in a list with others.
    """
    bits = bucket_bits(block_count(base))
    packed = base.mapInArrow(_postings(n, num, den, rarity, bits), "bucket int, key binary, node binary, size binary, hot binary")
    lists = scratch.save(packed.groupBy("bucket").applyInArrow(_lists, "key long, node long, size int"))
    # a node whose short lists hold others less often than any partner asks for has none
    enough = lists.groupBy("node").agg(F.count("*").cast("int").alias("many"), F.max("size").alias("size")).where(f"many > floor(size / {EXTRA})")
    sizes = scratch.save(enough.select("node", "many"))
    return scratch.save(lists.join(sizes, "node")), sizes


def _components(found: list[DataFrame], scratch: Scratch, none: bool = True) -> DataFrame | None:
    """(node, comp, weight) of the nodes that have links; weight is the number of nodes in the component. No links: None, if asked for."""
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    if none and not links.limit(1).count():
        return None
    parts = connected_components(links, scratch).withColumnRenamed("component", "comp")
    return scratch.save(parts.join(parts.groupBy("comp").agg(F.count("*").alias("weight")), "comp").select("node", "comp", "weight"))


def _often(entries: DataFrame, heads: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """(a, b, hits): the pairs of different components that occur often enough in each other's short lists."""
    spread = entries.join(heads.select("key", "length", "top"), "key")
    asks = F.struct("weight", "comp") < F.col("top")
    columns = ("node", "size", "many", "weight", "comp")
    pieces = F.ceil(F.col("length") / LIST_ROWS).cast("int")
    part = F.pmod(F.xxhash64("node"), pieces).cast("int")
    small = spread.where(f"length <= {LIST_ROWS}").select("key", F.lit(0).alias("part"), F.when(asks, _BOTH).otherwise(_ASKED).alias("role"), *columns)
    large = spread.where(f"length > {LIST_ROWS}")
    asked = large.select("key", part.alias("part"), F.lit(_ASKED).alias("role"), *columns)
    asking = large.where(asks).select("key", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("part"), F.lit(_ASKS).alias("role"), *columns)
    rows = small.unionByName(asked).unionByName(asking).repartition("key", "part").sortWithinPartitions("key", "part")
    shards = 1 << max(0, (most - 1).bit_length() - LIST_ROWS.bit_length() + 1)
    found = rows.mapInArrow(_gather(num, den, shards), "a long, shard int, size_a int, nodes binary, sizes binary")
    return found.repartition("a", "shard").sortWithinPartitions("a", "shard").mapInArrow(_merge(num, den), "a long, b long, hits int")
