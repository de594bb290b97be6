"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads words, each with a blank before and behind, from both ends and
labels every byte with a distribution over languages; a document's distribution
is the softmax of the mean logarithms over all its bytes, sharpened by a fixed
factor. States start anew at every word, so a word's labels depend on the word
alone and a word that a task has met before is not read again. Words longer than
SEGMENT bytes are read in segments.

It is trained in numpy, by backpropagation through time and Adam, on a bounded sample:
``docs_per_language`` documents of each language and ``words_per_doc`` words of each of
them, those of the smallest hashes. Prediction is narrow: every word of every text
is read, and no row leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textbytes import FOLD, Words, ranges, text_chunks, word_spans

SEGMENT = 24
HIDDEN = 16
#: The factor of a document's mean logarithms.
SHARPEN = 6.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of spans between blanks, A-Z as a-z, padded to the longest, and their lengths."""
    sizes = ends - starts
    out = np.full((len(starts), int(sizes.max(initial=0)) + 2), 0x20, np.uint8)
    row = np.repeat(np.arange(len(starts)), sizes)
    out[row, ranges(np.ones(len(starts), np.int64), sizes)] = FOLD[data[ranges(starts, sizes)]]
    return out, sizes + 2


def _reversed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row of x (n, L, ...) turned around within its size."""
    at = sizes[:, None] - 1 - np.arange(x.shape[1])[None, :]
    at = np.where(at >= 0, at, np.arange(x.shape[1])[None, :])
    return x[np.arange(len(x))[:, None], at]


@dataclass
class Direction:
    """A gated recurrent unit: ``table`` holds each byte's input to the gates, ``u`` the recurrence."""

    table: np.ndarray  # (256, 3H): update, reset, candidate
    u: np.ndarray  # (H, 3H)

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        n, length = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, length, HIDDEN), np.float32)
        steps = []
        for t in range(length):
            live = (t < sizes)[:, None]
            a, b = self.table[x[:, t]], h @ self.u
            gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            new = np.where(live, c + z * (h - c), h)
            if keep:
                steps.append((h, z, r, c, b[:, 2 * HIDDEN :], live))
            h = new
            out[:, t] = h
        return out, steps

    def back(self, x: np.ndarray, steps: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u from those of the outputs."""
        d_table, d_u = np.zeros_like(self.table), np.zeros_like(self.u)
        d_h = np.zeros_like(steps[0][0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, c, b, live = steps[t]
            d = d_h + d_out[:, t]
            dc = np.where(live, d * (1 - z) * (1 - c * c), 0)
            dz = np.where(live, d * (h - c) * z * (1 - z), 0)
            dr = dc * b * r * (1 - r)
            d_b = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(d_table, x[:, t], np.concatenate([dz, dr, dc], axis=1))
            d_u += h.T @ d_b
            d_h = np.where(live, d * z, d) + d_b @ self.u.T
        return d_table, d_u


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    w: np.ndarray  # (2H, K)
    bias: np.ndarray
    memory: dict = field(default_factory=dict)

    def logs(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(n, K): each word's logarithms of probabilities, summed over its bytes and blanks."""
        f, _ = self.ahead.run(x, sizes)
        b, _ = self.behind.run(_reversed(x, sizes), sizes)
        y = np.concatenate([f, _reversed(b, sizes)], axis=2) @ self.w + self.bias
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        y[np.arange(x.shape[1])[None, :] >= sizes[:, None]] = 0
        return y.sum(axis=1)


def train(words: list[bytes], labels: np.ndarray, languages: list[str], steps: int = 350, batch: int = 256, rate: float = 0.015, seed: int = 11) -> Network:
    """A network that labels the bytes of the words; the same for the same words in the same order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = len(languages)
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    table = lambda: (0.5 * rng.standard_normal((256, 3 * HIDDEN))).astype(np.float32)
    net = Network(languages, Direction(table(), scale(HIDDEN, 3 * HIDDEN)), Direction(table(), scale(HIDDEN, 3 * HIDDEN)), scale(2 * HIDDEN, k), np.zeros(k, np.float32))
    held = [net.ahead.table, net.ahead.u, net.behind.table, net.behind.u, net.w, net.bias]
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(words), batch)
        x, sizes = padded(raw, starts[pick], ends[pick])
        back_x = _reversed(x, sizes)
        f, f_steps = net.ahead.run(x, sizes, True)
        b, b_steps = net.behind.run(back_x, sizes, True)
        both = np.concatenate([f, _reversed(b, sizes)], axis=2)
        y = both @ net.w + net.bias
        p = np.exp(y - y.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(batch), :, labels[pick]] -= 1
        p[np.arange(x.shape[1])[None, :] >= sizes[:, None]] = 0
        p = (p / sizes.sum()).astype(np.float32)
        d_both = p @ net.w.T
        grads = [
            *net.ahead.back(x, f_steps, d_both[:, :, :HIDDEN]),
            *net.behind.back(back_x, b_steps, _reversed(np.ascontiguousarray(d_both[:, :, HIDDEN:]), sizes)),
            np.einsum("nth,ntk->hk", both, p),
            p.sum(axis=(0, 1)),
        ]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(held, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the CRC of the id's text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, docs_per_language: int = 400, words_per_doc: int = 120, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network | None:
    """A network from the documents that are not held out and have an id, a language and words; None if there are none."""
    usable = docs.where(~held_out(id_column) & F.col(id_column).isNotNull() & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    usable = usable.select(F.col(id_column).alias("_id"), F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"))
    order = W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    # the ids are chosen before any text is moved; k of each language at most
    chosen = usable.select("_id", "_lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_per_language).select("_id").distinct()
    words = F.expr("array_distinct(array_remove(split(_text, '[ \t-\r]+'), ''))")
    sample = usable.join(F.broadcast(chosen), "_id").withColumn("_w", words)
    sample = sample.withColumn("_w", F.slice(F.array_sort(F.transform("_w", lambda w: F.struct(F.xxhash64(w, F.col("_id")).alias("h"), w.alias("w")))), 1, words_per_doc))
    rows = sample.select("_lang", "_id", F.col("_w.w").alias("w")).orderBy("_lang", "_id", F.xxhash64("w")).collect()
    # longer words in segments, as predict reads them
    found = [(r._lang, b[i : i + SEGMENT]) for r in rows for b in (w.encode() for w in r.w) for i in range(0, len(b), SEGMENT)]
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    # as many draws for each language
    by = {lang: [w for x, w in found if x == lang] for lang in languages}
    most = max(map(len, by.values()))
    pairs = [(by[lang][i % len(by[lang])], j) for j, lang in enumerate(languages) for i in range(most)]
    return train([w for w, _ in pairs], np.array([j for _, j in pairs]), languages)


_REMEMBER = 400_000


def _predict(shared):
    def run(batches):
        net: Network = shared.value
        k = len(net.languages)
        known, logs = Words(), np.zeros((0, k), np.float32)
        for batch in batches:
            pred, score = [], []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                parts = -(-(ends - starts) // SEGMENT)
                part_first = np.r_[0, np.cumsum(parts)][first]
                begin = np.repeat(starts, parts) + SEGMENT * ranges(np.zeros(len(parts), np.int64), parts)
                end = np.minimum(begin + SEGMENT, np.repeat(ends, parts))
                if known.count > _REMEMBER:
                    known, logs = Words(), np.zeros((0, k), np.float32)
                at, place = known.number(FOLD[data], begin, end)
                if len(place):
                    new = np.zeros((len(place), k), np.float32)
                    sizes = (end - begin)[place]
                    for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, SEGMENT)):
                        rows = np.flatnonzero((sizes > low) & (sizes <= high))
                        for i in range(0, len(rows), 8192):
                            part = rows[i : i + 8192]
                            at_words = place[part]
                            new[part] = net.logs(*padded(data, begin[at_words], end[at_words]))
                    logs = np.concatenate([logs, new])
                values = logs[at].astype(np.float64)
                sums = np.concatenate([np.zeros((1, k)), np.cumsum(values, axis=0)])
                total = sums[part_first[1:]] - sums[part_first[:-1]]
                size = np.r_[0, np.cumsum(end - begin + 2)]
                mean = total / np.maximum(size[part_first[1:]] - size[part_first[:-1]], 1)[:, None]
                p = np.exp(SHARPEN * (mean - mean.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                pred.append(best)
                score.append(p[np.arange(len(p)), best])
            best = np.concatenate(pred) if pred else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(net.languages, object)[best], pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))],
                ["id", "has_letter", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: a language of the network and its probability.

    A null text, one with no letter, or any text where there is no network, is
    ``und`` with the score 0. Languages of equal probability: the first by name.
    Extra columns are left out; repeated rows come back as often.
    """
    text = F.col(f"`{text_column}`").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"), letter.alias("has_letter"))
    if network is None:
        return base.select(F.col("id").alias(id_column), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few hundred kilobytes
    told = base.mapInArrow(_predict(shared), "id long, has_letter boolean, lang_pred string, score double")
    return told.select(
        F.col("id").alias(id_column),
        F.when(F.col("has_letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("has_letter"), F.col("score")).otherwise(0.0).alias("score"),
    )
