"""The inverted index and its statistics: postings, terms, sizes."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .saved import saved
from .sizes import small


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5))"""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    """postings (id, token, tf, dl), terms (token, df, idf), stats (n, avg_len: one row).

    held: (id, dl, tokens) of each text, of an index for questions whose ids are distinct; tokens are those asked for.
    owners: (id, owner) of the texts that have an owner, if one was named; held has it as a further column then.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    held: DataFrame | None = None
    owners: DataFrame | None = None


#: Tokens asked for that are named in the plan; beyond, they are joined.
NAMED_TOKENS = 20_000
#: Postings of a batch that leaves a task at once.
POSTINGS = 1 << 17


def _counted(texts: DataFrame) -> DataFrame:
    """(id, dl, token, tf) of (id, dl, tokens): equal tokens of a row are counted where the row is read, without a shuffle."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            cells, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            for i in range(0, len(cells), POSTINGS):
                row, code = pa.array(cells[i : i + POSTINGS] // n), pa.array(cells[i : i + POSTINGS] % n)
                found = [batch.column("id").take(row), batch.column("dl").take(row), coded.dictionary.take(code), pa.array(tf[i : i + POSTINGS].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(found, ["id", "dl", "token", "tf"])

    return texts.select("id", "dl", "tokens").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, dl int, token string, tf long")


def _kept(texts: DataFrame, names: list[str]) -> DataFrame:
    """(id, dl, tokens and others) with the tokens among ``names`` alone."""
    known = pa.array(names, pa.string())

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten()
            good = pc.is_in(flat, known)
            upto = np.r_[0, np.cumsum(good.to_numpy(zero_copy_only=False))]
            ends = np.r_[0, np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))].astype(np.int64)
            held = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), flat.filter(good))
            yield pa.RecordBatch.from_arrays([held if c == "tokens" else batch.column(c) for c in names_out], names_out)

    names_out = ["id", "dl", "tokens", *[c for c in texts.columns if c not in ("id", "dl", "tokens")]]
    return texts.select(*names_out).mapInArrow(run, ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in names_out))


def repeated(ids: DataFrame) -> bool:
    return not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def build(chunks: DataFrame, id_column: str, text_column: str, wanted: DataFrame | None = None, owner_column: str | None = None) -> Index:
    """The index of a table of texts; one without tokens counts as one of length 1 in the average. Postings are made
    where the texts are read; they are shuffled only if an id has several rows, which are then counted together.

    With ``wanted`` (token), postings and terms are those of these tokens alone, with the numbers they have in the
    whole index: all that questions of these tokens need. Texts are read once; of each its length and these tokens are
    saved in the shared folder, and so are terms and statistics. ``owner_column`` names what a text belongs to.
    """
    owner = [F.col(owner_column).alias("owner")] if owner_column else []
    texts = chunks.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("tokens"), *owner).withColumn("dl", F.size("tokens"))
    if wanted is not None:
        wanted = wanted.select("token").distinct()
        names = [r.token for r in wanted.limit(NAMED_TOKENS + 1).collect()]
        if len(names) <= NAMED_TOKENS:
            texts = saved(_kept(texts, names), "asked")
    several = repeated(texts if wanted is not None else chunks.select(F.col(id_column).alias("id")))
    postings = _counted(texts)
    if wanted is not None and len(names) > NAMED_TOKENS:
        postings = postings.join(small(wanted), "token", "left_semi")
    if several:
        postings = postings.groupBy("id", "dl", "token").agg(F.sum("tf").alias("tf"))
    stats = texts.agg(F.count("*").alias("n"), F.avg(F.greatest("dl", F.lit(1))).alias("avg_len"))
    # of one row for each id, the distinct tokens are its postings
    told = postings.select("token") if several or wanted is not None and len(names) > NAMED_TOKENS else texts.select(F.explode(F.array_distinct("tokens")).alias("token"))
    terms = told.groupBy("token").agg(F.count("*").alias("df"))
    terms = terms.crossJoin(F.broadcast(stats.select("n"))).select("token", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # stats is one row
    if wanted is not None:
        terms, stats = saved(terms, "terms"), saved(stats, "stats")
    held = texts if wanted is not None and not several and len(names) <= NAMED_TOKENS else None
    owners = chunks.select(F.col(id_column).alias("id"), *owner).where("id is not null and owner is not null").distinct() if owner else None
    return Index(postings.select("id", "token", "tf", "dl"), terms, stats, held, owners)


def size_stats(chunks: DataFrame, text_column: str) -> DataFrame:
    """One row: count, average and 95th percentile of characters."""
    size = F.length(F.coalesce(F.col(text_column), F.lit("")))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(size), 1).alias("avg_chars"), F.floor(F.percentile(size, 0.95)).cast("long").alias("p95_chars")
    )


class IndexCache:
    """Indexes by fingerprint: built once, kept on disk, the last ``keep`` of them named in memory.

    hold() pins a fingerprint against eviction; forget() drops those of a dataset.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 8) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.known: OrderedDict[str, str] = OrderedDict()
        self.pinned: set[str] = set()

    def get(self, fingerprint: str, dataset: str, make) -> Index:
        base = f"{self.root}/{fingerprint}"
        if fingerprint not in self.known:
            built = make()
            for name in ("postings", "terms", "stats"):
                getattr(built, name).write.mode("overwrite").parquet(f"{base}/{name}")
            self.known[fingerprint] = dataset
        self.known.move_to_end(fingerprint)
        while len(self.known) > self.keep:
            old = next((f for f in self.known if f not in self.pinned and f != fingerprint), None)
            if old is None:
                break
            del self.known[old]
        return Index(*[self.spark.read.parquet(f"{base}/{name}") for name in ("postings", "terms", "stats")])

    def hold(self, fingerprint: str) -> None:
        self.pinned.add(fingerprint)

    def release(self, fingerprint: str) -> None:
        self.pinned.discard(fingerprint)

    def forget(self, dataset: str) -> None:
        self.known = OrderedDict((f, d) for f, d in self.known.items() if d != dataset)
