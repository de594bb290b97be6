"""A table of vectors with texts and labels that is changed by whole versions.

Merge on read: a version names a base and the changes since, each a folder of Parquet rows (see
versions). compact() writes a new base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense
from ..operators.filters import compile_filter
from .versions import Conflict as Conflict
from .versions import Versions

SCHEMA = "id string, text string, labels map<string,string>, numbers map<string,double>, vec array<double>, no long, version int, gone boolean"
#: Bits of a row's number: its partition's rows, then partitions; versions are above.
_ROWS, _PARTITIONS = 24, 20


class VectorStore:
    """Rows (id, text, labels, numbers, vec) by id.

    labels and numbers are the metadata that filters read: text and numbers by name. ``version`` is the one that is read;
    refresh() goes to the newest.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)

    @property
    def version(self) -> int:
        return self.versions.version

    @property
    def base(self) -> list[str]:
        return self.versions.told.get("base", [])

    @property
    def changes(self) -> list[str]:
        return self.versions.told.get("changes", [])

    def refresh(self) -> VectorStore:
        """Goes to the newest version."""
        self.versions.refresh()
        return self

    def _commit(self, base: list[str], changes: list[str]) -> None:
        self.versions.commit({"base": base, "changes": changes})

    # ------------------------------------------------------------ rows

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/rows/{n}" for n in names])

    def rows(self) -> DataFrame:
        """(id, text, labels, numbers, vec, no) of what is held; ``no`` ascends as ids were first stored, those of one version by id."""
        base = self._read(self.base)
        if self.changes:
            changed = self._read(self.changes)
            # only changed ids are brought together; a change counts by its version, and a deletion leaves no row
            last = changed.groupBy("id").agg(F.max_by(F.struct("text", "labels", "numbers", "vec", "no", "gone"), "version").alias("r"))
            base = base.select("id", "text", "labels", "numbers", "vec", "no").join(last.select("id"), "id", "left_anti").unionByName(last.where("not r.gone").select("id", "r.text", "r.labels", "r.numbers", "r.vec", "r.no"))
        return base.select("id", "text", "labels", "numbers", "vec", "no")

    def count(self) -> int:
        return self.rows().count()

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.version + 1:08d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/rows/{name}")
        return name

    def upsert(self, rows: DataFrame) -> None:
        """Adds or replaces rows by id; an id that is held keeps its place in the order.

        rows: id, text, vec and, if they have any, labels (map of text) and numbers (map of double). Of several rows of one id that of
        the largest text counts; rows without an id are left out.
        """
        empty = {"labels": "map<string,string>", "numbers": "map<string,double>"}
        for c, kind in empty.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.create_map().cast(kind))
        told = rows.where("id is not null").select(
            F.col("id").cast("string").alias("id"), F.struct("text", F.col("labels").cast(empty["labels"]).alias("labels"), F.col("numbers").cast(empty["numbers"]).alias("numbers"), F.col("vec").cast("array<double>").alias("vec")).alias("r")
        )
        told = told.groupBy("id").agg(F.max_by("r", F.coalesce("r.text", F.lit(""))).alias("r"))
        told = told.join(self.rows().select("id", F.col("no").alias("held")), "id", "left").orderBy("id")
        at = F.monotonically_increasing_id()
        part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
        checked = F.when((row < 1 << _ROWS) & (part < 1 << _PARTITIONS), F.shiftleft(F.shiftleft(F.lit(self.version + 1).cast("long"), _PARTITIONS) + part, _ROWS) + row).otherwise(F.raise_error("too many rows for one partition").cast("long"))
        new = told.select("id", "r.*", F.coalesce("held", checked).alias("no"), F.lit(self.version + 1).alias("version"), F.lit(False).alias("gone"))
        self._commit(self.base, [*self.changes, self._write(new)])

    def delete(self, ids: DataFrame) -> None:
        """Removes rows by id; ids that are not held change nothing."""
        gone = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
        gone = gone.select("id", *[F.lit(None).cast(k).alias(c) for c, k in (("text", "string"), ("labels", "map<string,string>"), ("numbers", "map<string,double>"), ("vec", "array<double>"), ("no", "long"))], F.lit(self.version + 1).alias("version"), F.lit(True).alias("gone"))
        self._commit(self.base, [*self.changes, self._write(gone)])

    def compact(self) -> None:
        """Writes what is held as a new base; earlier versions stay readable until their folders are removed."""
        rows = self.rows().select("*", F.lit(self.version + 1).alias("version"), F.lit(False).alias("gone"))
        self._commit([self._write(rows)], [])

    # ------------------------------------------------------------ questions

    def kept(self, where: dict | None) -> DataFrame:
        """The rows whose metadata meets a filter; of each name the kind of the filter's value decides whether labels or numbers are read."""
        return self.rows().where(_compiled(where)) if where else self.rows()

    def nearest(self, queries: DataFrame, k: int = 8, where: dict | None = None) -> DataFrame:
        """(qid, id, score, rank): for each query (qid long, vec) its k nearest rows by cosine among those the filter keeps.

        Ties go to the row that was stored first; a zero vector is like nothing, with the score 0.
        """
        kept = self.kept(where).where("vec is not null").select(F.col("no").alias("key"), "id", "vec")
        asked = queries.select((-F.col("qid").cast("long") - 1).alias("key"), "vec")  # keys of queries are below all of rows
        found = dense.cosine_top_k(asked, kept.select("key", "vec"), k, "key", "vec")
        return found.select((-F.col("qid") - 1).alias("qid"), F.col("id").alias("key"), "score", "rank").join(kept.select("key", "id"), "key").select("qid", "id", "score", "rank")

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of the ids (place, id) that are held, with their places; ids that are not are passed over."""
        return ids.select("place", F.col("id").cast("string").alias("id")).join(self.rows().drop("no"), "id").select("place", "id", "text", "labels", "numbers", "vec")

    def drop(self) -> None:
        """A version without rows."""
        self._commit([], [])


def _compiled(spec: dict) -> Column:
    """compile_filter() with each condition on the map that its value's kind belongs to."""
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [_compiled(s) for s in value]
            whole = F.lit(key == "$and")
            for c in inner:
                whole = whole & c if key == "$and" else whole | c
            parts.append(whole)
            continue
        for op, v in value.items() if isinstance(value, dict) else [("$eq", value)]:
            parts.append(_typed(key, op, v))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _typed(key: str, op: str, value) -> Column:
    text, number = F.element_at("labels", F.lit(key)), F.element_at("numbers", F.lit(key))
    one = lambda c, o, v: compile_filter({key: {o: v}}, lambda _: c)
    if op in ("$in", "$nin"):
        found = F.lit(False)
        for v in value:
            found = found | one(text if isinstance(v, str) else number, "$eq", v)
        present = text.isNotNull() | number.isNotNull()
        return present & (~found if op == "$nin" else found)
    if op == "$ne":
        return (text.isNotNull() | number.isNotNull()) & ~one(text if isinstance(value, str) else number, "$eq", value)
    return one(text if isinstance(value, str) else number, op, value)
