"""Datasets that are taken in whole or not at all, and the ledger of what was run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.board import latest
from ..plans.config import canonical, fingerprint
from .datasets import CORPUS_SCHEMA, TRUTH_SCHEMA, problems
from .versions import Conflict, Versions

_STORED = "dataset string, fingerprint string, truth_fingerprint string, corpus string, truth string"


class Refused(ValueError):
    """What keeps a dataset out; ``problems`` has a line for each violation."""

    def __init__(self, found: list[str]) -> None:
        super().__init__("; ".join(found))
        self.problems = found


class ImportedDatasets:
    """Corpora with their ground truths by content.

    Storing the same content again changes nothing; other content of a dataset is a new entry beside the old
    one, and the newest counts. Ids in ``builtin`` are refused.
    """

    def __init__(self, spark: SparkSession, path: str, builtin: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.builtin = spark, path.rstrip("/"), builtin
        self.versions = Versions(spark, path)

    def _parsed(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        corpora = rows.select(F.lit("").alias("file"), F.lit(0).alias("source"), F.from_json("corpus", CORPUS_SCHEMA).alias("d"), "dataset").select("file", "source", "d.*", "dataset")
        truths = rows.where("truth is not null").select(F.lit("").alias("file"), F.from_json("truth", TRUTH_SCHEMA).alias("d"), "dataset").select("file", "d.*", "dataset")
        return corpora, truths

    def put(self, corpus: dict, truth: dict | None = None) -> str:
        """Stores a dataset and returns its fingerprint; Refused with all violations, and nothing stored, if it has any."""
        dataset = (corpus.get("corpus_dataset_metadata") or {}).get("dataset")
        told = []
        if not isinstance(dataset, str) or not dataset:
            told.append("the corpus names no dataset")
        elif dataset in self.builtin:
            told.append(f"{dataset} is built in and cannot be replaced")
        if not corpus.get("corpus_documents"):
            told.append("the corpus has no documents")
        meant = ((truth or {}).get("groundtruth_dataset_metadata") or {}).get("corpus_ref") or {}
        if truth is not None and meant.get("dataset") != dataset:
            told.append(f"the ground truth is of {meant.get('dataset')}")
        own = fingerprint(corpus)
        if meant.get("file_fingerprint") not in (None, own):
            told.append(f"the ground truth is of another version: {meant['file_fingerprint']}")
        if told:
            raise Refused(told)
        truth_own = fingerprint(truth) if truth is not None else None
        row = self.spark.createDataFrame([(dataset, own, truth_own, canonical(corpus), canonical(truth) if truth is not None else None)], _STORED)
        found = problems(*self._parsed(row)).select("rule", "place").orderBy("rule", "place").collect()  # of one dataset
        if found:
            raise Refused([f"{r.rule}: {r.place}" for r in found])
        folder = f"{dataset}-{uuid.uuid4().hex}"
        written = False

        def add(versions: Versions) -> dict | None:
            nonlocal written
            entries = versions.told.get("datasets", [])
            if any(e["dataset"] == dataset and (e["fingerprint"], e["truth_fingerprint"]) == (own, truth_own) for e in entries):
                return None
            if not written:
                row.write.parquet(f"{self.path}/rows/{folder}")
                written = True
            return {"datasets": [*entries, {"dataset": dataset, "fingerprint": own, "truth_fingerprint": truth_own, "folder": folder}]}

        self.versions.change(add)
        return own

    def entries(self) -> list[dict]:
        """All that is stored, in the order it came."""
        return list(self.versions.refresh().told.get("datasets", []))

    def _rows(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*[f"{self.path}/rows/{e['folder']}" for e in entries])

    def newest(self) -> tuple[DataFrame, DataFrame]:
        """Corpora and ground truths of each dataset's newest entry, as read_corpora() and read_truths() give them."""
        return self._parsed(self._rows(list({e["dataset"]: e for e in self.entries()}.values())))

    def get(self, own: str, truth_own: str | None = None) -> DataFrame:
        """The stored row of a fingerprint, checked against its content; of several ground truths one must be named."""
        found = [e for e in self.entries() if e["fingerprint"] == own and truth_own in (None, e["truth_fingerprint"])]
        if len(found) != 1:
            raise KeyError(f"{len(found)} entries have the fingerprint {own}")
        rows = self._rows(found)
        checked = F.sha2("corpus", 256).substr(1, len(own)) == F.col("fingerprint")
        return rows.withColumn("corpus", F.when(checked, F.col("corpus")).otherwise(F.raise_error(F.lit(f"the content of {own} has changed"))))


#: What a finished job's row is made of: column, its type, its places in the job in order of choice.
_PROJECTED = (
    ("experiment_id", "string", ("result.run_id", "id")),
    ("kind", "string", ("kind",)),
    ("label", "string", ("result.label", "label")),
    ("started_at", "string", ("result.started_at", "started_at")),
    ("seconds", "double", ("result.seconds", "seconds")),
    ("dataset", "string", ("result.dataset", "config.index.dataset")),
    ("provider", "string", ("provider",)),
    ("split_plan", "string", ("config.index.split_plan",)),
    ("embedder", "string", ("config.index.embedder",)),
    ("retriever", "string", ("config.retrieval.retriever",)),
    ("reranker", "string", ("config.retrieval.reranker",)),
    ("answerer", "string", ("config.generation.answerer",)),
    ("n_questions", "bigint", ("result.summary.n_questions", "result.selection.n")),
    ("decision", "double", ("result.ragas.decision",)),
    ("decision_stderr", "double", ("result.ragas.decision_spread.stderr",)),
    ("error", "string", ("error",)),
)


def ledger_rows(jobs: DataFrame, heavy: tuple[str, ...] = ("corpus", "ground_truth")) -> DataFrame:
    """A flat row for every job (value: JSON text, state): the columns of _PROJECTED, state, and detail as JSON text.

    Text that is missing is empty, counts are 0, other numbers null. An index job has no retrieval and no
    answers, so its columns of these are empty. detail is the result without ``heavy`` keys, and with the configuration
    where the result has none. What is no JSON object gives a row of blanks.
    """

    def of(kind: str, places: tuple[str, ...]):
        found = F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{p}"), F.lit("")) for p in places])
        if kind == "string":
            return F.coalesce(found, F.lit(""))
        number = found.try_cast(kind)
        return F.coalesce(number, F.lit(0).cast(kind)) if kind == "bigint" else number

    columns = []
    index_job = F.coalesce(F.get_json_object("value", "$.kind"), F.lit("")) == "index"
    for name, kind, places in _PROJECTED:
        c = of(kind, places)
        columns.append((F.when(index_job, "").otherwise(c) if name in ("retriever", "reranker", "answerer") else c).alias(name))
    result = F.from_json(F.coalesce(F.get_json_object("value", "$.result"), F.lit("{}")), "map<string,string>")
    kept = F.map_filter(F.coalesce(result, F.from_json(F.lit("{}"), "map<string,string>")), lambda k, _: ~k.isin(*heavy))
    config = F.coalesce(F.get_json_object("value", "$.config"), F.lit("{}"))
    # values that are objects stay JSON, others become JSON
    told = F.map_concat(kept, F.when(F.map_contains_key(kept, "config"), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("config"), config)))
    detail = F.to_json(told)
    return jobs.select(*columns, "state", detail.alias("detail"))


class SequencedLedger:
    """Jobs by id, each record with a number of its own: two writers never get one number, and the newest record of an id counts."""

    COLUMNS = "experiment_id string, kind string, label string, started_at string, seconds double, dataset string, provider string, split_plan string, embedder string, retriever string, reranker string, answerer string, n_questions long, decision double, decision_stderr double, error string, state string, detail string, seq long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)

    def record(self, rows: DataFrame) -> int:
        """Adds rows of ledger_rows() as one record; returns its number."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{folder}")
        self.versions.change(lambda v: {"records": [*v.told.get("records", []), folder]})
        return self.versions.told["records"].index(folder) + 1

    def rows(self) -> DataFrame:
        """All records with their numbers."""
        told = self.versions.refresh().told.get("records", [])
        if not told:
            return self.spark.createDataFrame([], self.COLUMNS)
        numbers = self.spark.createDataFrame([(f, i + 1) for i, f in enumerate(told)], "folder string, seq long")  # one for each record
        read = self.spark.read.schema(self.COLUMNS.rsplit(",", 1)[0]).parquet(*[f"{self.path}/rows/{f}" for f in told])
        return read.withColumn("folder", F.regexp_extract(F.input_file_name(), "/rows/([0-9a-f]{32})/", 1)).join(F.broadcast(numbers), "folder").drop("folder")

    def experiments(self, limit: int = 100) -> DataFrame:
        """The newest record of each id, the newest first."""
        return latest(self.rows(), ["experiment_id"], [F.desc("seq")]).orderBy(F.desc("seq")).limit(limit)


__all__ = ["Conflict", "ImportedDatasets", "Refused", "SequencedLedger", "ledger_rows"]
