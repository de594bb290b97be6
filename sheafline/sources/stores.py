"""Stores of corpora, runs, jobs and archives as Parquet tables that are only appended to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.board import latest
from ..plans.config import canonical, fingerprint


class Store:
    """A folder of rows; the newest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        """All rows; none where nothing was stored yet. Columns that older files lack are null."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("mergeSchema", "true").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


class CorpusVersions(Store):
    """Content-addressed corpora: a version is its fingerprints; storing it again changes nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, "fingerprint string, truth_fingerprint string, dataset string, stored_at timestamp, corpus string, truth string")

    def put(self, corpus: dict, truth: dict | None) -> str:
        key, truth_key = fingerprint(corpus), fingerprint(truth) if truth is not None else ""
        held = self.rows().where((F.col("fingerprint") == key) & (F.col("truth_fingerprint") == truth_key)).select("corpus").limit(1).collect()
        if held:
            if held[0].corpus != canonical(corpus):
                raise ValueError(f"another corpus has the fingerprint {key}")
            return key
        row = [(key, truth_key, corpus.get("corpus_dataset_metadata", {}).get("dataset"), canonical(corpus), canonical(truth) if truth is not None else None)]
        new = self.spark.createDataFrame(row, "fingerprint string, truth_fingerprint string, dataset string, corpus string, truth string")
        self.append(new.withColumn("stored_at", F.current_timestamp()).select(*[c.split()[0] for c in self.schema.split(", ")]))
        return key

    def get(self, key: str) -> dict:
        """The corpus, its fingerprint checked; an error if it is unknown or stored under several truths."""
        rows = self.rows().where(F.col("fingerprint") == key).select("corpus", "truth_fingerprint").limit(2).collect()
        if not rows:
            raise KeyError(key)
        if len(rows) > 1:
            raise LookupError(f"{key} is stored with several ground truths")
        corpus = json.loads(rows[0].corpus)
        if fingerprint(corpus) != key:
            raise ValueError(f"what is stored as {key} has another fingerprint")
        return corpus

    def versions(self) -> DataFrame:
        return self.rows().select("dataset", "fingerprint", "truth_fingerprint", "stored_at").orderBy("dataset", F.desc("stored_at"))


class Ledger(Store):
    """Jobs by id: the newest row of an id counts; ``detail`` is JSON."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, "experiment_id string, seq long, kind string, state string, label string, started_at string, dataset string, decision double, detail string")

    def record(self, job: dict) -> None:
        seq = self.rows().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        row = (job["id"], seq, job.get("kind"), job.get("state"), job.get("label"), job.get("started_at"), job.get("dataset"), job.get("decision"), canonical(job.get("detail", {})))
        self.append(self.spark.createDataFrame([row], self.schema))

    def experiments(self, limit: int = 100) -> DataFrame:
        return latest(self.rows(), ["experiment_id"], [F.desc("seq")]).orderBy(F.desc("seq")).limit(limit)

    def annotations(self, parent: str) -> DataFrame:
        """Finished questions whose detail names the parent."""
        rows = latest(self.rows(), ["experiment_id"], [F.desc("seq")])
        return rows.where((F.col("kind") == "question") & (F.col("state") == "done") & (F.get_json_object("detail", "$.annotates") == parent))

    def insert_if_absent(self, rows: DataFrame) -> None:
        self.append(rows.join(self.rows().select("experiment_id").distinct(), "experiment_id", "left_anti").select(*[c.split()[0] for c in self.schema.split(", ")]))


#: Bounds of an archive.
MAX_DEPTH, MAX_QUESTIONS, MAX_BYTES = 32, 5000, 32 << 20
_CREDENTIAL_WORDS = ("api_key", "apikey", "password", "secret", "token", "authorization")


def archive_problems(archive: dict) -> list[str]:
    """What keeps a JSON object from being stored as an archive."""
    out: list[str] = []

    def walk(x, path: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            out.append(f"{path}: nested too deep")
            return
        if isinstance(x, dict):
            for k, v in x.items():
                if any(k.lower() == w or k.lower().endswith("_" + w) for w in _CREDENTIAL_WORDS):
                    out.append(f"{path}.{k}: looks like a credential")
                walk(v, f"{path}.{k}", depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]", depth + 1)
        elif isinstance(x, float) and x != x:
            out.append(f"{path}: not a number")

    walk(archive, "$", 0)
    if len(archive.get("rows", [])) > MAX_QUESTIONS:
        out.append("too many questions")
    if not out and len(canonical(archive).encode()) > MAX_BYTES:
        out.append("too large")
    return out


def shrink(archive: dict, versions: CorpusVersions) -> dict:
    """The archive with its corpus stored by itself and named by fingerprint."""
    if "corpus" not in archive:
        return archive
    return {k: v for k, v in archive.items() if k != "corpus"} | {"corpus_fingerprint": versions.put(archive["corpus"], archive.get("truth"))}


def swell(archive: dict, versions: CorpusVersions) -> dict:
    """The archive with its corpus put back, checked."""
    if "corpus_fingerprint" not in archive:
        return archive
    return {k: v for k, v in archive.items() if k != "corpus_fingerprint"} | {"corpus": versions.get(archive["corpus_fingerprint"])}


def save_run(spark: SparkSession, run: dict, folder: str) -> None:
    """One JSON line in the folder; numbers that are not finite are refused."""
    spark.createDataFrame([(canonical(run),)], "value string").coalesce(1).write.mode("append").text(folder)


def list_runs(spark: SparkSession, folder: str, limit: int = 50) -> DataFrame:
    """run_id, label, summary of the newest runs by id; rows that are no runs are passed over, questions are left out."""
    raw = spark.read.text(folder)
    told = raw.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("run_id", "label", "summary")])
    return told.where("run_id is not null").orderBy(F.desc("run_id")).limit(limit)


def stage_results(metrics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(run_id, stage, metrics map): every metric under the stage that the catalogue names, else overall."""
    rows = metrics.select("run_id", F.explode("metrics").alias("name", "value")).join(catalogue, "name", "left")
    return rows.groupBy("run_id", F.coalesce("stage", F.lit("overall")).alias("stage")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A table of at most ``limit`` rows as Markdown."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]])
