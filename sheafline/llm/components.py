"""Connected components of a table of links, by Spark joins and aggregates only.

Tasks first turn their share of the links into trees by union-find. Then it
alternates the two star operations of Kiveris et al. (Connected Components in
MapReduce and Beyond, 2014): every node hands its larger neighbours, and then
its smaller ones, to the smallest node it knows. The number of rounds grows with
the logarithm of the number of nodes, and no link reaches the driver. Each
round is cut from its lineage by a table in the shared checkpoint folder.
"""

from __future__ import annotations

import gc
import math
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; read from spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) takes a folder of its
    warehouse; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


#: Bytes of rows that a Python worker is sent at once while a step is saved; a longer row goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES, which worker and JVM hold several copies of; the session's setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Scratch:
    """Tables written to the shared folder; retain() removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.held: list[tuple[str, DataFrame]] = []

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def save(self, table: DataFrame) -> DataFrame:
        """Writes the table and returns it as read back, without its lineage."""
        path = self.path()
        with small_batches(self.spark):
            table.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(table.schema).parquet(path)
        self.held.append((path, saved))
        return saved

    def retain(self, *tables: DataFrame) -> None:
        """Removes every saved table but these."""
        for path, saved in self.held:
            if not any(saved is t for t in tables):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.held = [(p, t) for p, t in self.held if any(t is x for x in tables)]


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps: it does so once their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Links that one task joins into trees at most.
CHUNK_LINKS = 1 << 20


def _forest(batches):
    """(u, v) for every node of this task's links but the smallest of its tree, which is v."""
    links = [np.column_stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if links:
        links = np.concatenate(links)
        nodes, at = np.unique(links, return_inverse=True)
        at = at.reshape(-1, 2)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in at.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        top = np.array([root(x) for x in range(len(nodes))])
        other = np.flatnonzero(top != np.arange(len(nodes)))
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[other], pa.int64()), "v": pa.array(nodes[top[other]], pa.int64())})


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60, chunk: int = CHUNK_LINKS) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Null ends and links of a node to itself are ignored; repeated links count once.
    Each task first turns at most ``chunk`` links into trees; where one task can take
    all of them, that is the result, else the trees of all tasks go through the rounds.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = scratch.save(edges)
    tasks = math.ceil(edges.count() / chunk)
    dealt = edges.coalesce(1) if tasks <= 1 else edges.repartition(2 * tasks)
    edges = scratch.save(dealt.mapInArrow(_forest, "u long, v long").select("u", "v"))
    for _ in range(most_rounds if tasks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # saved first, so that both sides of the join are plain exchanges and Spark can split a hub's rows
        lowest = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = scratch.save(small)
        if not _changed(edges, new):
            break
        edges = new
    else:
        if tasks > 1:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))


def _changed(old: DataFrame, new: DataFrame) -> bool:
    def digest(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    return digest(old) != digest(new)
