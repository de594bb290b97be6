"""Steps of an operator that cut their lineage by a table in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def step_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a local session takes one of its warehouse and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def saved(table: DataFrame, name: str = "step") -> DataFrame:
    """The table as written and read back; it stays until the folder is cleaned."""
    spark = table.sparkSession
    path = f"{step_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)
