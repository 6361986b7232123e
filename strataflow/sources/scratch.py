"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Executors on several machines must see it, so a machine-local folder is used only in local
    mode and only when the setting is absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="strataflow-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Write a table once to the shared folder and continue from the written copy.

    Cuts lineage: later stages re-read files instead of recomputing, also after executors are lost.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
