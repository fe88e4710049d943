"""The folder that driver and executors share for intermediate data."""
from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where none is named, a folder inside the warehouse serves a local session. A cluster
    must name one: its executors cannot see each other's local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return folder.rstrip("/")
