"""Tables between the steps of a plan that is built in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one of our own where it is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            root = kept.get()
        elif context.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="spark-scratch-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root.rstrip("/")


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to a table in the scratch folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
