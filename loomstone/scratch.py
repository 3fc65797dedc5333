"""Tables that cut a lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        named = tempfile.mkdtemp(prefix="loomstone-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = f"{shared_dir(spark)}/loomstone-core-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
