"""Tables that a plan in rounds writes between them, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir (the warehouse where that is unset) and read back, so that lineage ends here."""
    spark = df.sparkSession
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{folder}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
