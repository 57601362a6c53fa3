"""Reading tables, files and token-free bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path (relative to root), size, modified, content of the files under a local or remote root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", "/")
    plain = "/" + base.split("://", 1)[-1].lstrip("/") if "://" in base else base
    return reader.load(root).select(F.when(relative.startswith(plain + "/"), F.substr(relative, F.lit(len(plain) + 2))).otherwise(F.substring_index(relative, "/", -1)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
