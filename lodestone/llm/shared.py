"""What several operators share: input columns, cut lineage, sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id (long) and text only, so extra columns can't clash; rows without an id are left out."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, spark.checkpoint.dir; on a laptop where it is unset, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed now and written to the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared checkpoint folder and read again.

    For frames that are large or read twice: smaller than a checkpoint, and a lost executor
    costs a read, not the work before it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filtered(docs: DataFrame, text: str, good, owner: str = "") -> DataFrame:
    """The rows of docs whose block good(block) finds good, with all their columns, in one pass without a shuffle.

    good maps a block of texts to a boolean array; the block's ids are only places.
    """
    import numpy as np
    import pyarrow as pa

    from .blocks import blocks

    place = docs.columns.index(text)

    def scan(batches):
        for batch in batches:
            column = batch.column(place).cast(pa.large_string())
            alone = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), column], ["place", "text"])
            for block in blocks(iter([alone]), "place", "text"):
                part = batch.slice(int(block.ids[0]), len(block))
                yield part.filter(pa.array(np.asarray(good(block), bool)))

    return arrow_map(docs, scan, docs.schema, owner)


_STATE: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one operator's state at a time, so that workers that run several in turn stay small."""
    if key not in _STATE:
        forget(key[0])
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def forget(owner: str) -> None:
    """Drops what other operators than owner keep in this worker."""
    if any(k[0] != owner for k in _STATE):
        _STATE.clear()
        release()


def release() -> None:
    """Hands a worker's free memory back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, function: Callable, schema, owner: str = "") -> DataFrame:
    """df.mapInArrow(function), after which the worker's free memory is released; what other operators than owner keep in the worker goes first."""

    def run(batches):
        forget(owner)
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)
