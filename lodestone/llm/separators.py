"""Token counts of documents in flat token files that have no index.

A token file is ids one after the other, each document ended by one separator id. Files are
read by byte ranges, blocks of a fixed number of ids; each block is searched for separators
by NumPy, and a prefix scan over each file's blocks (how many separators came before, and where
the last one was) stitches documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_map, documents, shared_folder, table
from .tokens import token_blocks, tokenizer_path

#: The default tokenizer's end-of-text id, which no text is encoded to where its string counts as ordinary text.
SEPARATOR = 49407
IDS_PER_BLOCK, BLOCKS_PER_TASK = 1 << 20, 32


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; Spark's s3a is pyarrow's s3."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def token_file_list(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes of the files under path; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def read_blocks(files: DataFrame, dtype: str = "<u4", ids_per_block: int = IDS_PER_BLOCK) -> DataFrame:
    """file, block, data: a row for each block of each file (file, n_bytes) of any size, read by the task that holds the row."""
    width = np.dtype(dtype).itemsize * ids_per_block

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n_bytes")), strict=True):
                system, path = located(name)
                with system.open_input_file(path) as source:
                    data = source.read_at(min(width, n - block * width), block * width)
                yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})

    files = files.where("n_bytes > 0")
    last = F.floor((F.col("n_bytes") - 1) / width)
    ranges = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    # rows are small, but what they stand for isn't: a given number of partitions keeps Spark from merging them
    number = files.agg(F.sum(last + 1)).first()[0] or 1
    tasks = max(-(-number // BLOCKS_PER_TASK), min(number, files.sparkSession.sparkContext.defaultParallelism))
    return arrow_map(ranges.repartition(tasks, "file", "block"), read, "file string, block long, data binary")


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u4", ids_per_block: int = IDS_PER_BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens (with the separator) of each document; ended is false for ids after a file's last separator.

    blocks has file, block (from 0) and data; every block of a file but the last has
    ids_per_block ids. Defined results: an empty document counts its separator alone;
    an empty file or table gives no row; a file without a separator is one document, not ended.
    """
    return stitched(arrow_map(blocks.select("file", "block", "data"), searcher(separator, dtype, ids_per_block), FOUND))


FOUND = "file string, block long, upto long, ends array<long>"


def searcher(separator: int, dtype: str, ids_per_block: int):
    """Maps batches of blocks to where each block ends and where its separators are."""
    kind = np.dtype(dtype)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column("block").to_numpy() * ids_per_block
            found, sizes = [], []
            for at, data in zip(base.tolist(), batch.column("data"), strict=True):
                ids = np.frombuffer(data.as_buffer(), kind)
                found.append(np.flatnonzero(ids == separator) + at)
                sizes.append(at + len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "block": batch.column("block"), "upto": pa.array(sizes, pa.int64()), "ends": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))})

    return search


def stitched(scanned: DataFrame) -> DataFrame:
    """The documents of searched blocks, by a prefix scan over each file's blocks, a few numbers for each."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.try_element_at("ends", F.lit(-1))
    few = scanned.select("file", "block", F.size("ends").alias("n"), own.alias("own"))
    few = few.select(
        "file", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.max("own").over(before), F.lit(-1)).alias("last_end"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("tail"),
    )
    rows = scanned.join(few, ["file", "block"])
    # what follows a file's last separator is one more entry, marked by its place past the end
    rows = rows.withColumn("open", F.when(F.col("tail") & (F.col("upto") - 1 > F.greatest(F.coalesce(own, F.lit(-1)), "last_end")), F.array("upto")))
    each = rows.select("file", "n_before", "last_end", "ends", F.posexplode(F.concat("ends", F.coalesce("open", F.array().cast("array<bigint>")))).alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("last_end")).otherwise(F.try_element_at("ends", F.greatest(F.col("i"), F.lit(1)))) + 1
    ended = F.col("i") < F.size("ends")
    return each.select("file", (F.col("n_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start + ended.cast("int")).alias("n_tokens"), ended.alias("ended"))


OWNERS = "file string, n_bytes long, first long, documents array<long>"


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, separator: int = SEPARATOR, dtype: str = "<u4") -> DataFrame:
    """Writes a flat file of ids a partition under folder, which all executors share.

    Returns who is in them: file, n_bytes (in a file's last row, else 0), first (ordinal of the row's first
    document), documents. Every attempt of a task writes a file of its own, and the rows name
    those of the attempts that count, so a lost executor leaves no wrong file among them.
    """
    path, kind = path or tokenizer_path(), np.dtype(dtype)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ordinal, written = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0
        system, place = located(name)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place) as out:
            for block, ids, _ in token_blocks(batches, path, separator, special=False):
                if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"an id does not fit in {dtype}")
                written += out.write(ids.astype(kind).tobytes())
                yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": pa.array([0], pa.int64()), "first": pa.array([ordinal], pa.int64()), "documents": pa.array([block.ids], pa.list_(pa.int64()))})
                ordinal += len(block)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": pa.array([written], pa.int64()), "first": pa.array([ordinal], pa.int64()), "documents": pa.array([[]], pa.list_(pa.int64()))})

    return table(arrow_map(documents(docs, key, text), write, OWNERS, "word_bpe"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, separator: int = SEPARATOR, dtype: str = "<u2", ids_per_block: int = IDS_PER_BLOCK) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens (with its separator) of each document, found by scanning the token files of docs.

    docs are written as flat files in the shared checkpoint folder and these are read
    again by byte ranges. The scan alone finds boundaries; the documents' ids only name
    what it found. Defined results: a null or empty text has its separator alone; rows without
    an id are left out; repeated rows are documents each; the tokenizer's special strings in a
    text are ordinary text; an empty table gives an empty table.
    """
    owners = write_token_files(docs, f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", key, text, path, separator, dtype)
    files = owners.where("n_bytes > 0").select("file", "n_bytes")
    found = table(arrow_map(read_blocks(files, dtype, ids_per_block), searcher(separator, dtype, ids_per_block), FOUND))
    names = owners.select("file", "first", F.posexplode("documents").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return stitched(found).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op10(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("file", F.regexp_extract("file", "part-[0-9]+", 0))
