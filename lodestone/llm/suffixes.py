"""Suffix-array de-duplication of byte strings.

``repeated_by_doubling`` is prefix doubling as such: every position is ranked by its first
bytes, then by the pair (rank here, rank at an offset), which ranks it by more bytes, until its
rank is unique or the threshold (50 bytes) is reached. Each round shuffles every position that is
left, so a table is moved many times its size (README has the measured figures), more than
the budget of ``op3`` allows.

``suffix_array_dedup``, which ``op3`` and the pipeline use, therefore does not double ranks. It
groups positions by anchored runs (see ``repeats``): runs with a unique anchor leave first,
positions that share their anchor and all bytes around it move as one run, and what is
still open is named by whole windows. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, ranges
from .repeats import remove_repeats
from .shared import arrow_map, documents, table

START = 7  # bytes that one long holds in order


def repeated_by_doubling(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """doc, lo of each string of ``size`` bytes that also starts in a document with a smaller id, by prefix doubling.

    A rank is the first position (document and place) of its group, so ranks are exact. A position
    whose rank is unique leaves, and with it every position that would pair with it.
    Defined results: null and short texts have no such string; of documents of equal id
    each position counts as one of that id; rows without an id are left out; an empty table gives none.
    """
    if size < START:
        raise ValueError(f"size must be {START} at least")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "doc_id", "text", 1 << 18):
            length = np.maximum(np.diff(block.offsets) - START + 1, 0)
            place = ranges(np.zeros(len(block), np.int64), length)
            at = np.repeat(block.offsets[:-1], length) + place
            rank = np.zeros(len(at), np.int64)
            for i in range(START):
                rank = rank << 8 | block.data[at + i].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(np.repeat(block.ids, length)), "lo": pa.array(place), "rank": pa.array(rank)})

    ranked = table(arrow_map(documents(docs, key, text), first, "doc long, lo long, rank long").withColumn("rank", F.struct(F.lit(0).cast("long").alias("doc"), F.col("rank").alias("lo"))))
    known = START
    while known < size:
        step = min(known, size - known)
        there = ranked.select("doc", (F.col("lo") - step).alias("lo"), F.col("rank").alias("next"))
        pairs = ranked.join(there, ["doc", "lo"])
        groups = pairs.groupBy("rank", "next").agg(F.min(F.struct("doc", "lo")).alias("new"), F.count("*").alias("n")).where("n > 1").drop("n")
        known += step
        ranked = table(pairs.join(groups, ["rank", "next"]).select("doc", "lo", F.col("new").alias("rank")))
    return ranked.where("doc > rank.doc").select("doc", "lo")


def suffix_array_dedup(docs: DataFrame, size: int = 50, **options) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept: without bytes of strings of ``size`` bytes that also start in a document with a smaller id.

    Defined results: a null, empty or short text loses nothing; of exact copies the one with the
    smallest id stays whole, so ties between equal ids remove nothing; rows without an id are left
    out; documents of equal id count as one document; very long texts are read whole; an
    empty table gives an empty table; extra columns are not looked at.
    """
    return remove_repeats(docs, unit="bytes", size=size, **options)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """docs with the repeated spans cut out of the texts, to whole characters; n_chars, if there, is counted anew. All other columns stay, and rows without an id stay as they are.

    Defined results: null, empty and short texts stay, null ones as empty texts; of copies the one with the smallest id stays whole,
    and of repeated rows of one id all do; very long texts are read whole; an empty table gives an empty table.
    """
    out = suffix_array_dedup(docs, size, key=key, text=text, whole_characters=True, carry=docs.columns)
    kept = F.col("kept").cast("string")
    column = {text: kept} | ({"n_chars": F.char_length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[column.get(c, F.col("carried")[c]).alias(c) for c in docs.columns]).unionByName(docs.where(F.col(key).isNull()))


def op3(spark, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
