"""Substring de-duplication of word windows behind a count-min prefilter.

Every task keeps a count-min sketch of its windows; the merged sketch overestimates how
many documents hold a window, so windows estimated in one document only are in one only.
A window's key in the sketch is its anchor (see ``repeats``), which equal windows share;
counting anchors instead of windows keeps the estimate an upper bound and needs a tenth
of the counters. A second pass groups exactly the windows estimated repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import remove_repeats


def substring_dedup(docs: DataFrame, size: int = 50, **options) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept: without words of windows of ``size`` words that also start in a document with a smaller id.

    Defined results: a null, empty or short text loses nothing; of exact copies the one with the
    smallest id stays whole, so ties between equal ids remove nothing; rows without an id are left
    out; documents of equal id count as one document; very long texts are read whole; an
    empty table gives an empty table; extra columns are not looked at.
    """
    return remove_repeats(docs, unit="words", size=size, k=options.pop("k", max(size // 6, 1)), **options)


def op8(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
