"""Sets of word shingles and their exact Jaccard similarity, for candidates that SimHash finds."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Substrings, blocks, mix, ranges
from .shared import arrow_map, table


def sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased words and their document (sorted by both), the sets' sizes and names."""
    words = block.words(fold=True)
    counts = words.counts()
    of_doc = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    doc = np.repeat(np.arange(len(block)), of_doc)
    first = np.repeat(words.first[:-1], of_doc) + ranges(np.zeros(len(counts), np.int64), of_doc)
    value = Substrings(words.hashes(0), 0).at(first, np.minimum(first + shingle, words.first[doc + 1]))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    size = np.bincount(doc, minlength=len(block))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(1)), dtype=np.uint64)])
    end = np.cumsum(size)
    return value, doc, size, mix(total[end] - total[end - size] + mix(size.astype(np.uint64)))


def whole(docs: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "doc_id", "text"):
            value, _, size, name = sets(block, shingle)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"node": pa.array(name.view(np.int64)), "shingles": pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))})

    return arrow_map(docs, scan, "node long, shingles array<long>")


def sets_of(nodes: DataFrame, firsts: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of nodes, from one document of each (firsts: node, doc_id)."""
    ids = firsts.join(nodes.distinct(), "node", "left_semi").select("doc_id")
    return table(whole(docs.join(ids, "doc_id", "left_semi"), shingle).dropDuplicates(["node"]))


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs whose whole sets have the similarity."""
    found = sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("node")), firsts, docs, shingle)
    side = lambda name, column: found.select(F.col("node").alias(name), F.col("shingles").alias(column))
    common = F.size(F.array_intersect("a", "b"))
    fine = common * (least.numerator + least.denominator) >= (F.size("a") + F.size("b")) * least.numerator
    return pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where(fine).select("src", "dst")
