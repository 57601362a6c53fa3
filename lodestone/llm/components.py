"""Connected components of a table of links, without bringing links to one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, checkpoint


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component here, and that smallest node."""
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = place[: len(src)], place[len(src) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(links: DataFrame) -> DataFrame:
    """The same components by fewer links: a star for each component within a batch."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = forest(batch.column("src").to_numpy(), batch.column("dst").to_numpy())
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return arrow_map(links, shrink, "src long, dst long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that links reach, for each node in a link.

    links has two long columns, src and dst. Large-star and small-star rounds alternate
    until nothing changes: the number of rounds grows with the logarithm of the longest
    path, each round shuffles the remaining links once per step, and minima are combined
    before the shuffle, so a node with very many links is no bottleneck. Every round is
    checkpointed in the shared folder.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src <> dst")
    links = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    links = checkpoint(_local(links).distinct())
    before = None
    for _ in range(most_rounds):
        # large star: each node's larger neighbours link to its smallest neighbour
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        # small star: each node and its smaller neighbours link to the smallest of them
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        links = checkpoint(small.where("src <> dst").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
