"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance D = 2 - 2t. Vectors are rotated
(so that their energy spreads over all coordinates) and split into blocks of eight
coordinates. If a pair's squared distances over all blocks sum to D at most, some block's
is within its proportional share of D. Each block is therefore joined by range: a grid over
three of its coordinates, with cells twice as wide as the block's radius, where a vector
also visits the neighbouring cells that its radius reaches.

The range join moves a block's eight coordinates only, and compares the squared distance within
the block with its share; rows without a partner in their cell end there. The rest fetch their whole
vectors, meet in their cells again, and candidates are verified by the cosine, in double precision.

Pairs never leave the task that holds a cell. A link counts in the first block whose share it meets, so once
however many blocks find it; what leaves are link counts and a spanning forest. Exact
copies are one vector with a weight. A cell with many vectors is dealt out in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ranges
from .components import components, forest
from .shared import arrow_map, checkpoint
from .shared import table as table_of

WIDTH, GRID = 8, 3
_SIGNS = np.where(np.random.Generator(np.random.PCG64(64)).random((2, 1 << 16)) < 0.5, -1.0, 1.0)


def rotate(x: np.ndarray) -> np.ndarray:
    """Random signs and a Hadamard transform, twice; by element, so a row's result never depends on the others."""
    size = max(WIDTH, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for signs in _SIGNS:
        y *= signs[:size] if size <= signs.size else np.resize(signs, size)
        span = 1
        while span < size:
            z = y.reshape(len(y), -1, 2, span)
            a, b = z[:, :, 0].copy(), z[:, :, 1].copy()
            z[:, :, 0], z[:, :, 1] = a + b, a - b
            span *= 2
        y /= np.sqrt(size)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shares(size: int, distance: float) -> tuple[float, float]:
    """Squared distance and radius of one block, a little enlarged for rounding."""
    share = distance * WIDTH / size * (1 + 1e-9) + 1e-12
    return share, float(np.sqrt(share))


def _vectors(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)


CELL = "label long, dim int, block int, cell long, visitor boolean, rep long, copies long, part array<float>"
KEY = ["label", "dim", "block", "cell"]
TILE = [*KEY, "t0", "t1"]


def cells(vectors: DataFrame, distance: float) -> DataFrame:
    """A row for each block of each vector and each cell that it stands in or visits, with the block's coordinates (part)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                dims, column = batch.column("dim").to_numpy(), batch.column("vector")
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    turned = rotate(unit(_vectors(column, rows, int(dim))))
                    _, radius = shares(turned.shape[1], distance)
                    for block in range(turned.shape[1] // WIDTH):
                        value = turned[:, block * WIDTH : block * WIDTH + GRID] / (2 * radius)
                        home = np.floor(value).astype(np.int64)
                        high = value - home >= 0.5 - 1e-9  # within the radius of the upper border
                        low = value - home <= 0.5 + 1e-9
                        for code in range(3**GRID):
                            move = np.array([code // 3**i % 3 - 1 for i in range(GRID)])
                            if tuple(move) < (0,) * GRID:  # of two neighbouring cells, the lesser one's vectors visit
                                continue
                            go = np.flatnonzero(((move == 0) | ((move > 0) & high) | ((move < 0) & low)).all(axis=1))
                            if not len(go):
                                continue
                            to = home[go] + move
                            names = pa.array(((to + (1 << 20)) << np.array([42, 21, 0])).sum(axis=1))  # |coordinate| is at most 1, a radius at least 1e-6
                            pick = batch.take(pa.array(rows[go]))
                            yield pa.RecordBatch.from_pydict({"label": pick.column("label"), "dim": pick.column("dim"), "block": pa.array(np.full(len(go), block, np.int32)), "cell": names, "visitor": pa.array(np.full(len(go), bool(move.any()))), "rep": pick.column("rep"), "copies": pick.column("copies"), "part": pa.ListArray.from_arrays(pa.array(np.arange(len(go) + 1, dtype=np.int32) * WIDTH), pa.array(turned[go, block * WIDTH : (block + 1) * WIDTH].astype(np.float32).ravel()))})

    return arrow_map(vectors, deal, CELL)


def compare(rows: dict[str, np.ndarray], vectors: np.ndarray, start: np.ndarray, threshold: float, small: int = 64, step: int = 512) -> tuple[np.ndarray, ...]:
    """Ids and link counts, and a spanning forest, of the links within each cell's tile that first meet their share in that cell's block.

    start has each tile's first row. Small tiles are compared together, large ones step by step.
    """
    x = unit(vectors)
    y = rotate(x)
    share, _ = shares(y.shape[1], 2 - 2 * threshold)
    size = np.diff(np.append(start, len(x)))
    count, src, dst = np.zeros(len(x), np.int64), [], []

    def check(i: np.ndarray, j: np.ndarray, dots: bool) -> None:
        use = rows["visitor"][j] | (i < j)  # two at home meet once
        use &= (rows["t0"][i] == rows["t1"][i]) | (rows["chunk"][i] != rows["chunk"][j])
        i, j = i[use], j[use]
        for lot in np.array_split(np.arange(len(i)), len(i) // 20_000 + 1):
            p, q = i[lot], j[lot]
            if dots:
                near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[near], q[near]
            if not len(p):
                continue
            met = ((y[p] - y[q]) ** 2).reshape(len(p), -1, WIDTH).sum(axis=2) <= share
            own = met[np.arange(len(p)), rows["block"][p]] & (met.argmax(axis=1) == rows["block"][p])
            p, q = p[own], q[own]
            np.add.at(count, p, rows["copies"][q])
            np.add.at(count, q, rows["copies"][p])
            s, d = forest(rows["rep"][p], rows["rep"][q])
            src.append(s), dst.append(d)

    home = np.flatnonzero(~rows["visitor"])
    tile = np.searchsorted(start, home, "right") - 1
    few = size[tile] <= small
    for lot in np.array_split(np.flatnonzero(few), int(size[tile[few]].sum()) // 500_000 + 1):
        check(np.repeat(home[lot], size[tile[lot]]), ranges(start[tile[lot]], size[tile[lot]]), True)
    for g in np.unique(tile[~few]):
        own, end = home[tile == g], start[g] + size[g]
        for a in range(0, len(own), step):
            left = own[a : a + step]
            for b in range(start[g], end, step):
                i, j = np.nonzero(x[left] @ x[b : min(b + step, end)].T >= threshold)
                check(left[i], b + j, False)
    some = count > 0
    s, d = forest(np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64),) * 2
    return rows["rep"][some], count[some], s, d


def tiled(made: DataFrame, most: int) -> DataFrame:
    """made with tiles (t0, t1) and chunk: cells above most rows are dealt out in chunks, and any two chunks make a tile."""
    size = made.groupBy(*KEY).agg(F.count("*").alias("rows")).where(F.col("rows") > most).withColumn("chunks", F.ceil(F.col("rows") / most).cast("int"))
    dealt = made.join(size.drop("rows"), KEY, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("t0", F.least("chunk", "other")).withColumn("t1", F.greatest("chunk", "other")).drop("chunks", "other")


def tile_map(rows: DataFrame, close: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Maps whole tiles, some at a time: close gets rows in order of their tiles and where each tile starts."""

    def starts(part: pa.Table) -> np.ndarray:
        keys = np.stack([part.column(c).to_numpy() for c in TILE])
        return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tile, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            start = starts(part)
            if start[-1]:
                yield from close(part.slice(0, int(start[-1])), start[:-1])
            held = part.slice(int(start[-1]))
        if held is not None and held.num_rows:
            yield from close(held, np.zeros(1, np.int64))

    return arrow_map(rows.repartition(*TILE).sortWithinPartitions(*TILE), meet, schema)


def partnered(dealt: DataFrame, distance: float, small: int = 64, step: int = 512) -> DataFrame:
    """Rows of tiles (without part) that have a partner within the block's share of distance."""

    def close(part: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = part.column("part").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, WIDTH)
        dims, visitor = part.column("dim").to_numpy(), part.column("visitor").to_numpy(zero_copy_only=False)
        share = np.array([shares(max(WIDTH, 1 << (int(d) - 1).bit_length()), distance)[0] for d in dims[start]]) * (1 + 1e-4) + 1e-6  # coordinates came in single precision
        size, near = np.diff(np.append(start, len(x))), np.zeros(len(x), bool)
        home = np.flatnonzero(~visitor)
        tile = np.searchsorted(start, home, "right") - 1
        few = size[tile] <= small
        for lot in np.array_split(np.flatnonzero(few), int(size[tile[few]].sum()) // 500_000 + 1):
            i, j = np.repeat(home[lot], size[tile[lot]]), ranges(start[tile[lot]], size[tile[lot]])
            hit = (i != j) & (((x[i] - x[j]) ** 2).sum(axis=1) <= np.repeat(share[tile[lot]], size[tile[lot]]))
            near[i[hit]] = near[j[hit]] = True
        square = (x * x).sum(axis=1)
        for g in np.unique(tile[~few]):
            own, end = home[tile == g], start[g] + size[g]
            for a in range(0, len(own), step):
                left = own[a : a + step]
                for b in range(start[g], end, step):
                    to = np.arange(b, min(b + step, end))
                    hit = (square[left][:, None] + square[to][None, :] - 2 * x[left] @ x[to].T <= share[g]) & (left[:, None] != to[None, :])
                    near[left[hit.any(axis=1)]] = near[to[hit.any(axis=0)]] = True
        yield from part.drop_columns(["part"]).filter(pa.array(near)).to_batches()

    names = [c for c in dealt.columns if c != "part"]
    return tile_map(dealt.select(*names, "part"), close, dealt.select(*names).schema.simpleString()[7:-1].replace(":", " "))


def joined(made: DataFrame, vectors: DataFrame, threshold: float, most: int = 4096) -> DataFrame:
    """counts (id, n links) and links (id, other), told apart by kind 0 and 1; made are cells, vectors has rep and vector."""

    def close(part: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        dims = part.column("dim").to_numpy()
        new = np.zeros(part.num_rows, bool)
        new[start] = True
        for dim in np.unique(dims):
            pick = np.flatnonzero(dims == dim)
            rows = {c: part.column(c).to_numpy()[pick] for c in ("visitor", "rep", "copies", "chunk", "block", "t0", "t1")}
            each = part.column("vector").take(pa.array(pick)).combine_chunks().flatten().to_numpy().reshape(-1, dim)
            who, n, s, d = compare(rows, each, np.flatnonzero(new[pick]), threshold)
            kind = np.repeat(np.array([0, 1], np.int32), [len(who), len(s)])
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind), "a": pa.array(np.concatenate([who, s]), pa.int64()), "b": pa.array(np.concatenate([n, d]), pa.int64())})

    left = partnered(tiled(made, most), 2 - 2 * threshold)
    return tile_map(left.join(vectors.select("rep", "vector"), "rep"), close, "kind int, a long, b long")


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of table.

    Two vectors link if their labels are equal and not null and their cosine is threshold
    or more (a cosine of exactly threshold, in double precision, links). Defined results: vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do vectors of different length; rows
    without an id are left out; an id that is repeated with the same vector and label is
    one vector, with another it links as several and each row gets its own result; an empty
    table gives an empty table.
    """
    kind = table.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # copies travel in the width they came in
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(kind).alias("vector")).where(F.col("vec_id").isNotNull())
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda v: v != 0)
    fine = rows.where(F.coalesce(good, F.lit(False)))
    classes = checkpoint(fine.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")))
    made = table_of(cells(classes.withColumn("dim", F.size("vector")), 2 - 2 * threshold))
    found = checkpoint(joined(made, classes, threshold))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    of = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(counts, "rep", "left").join(of, "rep", "left").select("label", "vector", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = fine.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
