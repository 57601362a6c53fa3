"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

A leaf's place is the rank of its id in its group. Tasks make compressed bitmaps of the ids they
meet, in chunks of 2^12 ids; merged, with a directory of popcounts each, they answer a rank in
constant time, so leaves are never sorted. Places are dealt out as arrays of 2^8 slots, each
filled by slot number and reduced by eight levels in one task; their roots are the leaves of the
next arrays, until one is left. Proofs go the other way, from the root's array down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, table

#: Levels that one array of slots reduces.
BITS = 8
CHUNK = 12
#: Chunk of rows without an id: below all others.
NO_ID = -(1 << 50)
#: Ids in a chunk from which a bitmap is smaller than a list.
DENSE = 1 << (CHUNK - 4)
#: Chunks of a group that one task adds up; more are added up by 2^10 first.
MOST_CHUNKS = 1 << 16
PACKED = "g string, block long, total long, slots binary, ids binary, valid binary, leaves binary, changed binary, changed_leaves binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(columns: list[Column]) -> Column:
    """SHA-256, as hex text, of columns one after the other: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]), 256)


# --- bitmaps


def _bits(lows: np.ndarray) -> np.ndarray:
    words = np.zeros(1 << (CHUNK - 6), np.uint64)
    np.bitwise_or.at(words, lows >> 6, np.uint64(1) << (lows.astype(np.uint64) & np.uint64(63)))
    return words


def compressed(lows: np.ndarray) -> bytes:
    """Distinct ascending ids of a chunk: a list of 16-bit numbers, or a bitmap where that is smaller."""
    return lows.astype("<u2").tobytes() if len(lows) < DENSE else _bits(lows).astype("<u8").tobytes()


def bitmap(data: bytes) -> np.ndarray:
    """The words of a compressed bitmap."""
    return np.frombuffer(data, "<u8").copy() if len(data) == 1 << (CHUNK - 3) else _bits(np.frombuffer(data, "<u2").astype(np.int64))


def directory(words: np.ndarray) -> np.ndarray:
    """The ids below each word."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]


class Ranks:
    """Places of a chunk's ids: its bitmap and directory, and the further rows of repeated ids."""

    def __init__(self, bits: bytes, counts: bytes, repeated: bytes, extra: bytes):
        self.words, self.below = bitmap(bits), np.frombuffer(counts, "<u2").astype(np.int64)
        self.repeated = np.frombuffer(repeated, "<u2").astype(np.int64)
        self.extra = np.concatenate([[0], np.cumsum(np.frombuffer(extra, "<i8"))])

    def of(self, lows: np.ndarray) -> np.ndarray:
        under = (np.uint64(1) << (lows.astype(np.uint64) & np.uint64(63))) - np.uint64(1)
        return self.below[lows >> 6] + np.bitwise_count(self.words[lows >> 6] & under) + self.extra[np.searchsorted(self.repeated, lows)]


def bitmaps(leaves: DataFrame) -> DataFrame:
    """g, chunk, n (rows), repeats (repeated ids), bits, counts, repeated, extra of each chunk of each group's ids."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = {}, 0

        def out() -> pa.RecordBatch:
            made = []
            for (g, chunk), parts in held.items():
                lows, n = np.unique(np.concatenate(parts), return_counts=True)
                made.append((g, chunk, compressed(lows), lows[n > 1].astype("<u2").tobytes(), (n[n > 1] - 1).astype("<i8").tobytes()))
            held.clear()
            g, chunk, bits, repeated, extra = zip(*made, strict=True) if made else [[]] * 5
            return pa.RecordBatch.from_pydict({"g": pa.array(g, pa.string()), "chunk": pa.array(chunk, pa.int64()), "bits": pa.array(bits, pa.binary()), "repeated": pa.array(repeated, pa.binary()), "extra": pa.array(extra, pa.binary())})

        for batch in batches:
            group = batch.column("g").dictionary_encode()
            code, chunk, low = group.indices.to_numpy().astype(np.int64), batch.column("chunk").to_numpy(), batch.column("low").to_numpy()
            order = np.lexsort((chunk, code))  # brings a chunk's rows of this batch together
            cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(chunk[order]) != 0)) + 1
            for rows_of in np.split(order, cuts) if len(order) else ():
                held.setdefault((group.dictionary[code[rows_of[0]]].as_py(), int(chunk[rows_of[0]])), []).append(low[rows_of])
            rows += len(low)
            if rows > 1 << 17:
                rows = 0
                yield out()
        yield out()

    def merge(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, extra = np.zeros(1 << (CHUNK - 6), np.uint64), np.zeros(1 << CHUNK, np.int64)
        for batch in batches:
            for bits, repeated, more in zip(*(batch.column(n).to_pylist() for n in ("bits", "repeated", "extra")), strict=True):
                new = bitmap(bits)
                both = np.flatnonzero(words & new)
                if len(both):  # an id that earlier parts hold too
                    again = np.flatnonzero(np.unpackbits((words[both] & new[both]).astype("<u8").view(np.uint8), bitorder="little"))
                    extra[(both[again >> 6] << 6) + (again & 63)] += 1
                words |= new
                extra[np.frombuffer(repeated, "<u2")] += np.frombuffer(more, "<i8")
        lows = np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))
        twice = np.flatnonzero(extra)
        cells = (key[0].as_py(), key[1].as_py(), len(lows) + int(extra.sum()), len(twice), compressed(lows), directory(words).astype("<u2").tobytes(), twice.astype("<u2").tobytes(), extra[twice].astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({n: pa.array([v], t) for (n, t), v in zip(CHUNKS, cells, strict=True)})

    CHUNKS = [("g", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("repeats", pa.int64()), ("bits", pa.binary()), ("counts", pa.binary()), ("repeated", pa.binary()), ("extra", pa.binary())]
    parts = arrow_map(leaves.select("g", "chunk", "low"), partial, "g string, chunk long, bits binary, repeated binary, extra binary")
    # batches of a chunk come one after the other, so that a task holds one of them
    merge.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return table(parts.groupBy("g", "chunk").applyInArrow(merge, "g string, chunk long, n long, repeats long, bits binary, counts binary, repeated binary, extra binary"))


def sums_before(counts: DataFrame, level: int = 0) -> DataFrame:
    """g, chunk, before: the sum of n over smaller chunks of the group; a scan by 2^10 chunks at a time where there are many."""
    so_far = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if level == 6 or counts.count() <= MOST_CHUNKS:
        return counts.select("g", "chunk", so_far("g").alias("before"))
    up = counts.select("g", "chunk", "n", F.shiftright("chunk", 10).alias("up"))
    above = sums_before(table(up.groupBy("g", F.col("up").alias("chunk")).agg(F.sum("n").alias("n"))), level + 1)
    return up.select("g", "chunk", "up", so_far("g", "up").alias("inside")).join(above.select("g", F.col("chunk").alias("up"), "before"), ["g", "up"]).select("g", "chunk", (F.col("before") + F.col("inside")).alias("before"))


# --- arrays of slots


def packed(g: str, total: int, place: np.ndarray, ids: pa.Array, leaves: pa.Array, other: pa.Array) -> list[tuple]:
    """Rows of PACKED: some slots of some arrays of a group, from the places of its leaves."""
    leaf = np.frombuffer(b"".join(leaves.to_pylist()), np.uint8).reshape(-1, 32)
    valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    changed, others = other.is_valid().to_numpy(zero_copy_only=False), other.to_pylist()
    order, out = np.argsort(place >> BITS, kind="stable"), []
    cuts = np.flatnonzero(np.diff(place[order] >> BITS)) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        slots, with_other = (place[rows] & ((1 << BITS) - 1)).astype("<u2"), changed[rows]
        out.append((g, int(place[rows[0]] >> BITS), total, slots.tobytes(), ids[rows].astype("<i8").tobytes(), valid[rows].astype(np.uint8).tobytes(), leaf[rows].tobytes(), slots[with_other].tobytes(), b"".join(others[i] for i in rows[with_other])))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    names = [x.split()[0] for x in PACKED.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def placed(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parts of arrays (PACKED) of all leaves; chunks has before and total too."""

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch([])])
        chunk = right.slice(0, 1).to_pylist()[0]
        place = chunk["before"] + Ranks(chunk["bits"], chunk["counts"], chunk["repeated"], chunk["extra"]).of(left.column("low").to_numpy())
        columns = [left.column(n).combine_chunks() for n in ("id", "leaf", "other")]
        return pa.Table.from_batches([_batch(packed(chunk["g"], chunk["total"], place, *columns))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of the first row of each repeated id."""
        for batch in batches:
            for c in batch.to_pylist():
                lows = np.frombuffer(c["repeated"], "<u2").astype(np.int64)
                first = c["before"] + Ranks(c["bits"], c["counts"], c["repeated"], c["extra"]).of(lows)
                yield pa.RecordBatch.from_pydict({"g": pa.array([c["g"]] * len(lows), pa.string()), "chunk": pa.array(np.full(len(lows), c["chunk"])), "low": pa.array(lows), "first": pa.array(first), "total": pa.array(np.full(len(lows), c["total"]))})

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("g").dictionary_encode()
            for k, g in enumerate(group.dictionary.to_pylist()):
                own = batch.filter(pa.array(group.indices.to_numpy() == k))
                yield _batch(packed(g, own.column("total")[0].as_py(), own.column("place").to_numpy(), own.column("id"), own.column("leaf"), own.column("other")))

    once = leaves
    extra = None
    if not chunks.where("repeats > 0").isEmpty():
        # rows of a repeated id stand by leaf; they are numbered by ranges, as an id may have any number of them
        from ..operators.graph import numbered

        ids = table(arrow_map(chunks.where("repeats > 0"), spread, "g string, chunk long, low long, first long, total long"))
        keys = ["g", "chunk", "low"]
        once = leaves.join(ids.select(*keys), keys, "left_anti")
        many = table(numbered(leaves.join(ids.select(*keys), keys, "left_semi"), [*keys, "leaf", "other"], "nth"))
        start = many.groupBy(*keys).agg(F.min("nth").alias("start"))
        with_place = many.join(start, keys).join(ids, keys).withColumn("place", F.col("first") + F.col("nth") - F.col("start"))
        extra = arrow_map(with_place.select("g", "total", "place", "id", "leaf", "other"), single, PACKED)
    out = once.groupBy("g", "chunk").cogroup(chunks.groupBy("g", "chunk")).applyInArrow(rank, PACKED)
    return out if extra is None else out.unionByName(extra)


def levels(nodes: bytes, count: int, height: int) -> list[bytes]:
    """Hex text of an array's nodes, level by level: each pair, or a last lone node, is hashed to its parent."""
    out = [nodes]
    for _ in range(height):
        out.append(b"".join(hashlib.sha256(out[-1][128 * i : 128 * i + 128]).hexdigest().encode() for i in range((count + 1) // 2)))
        count = (count + 1) // 2
    return out


def height(total: int) -> int:
    """Levels that an array reduces in a tree of that many leaves."""
    return min(BITS, (total - 1).bit_length())


def filled(parts: DataFrame) -> DataFrame:
    """Whole arrays (PACKED and root) from their parts, each slot set by its number."""

    def fill(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, block = (k.as_py() for k in key)
        ids, valid, leaves = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.uint8), np.zeros((1 << BITS, 32), np.uint8)
        seen, changed, others, total = np.zeros(1 << BITS, np.int64), [], [], 0
        for batch in batches:
            for p in batch.to_pylist():
                slots, total = np.frombuffer(p["slots"], "<u2"), p["total"]
                ids[slots], valid[slots] = np.frombuffer(p["ids"], "<i8"), np.frombuffer(p["valid"], np.uint8)
                leaves[slots] = np.frombuffer(p["leaves"], np.uint8).reshape(-1, 32)
                np.add.at(seen, slots, 1)
                changed.append(p["changed"]), others.append(p["changed_leaves"])
        n = min(1 << BITS, total - (block << BITS))
        if not (seen[:n] == 1).all() or seen[n:].any():
            raise RuntimeError(f"array {block} of {g!r} is not filled once: the input changed between reads")
        root = levels(leaves[:n].tobytes().hex().encode(), n, height(total))[-1]
        row = (g, block, total, n.to_bytes(2, "little"), ids[:n].astype("<i8").tobytes(), valid[:n].tobytes(), leaves[:n].tobytes(), b"".join(changed), b"".join(others))
        yield _batch([row]).append_column("root", pa.array([bytes.fromhex(root.decode())], pa.binary()))

    fill.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return table(parts.groupBy("g", "block").applyInArrow(fill, f"{PACKED}, root binary"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Tables of arrays from nodes (g, at, total, node) up to one array for each group."""

    def stack(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        block, total, n = first["at"] >> BITS, first["total"], rows.num_rows
        content: list = [None] * n
        for at, node in zip(rows.column("at").to_pylist(), rows.column("node").to_pylist(), strict=True):
            content[at & ((1 << BITS) - 1)] = node
        whole = b"".join(content)
        root = bytes.fromhex(levels(whole.hex().encode(), n, height(total))[-1].decode())
        return pa.table({"g": pa.array([first["g"]], pa.string()), "block": pa.array([block], pa.int64()), "total": pa.array([total], pa.int64()), "leaves": pa.array([whole], pa.binary()), "root": pa.array([root], pa.binary())})

    out = []
    while True:
        level = nodes.withColumn("block", F.shiftright("at", BITS)).groupBy("g", "block").applyInArrow(lambda t: stack(t), "g string, block long, total long, leaves binary, root binary")
        out.append(table(level))
        nodes = above(out[-1])
        if nodes.where("total > 1").isEmpty():
            return out


def above(arrays: DataFrame) -> DataFrame:
    return arrays.select("g", F.col("block").alias("at"), F.expr(f"(total + {(1 << BITS) - 1}) div {1 << BITS}").alias("total"), F.col("root").alias("node"))


# --- proofs: a byte (0 no sibling, 1 it is to the right, 2 to the left) and 32 bytes a level


def steps(tree: list[bytes], i: int) -> bytes:
    out = []
    for level in tree[:-1]:
        s = i ^ 1
        there = level[64 * s : 64 * s + 64]
        out.append(bytes([1 + (i & 1) if there else 0]) + (bytes.fromhex(there.decode()) if there else bytes(32)))
        i >>= 1
    return b"".join(out)


def proof(path: bytes) -> bytes:
    """Hex text of the siblings of a path, in its order."""
    return b"".join(path[k + 1 : k + 33].hex().encode() for k in range(0, len(path), 33) if path[k])


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a leaf (hex text) and its path lead to."""
    for k in range(0, len(path), 33):
        sibling = path[k + 1 : k + 33].hex().encode() if path[k] else b""
        node = hashlib.sha256(sibling + node if path[k] == 2 else node + sibling).hexdigest().encode()
    return node


def descended(arrays: DataFrame, paths: DataFrame) -> DataFrame:
    """g, at, subroot, path of the nodes of arrays, from the paths (g, at, subroot, path) of the arrays' roots."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["leaves"]) // 32
                tree = levels(r["leaves"].hex().encode(), n, height(r["total"]))
                yield pa.RecordBatch.from_pydict({"g": pa.array([r["g"]] * n, pa.string()), "at": pa.array(np.arange(n) + (r["block"] << BITS)), "subroot": pa.array([r["subroot"]] * n, pa.binary()), "path": pa.array([steps(tree, i) + r["path"] for i in range(n)], pa.binary())})

    both = arrays.join(paths.withColumnRenamed("at", "block"), ["g", "block"]).select("g", "block", "total", "leaves", "subroot", "path")
    return table(arrow_map(both, down, "g string, at long, subroot binary, path binary"))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Leaves ascend by key in their group; two consecutive nodes, or a last lone one, become
    their hash until one is left. The groups' roots, by group, become the root the same way. A
    proof is the hash of a leaf's siblings from its level to the root. ``folded_root`` is computed
    from the leaf's siblings and the leaf itself, or, where ``tampered`` holds, the leaf
    of the row with ``changes`` made to it; ``verified`` tells whether it is the root.

    Defined results: null fields are ``-``; rows without a key come first in their group and are not
    tampered with unless ``tampered`` says so; rows of equal key stand by leaf, and by the changed
    leaf after that; a null group is one of its own, the first; a lone leaf is its group's root, and a lone
    group's root the root; an empty table gives an empty table. The key has to be an integer. Only
    key, group and fields are looked at. If the rows differ when read again, the job fails.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    other = F.when(tampered, F.unhex(joined_hash([(changes or {}).get(f, F.col(f)) for f in fields])))
    identity = F.col(key).cast("long")
    rows = docs.select(
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("g"),
        identity.alias("id"),
        F.coalesce(F.shiftright(identity, CHUNK), F.lit(NO_ID)).alias("chunk"),
        F.coalesce(identity.bitwiseAND(F.lit((1 << CHUNK) - 1)), F.lit(0)).alias("low"),
        F.unhex(joined_hash([F.col(f) for f in fields])).alias("leaf"),
        other.alias("other"),
    )
    rows = table(rows)
    chunks = bitmaps(rows)
    counts = chunks.select("g", "chunk", "n")
    chunks = table(chunks.join(sums_before(counts), ["g", "chunk"]).join(counts.groupBy("g").agg(F.sum("n").alias("total")), "g"))
    arrays = filled(placed(rows, chunks))
    upper = climbed(above(arrays))
    from ..operators.graph import numbered

    # one array a group is left; groups are the leaves of the last tree, by their names
    subroots = table(numbered(upper[-1].select("g", F.col("root").alias("subroot")), ["g"], "at"))
    count = subroots.count()
    over = climbed(subroots.select(F.lit("").alias("g"), "at", F.lit(count).cast("long").alias("total"), F.col("subroot").alias("node")))
    top = over[-1].first()
    root = bytes(top["root"]) if top else b""
    paths = over[-1].select("g", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("subroot"), F.lit(b"").alias("path"))
    for level in reversed(over):
        paths = descended(level, paths)
    paths = subroots.join(paths.select("at", "path"), "at").select("g", F.lit(0).cast("long").alias("at"), "subroot", "path")
    for level in reversed(upper):
        paths = descended(level, paths)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = int.from_bytes(r["slots"], "little")
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.frombuffer(r["valid"], np.uint8) == 0)
                tree = levels(r["leaves"].hex().encode(), n, height(r["total"]))
                changed = {int(s): r["changed_leaves"][32 * k : 32 * k + 32] for k, s in enumerate(np.frombuffer(r["changed"], "<u2"))}
                out = {k: [] for k in names}
                for i in range(n):
                    leaf, path = r["leaves"][32 * i : 32 * i + 32], steps(tree, i) + r["path"]
                    cells = (leaf.hex(), r["subroot"].hex(), root.hex(), hashlib.sha256(proof(path)).hexdigest(), folded(changed.get(i, leaf).hex().encode(), path).decode())
                    for k, v in zip(names, cells, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict({"id": ids} | {k: pa.array(v, pa.string()) for k, v in out.items()})

    both = arrays.drop("root").join(paths.withColumnRenamed("at", "block"), ["g", "block"])
    found = arrow_map(both, proofs, "id long, " + ", ".join(f"{n} string" for n in names))
    return found.select(F.col("id").alias(key), *names, (F.col("folded_root") == F.col("root")).alias("verified"))


def op11(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang, one in seven tampered with; nulls, ties and repeats as in ``manifest``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return manifest(docs, tampered=tampered, changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
