"""SimHash near-de-duplication by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``radius`` bits of each other meet in a variant: a value
that is within half the radius of both. So every fingerprint emits all variants in that
ball, equal variants are brought together, and colliding fingerprints are verified.

For radius 3 half is 1.5. Balls of radius 1 meet up to distance 2 only, and balls of
radius 2 have 2,081 variants. Instead the bits are parted in three, and each third is left
out once: a pair at distance 3 has a differing bit in some third, and without it differs in
at most 2 bits, so balls of radius 1 over the remaining bits meet. That is 131 variants of
42 or 43 bits for each distinct fingerprint, and no pair is lost.

Similar sets of shingles are found by the same balls (``similar_classes``): the fingerprint is
longer, and cut in parts of 32 bits. Sets of Jaccard similarity 0.8 differ in 15 % of the bits, so in two
bits or fewer of some part with probability 0.95 for 24 parts (0.99 at similarity 0.83); balls of
radius 1 over each part meet then, and the whole sets of those that meet are compared exactly.

Only distinct fingerprints emit, so exact copies cost nothing. Pairs are not emitted
either: the members of a variant are verified in blocks, and the links that leave are a
spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, Block, Words, blocks, mix, ranges
from .components import components, forest
from .shared import arrow_map, documents, partitions, table
from .shingles import sets, sets_of, verified

SEED = 42
#: For each byte a word with one of its bits in each byte.
LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << np.arange(0, 64, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
#: Parts of the fingerprints of similar sets, and groups up to this size compare all pairs at once.
PARTS, SMALL, TILE = 24, 4, 1024
#: Shingles of the members of larger groups, all groups together, that one task looks at.
MEMBERS = 10_000_000


def fingerprints(block: Block, shingle: int = 3) -> np.ndarray:
    """The unsigned 64-bit SimHash of each document: bit set if set in over half the shingles' hashes; no words: 0."""
    words = Words(LOWER[block.data], block.offsets)
    counts = words.counts()
    # all words of the block, joined by single spaces
    length = words.end - words.start + 1
    joined = np.append(words.data, np.uint8(32))[np.minimum(ranges(words.start, length), len(words.data))]
    end = np.cumsum(length)
    joined[end - 1] = 32
    start, end = end - length, end - 1
    of_doc = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    first = np.repeat(words.first[:-1], of_doc) + ranges(np.zeros(len(counts), np.int64), of_doc)
    last = np.minimum(first + shingle, np.repeat(words.first[1:], of_doc)) - 1
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    return majority(hashes, np.concatenate([[0], np.cumsum(of_doc)]))


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each stretch of hashes a word whose bits are set if set in over half of them; of none: 0."""
    size = np.diff(bounds)
    out, some = np.zeros(len(size), np.uint64), size > 0
    if not some.any():
        return out
    n, first = size[some], bounds[:-1][some]
    lots = -(-n // 255)  # so many hashes at once, that counts in a byte each don't overflow
    cut = np.repeat(first, lots) + 255 * ranges(np.zeros(len(n), np.int64), lots)
    heads = np.cumsum(lots) - lots
    for byte in range(8):
        counts = np.add.reduceat(LANES[(hashes >> np.uint64(8 * byte)).astype(np.uint8)], cut)
        total = np.add.reduceat(counts.view(np.uint8).reshape(-1, 8), heads, axis=0, dtype=np.int64)
        out[some] |= np.packbits(2 * total > n[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids), "print": pa.array(fingerprints(block, shingle).view(np.int64))})

    return arrow_map(docs, scan, "doc_id long, print long")


def thirds(radius: int) -> list[np.ndarray]:
    """The bits left out, set by set, so that balls of half the radius meet."""
    if radius % 2 == 0:
        return [np.zeros(0, np.int64)]
    return np.array_split(np.arange(64), 3)


def ball(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set left out, variant, and fingerprint, for every variant within half the radius."""
    sets, variants, sources = [], [], []
    for s, out in enumerate(thirds(radius)):
        bits = [np.uint64(1 << int(b)) for b in range(64) if b not in set(out.tolist())]
        base = prints & np.bitwise_or.reduce(np.array(bits, np.uint64))
        flips = [np.uint64(0)]
        reach = flips
        for _ in range(radius // 2):
            reach = sorted({int(x) ^ int(b) for x in reach for b in bits} | set(map(int, reach)))
        flips = np.array([int(x) for x in reach], np.uint64)
        variants.append((base[:, None] ^ flips[None, :]).ravel())
        sources.append(np.repeat(prints, len(flips)))
        sets.append(np.full(len(variants[-1]), s, np.int32))
    return np.concatenate(sets), np.concatenate(variants), np.concatenate(sources)


def links(prints: DataFrame, radius: int = 3, tile: int = 1024) -> DataFrame:
    """src, dst: enough links within radius bits to connect what all such links connect.

    prints has one column, print, of distinct fingerprints. Within a task, rows are sorted by
    variant; the members of one variant are compared tile by tile, so memory stays bounded
    however many there are.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.column(0).slice(at, 1000).to_numpy().view(np.uint64)
                sets, variants, sources = ball(part, radius)
                yield pa.RecordBatch.from_pydict({"omitted": pa.array(sets), "variant": pa.array(variants.view(np.int64)), "print": pa.array(sources.view(np.int64))})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the variant that may go on in the next batch

        def close(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(rows)))
            value = rows[:, 2].view(np.uint64)
            src, dst = [], []
            small = (size > 1) & (size <= 64)  # pairs of all small groups at once
            for n in np.unique(size[small]):
                i, j = np.triu_indices(n, 1)
                first = start[size == n]
                for lot in np.array_split(first, max(1, len(first) * len(i) >> 21)):
                    a, b = (value[(lot[:, None] + x[None, :]).ravel()] for x in (i, j))
                    near = np.bitwise_count(a ^ b) <= radius
                    src.append(a[near]), dst.append(b[near])
            for first, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
                own = value[first : first + n]
                for p in range(0, n, tile):
                    for q in range(p, n, tile):
                        i, j = np.nonzero(np.bitwise_count(own[p : p + tile, None] ^ own[None, q : q + tile]) <= radius)
                        a, b = forest(own[p + i].view(np.int64), own[q + j].view(np.int64))
                        src.append(a.view(np.uint64)), dst.append(b.view(np.uint64))
            a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (src, dst))
            a, b = forest(a, b)
            return pa.RecordBatch.from_pydict({"src": pa.array(a), "dst": pa.array(b)})

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            if len(cut):
                yield close(rows[: cut[-1] + 1])
                rows = rows[cut[-1] + 1 :]
            held = [rows]
        if held and len(held[0]):
            yield close(held[0])

    made = arrow_map(prints, emit, "omitted int, variant long, print long")
    return arrow_map(made.repartition("omitted", "variant").sortWithinPartitions("omitted", "variant"), verify, "src long, dst long")


def simhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Documents link if their fingerprints differ in radius bits or fewer. Defined results: a
    null, empty or wordless text has fingerprint zero and links like any other; fewer words
    than a shingle make one shingle; rows without an id are left out; an empty table gives
    an empty table.
    """
    made = table(fingerprint(documents(docs, key, text), shingle))
    smallest = made.groupBy("print").agg(F.min("doc_id").alias("doc"))
    spread = smallest.select("print").repartition(max(partitions(docs.sparkSession), 1))
    found = components(links(spread, radius))
    # a component's smallest document: components are of fingerprints, whose order is another
    rooted = smallest.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    low = rooted.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_print = rooted.join(low, "component").select("print", "component_id")
    return made.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def signatures(value: np.ndarray, size: np.ndarray, parts: int) -> np.ndarray:
    """The fingerprint of each set, in parts of 32 bits; value holds the sets' members one set after the other."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    words = [majority(mix(value + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))), bounds) for i in range(1, parts // 2 + 1)]
    return np.stack(words, axis=1).view(np.uint32) if len(size) else np.zeros((0, parts), np.uint32)


def signed(docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """doc_id, node (the name of its set), n (the set's size), prints (the fingerprint's parts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "doc_id", "text"):
            value, _, size, name = sets(block, shingle)
            prints = signatures(value, size, parts).view(np.int32).ravel()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids), "node": pa.array(name.view(np.int64)), "n": pa.array(size.astype(np.int32)), "prints": pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * parts), pa.array(prints))})

    return arrow_map(docs, scan, "doc_id long, node long, n int, prints array<int>")


def by_key(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row for each key of two rows or more: key and arrays of the columns names (long), in order of the first one."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the key that may go on in the next batch

        def close(rows: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            size = np.diff(np.append(start, len(rows)))
            rows, size, start = rows[np.repeat(size > 1, size)], size[size > 1], start[size > 1]
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            first = rows[np.cumsum(size) - size, 0]
            return pa.RecordBatch.from_pydict({"key": pa.array(first)} | {c: pa.ListArray.from_arrays(offsets, pa.array(rows[:, i + 1])) for i, c in enumerate(names)})

        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            rows = rows if held is None else np.concatenate([held, rows])
            cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
            if len(cut):
                yield close(rows[: cut[-1] + 1])
                rows = rows[cut[-1] + 1 :]
            held = rows
        if held is not None:
            yield close(held)

    sorted_ = rows.select("key", *names).repartition("key").sortWithinPartitions("key", names[0])
    return arrow_map(sorted_, gather, "key long, " + ", ".join(f"{c} array<long>" for c in names))


def met(nodes: DataFrame, parts: int) -> DataFrame:
    """key, node, n: the sets whose balls meet in a variant (key) of a part."""
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints = part.column("prints").flatten().to_numpy().view(np.uint32).reshape(-1, parts)
                key = (np.arange(parts, dtype=np.int64) << 32)[None, :, None] | (prints[:, :, None] ^ flips).astype(np.int64)
                each = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), parts * len(flips)))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.ravel()), "node": each("node"), "n": each("n")})

    return by_key(arrow_map(nodes.select("node", "n", "prints"), emit, "key long, node long, n int"), ["node", "n"])


def small_pairs(grouped: DataFrame, least: Fraction) -> DataFrame:
    """src, dst: all pairs of groups of up to SMALL members that may be similar by their sizes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("node").value_lengths().to_numpy()
            node, n = (batch.column(c).flatten().to_numpy() for c in ("node", "n"))
            start = np.cumsum(size) - size
            for k in np.unique(size[size > 1]).tolist():
                i, j = np.triu_indices(k, 1)
                lot = start[size == k]
                a, b = (lot[:, None] + i).ravel(), (lot[:, None] + j).ravel()
                fine = sized(n[a], n[b], least)
                yield links_of(node[a[fine]], node[b[fine]])

    # copies of two fingerprints meet in all variants of a ball: equal groups are one before their pairs are made
    return arrow_map(grouped.where(F.size("node") <= SMALL).groupBy("node").agg(F.first("n").alias("n")), scan, "src long, dst long")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (src, dst) that found (node, component) doesn't have in one component."""
    side = lambda name, column: found.select(F.col("node").alias(name), F.col("component").alias(column))
    both = pairs.join(side("src", "_a"), "src", "left").join(side("dst", "_b"), "dst", "left")
    return both.where(F.coalesce("_a", "src") != F.coalesce("_b", "dst")).select("src", "dst")


def alike_sets(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether two sorted sets have the similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * (least.numerator + least.denominator) >= (len(a) + len(b)) * least.numerator


def star_links(groups: DataFrame, members: DataFrame, least: Fraction, parts: int, deviations: float | None) -> DataFrame:
    """src, dst: a spanning forest, for each block, of the links of each larger group's first member.

    groups has block, node, n (arrays), members has block, node, prints, shingles. A block and its members meet in one
    task, where sizes and whole fingerprints are looked at before the sets are compared.
    """
    most = most_bits(float(least), 32 * parts, deviations)

    def meet(groups: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("node").combine_chunks()
        names, prints = members.column("node").to_numpy(), members.column("prints").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(-1, parts)
        column = members.column("shingles").combine_chunks()
        start, value = column.offsets.to_numpy(), column.values.to_numpy()
        pairs = [np.zeros((0, 2), np.int64)]
        for lot in groups.to_batches(max_chunksize=64):
            size = lot.column("node").value_lengths().to_numpy()
            node, n = (lot.column(c).flatten().to_numpy() for c in ("node", "n"))
            first = np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero((first != np.arange(len(node))) & sized(n[first], n, least))
            pairs.append(np.unique(np.searchsorted(names, np.stack([node[first[at]], node[at]], axis=1)), axis=0))
        src, dst = [], []
        for lot in np.array_split(np.unique(np.concatenate(pairs), axis=0), sum(map(len, pairs)) // 20_000 + 1):
            near = np.bitwise_count(prints[lot[:, 0]] ^ prints[lot[:, 1]]).sum(axis=1) <= most
            for i, j in lot[near].tolist():
                if alike_sets(value[start[i] : start[i + 1]], value[start[j] : start[j + 1]], least):
                    src.append(i), dst.append(j)
        s, d = forest(np.array(src, np.int64), np.array(dst, np.int64))
        return pa.table({"src": pa.array(names[s]), "dst": pa.array(names[d])})

    sides = (df.groupBy("block") for df in (groups.select("block", "node", "n"), members.select("block", "node", "prints", "shingles")))
    return next(sides).cogroup(next(sides)).applyInArrow(meet, "src long, dst long")


def sized(a: np.ndarray, b: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return least.denominator * np.minimum(a, b) >= least.numerator * np.maximum(a, b)


def links_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_pydict({"src": pa.array(both[:, 0]), "dst": pa.array(both[:, 1])})


def most_bits(least: float, bits: int, deviations: float | None) -> float:
    """Bits in which fingerprints of sets of similarity least differ, a number of deviations above the mean; without one, all bits."""
    share = float(np.arccos(2 * least / (1 + least)) / np.pi)
    return bits if deviations is None else bits * share + deviations * np.sqrt(bits * share * (1 - share))


def plausible(rows: pa.Table, least: Fraction, parts: int, deviations: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components in a group whose sizes and whole fingerprints allow the similarity.

    A pair comes up in one group only: of the first part where it meets, counted from one that depends on the pair, so that parts
    have equal shares, that which stands for the smallest variant there.
    """
    most = most_bits(float(least), 32 * parts, deviations)
    key, node, n, own = (rows.column(c).to_numpy() for c in ("key", "node", "n", "component"))
    prints = rows.column("prints").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(-1, parts)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.append(start[1:], len(key))
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        keys = np.array(rows.column("keys")[s].as_py(), np.int64)
        for p in range(s, e, TILE):
            for q in range(p, e, TILE):
                a, b = slice(p, min(p + TILE, e)), slice(q, min(q + TILE, e))
                i, j = np.nonzero((own[a, None] != own[None, b]) & (node[a, None] < node[None, b] if p == q else np.True_) & sized(n[a, None], n[None, b], least))
                for lot in np.array_split(np.arange(len(i)), len(i) // 20_000 + 1):
                    x, y = i[lot] + p, j[lot] + q
                    bits = np.bitwise_count(prints[x] ^ prints[y])
                    near = np.flatnonzero(bits.sum(axis=1) <= most)
                    x, y, bits = x[near], y[near], bits[near]
                    turn = ((node[x] ^ node[y]).view(np.uint64) % np.uint64(parts)).astype(np.int64)[:, None] + np.arange(parts)
                    first = (np.take_along_axis(bits, turn % parts, 1) <= 2).argmax(axis=1)
                    first = turn[np.arange(len(x)), first] % parts
                    here = bits[np.arange(len(x)), first]
                    u, v = prints[x, first], prints[y, first]
                    other = u ^ v
                    low = other & (~other + np.uint32(1))  # the lowest differing bit
                    variant = np.where(here == 0, u, np.where(here == 1, np.minimum(u, v), np.minimum(u ^ low, v ^ low)))
                    here = np.isin(first.astype(np.int64) << 32 | variant.astype(np.int64), keys)
                    if here.any():
                        yield x[here], y[here]


def homes(alike: DataFrame) -> DataFrame:
    """node, home: one label, mostly, for the members of groups that share members; only where groups are looked at depends on it.

    The members that a batch's groups connect get their smallest node; of several batches' labels the smallest counts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0).flatten().to_numpy(), batch.column(0).value_lengths().to_numpy()
            src, dst = forest(node[np.repeat(np.cumsum(size) - size, size)], node)
            yield pa.RecordBatch.from_pydict({"node": pa.array(src, pa.int64()), "home": pa.array(dst, pa.int64())})

    # by part, so that few batches meet all members of a cluster
    dealt = alike.select("node", "key", "part").repartition("part", F.pmod(F.xxhash64("key"), F.lit(2))).select("node")
    return arrow_map(dealt, scan, "node long, home long").groupBy("node").agg(F.min("home").alias("home"))


def in_blocks(alike: DataFrame, most: int = MEMBERS) -> DataFrame:
    """alike with a column block: groups are dealt out so that a block's members have about so many shingles, all groups together.

    The groups of a cluster lie in one block, those of a large cluster in one for each part, and only what is more than a block
    there is dealt out by group. So members are asked for in few blocks, however many groups they are in.
    """
    first = alike.withColumn("_first", F.element_at("node", 1)).join(homes(alike).withColumnRenamed("node", "_first"), "_first", "left")
    first = table(first.withColumn("home", F.coalesce("home", "_first")).withColumn("_size", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).drop("_first"))
    sizes = table(first.groupBy("home", "part").agg(F.sum("_size").alias("_here")))
    whole = sizes.groupBy("home").agg(F.sum("_here").alias("_all"))
    total = whole.agg(F.sum("_all")).first()[0] or 0
    lots = max(total // most + 1, partitions(alike.sparkSession))
    large = sizes.join(whole.where(F.col("_all") > most // 100), "home").select("home", "part", F.expr(f"_here div {most} + 1").alias("_pieces"))
    place = F.when(F.col("_pieces").isNull(), F.xxhash64("home")).otherwise(F.xxhash64("home", "part", F.pmod(F.xxhash64("key"), "_pieces")))
    return first.join(large, ["home", "part"], "left").withColumn("block", F.pmod(place, F.lit(lots)).cast("int")).select("part", "node", "key", "keys", "n", "block")


def asked(groups: DataFrame) -> DataFrame:
    """block, node: each member of a block's groups, once for each task that holds some of them, however many groups it is in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.repeat(batch.column("block").to_numpy(), batch.column("node").value_lengths().to_numpy())
            both = np.unique(np.stack([block.astype(np.int64), batch.column("node").flatten().to_numpy()], axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"block": pa.array(both[:, 0].astype(np.int32)), "node": pa.array(both[:, 1])})

    return arrow_map(groups.select("block", "node").repartition("block"), scan, "block int, node long").distinct()


def across(groups: pa.Table, answers: pa.Table, least: Fraction, parts: int, deviations: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in answers of the pairs that ``plausible`` gives, some groups at a time.

    groups has key, keys, node, n (arrays, in order of node), answers has node (in order), component, prints. Members
    that answers lacks are left out.
    """
    names, of = answers.column("node").to_numpy(), answers.column("component").to_numpy()
    for lot in groups.to_batches(max_chunksize=64) if len(names) else []:
        node, size = lot.column("node").flatten().to_numpy(), lot.column("node").value_lengths().to_numpy()
        at = np.minimum(np.searchsorted(names, node), len(names) - 1)
        there, group = names[at] == node, np.repeat(np.arange(len(size)), size)
        low, high = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), np.iinfo(np.int64).min)
        np.minimum.at(low, group[there], of[at[there]]), np.maximum.at(high, group[there], of[at[there]])
        left = np.flatnonzero(there & (low < high)[group])
        if not len(left):
            continue
        left = left[np.argsort(lot.column("key").to_numpy()[group[left]], kind="stable")]
        at, group = at[left], pa.array(group[left])
        rows = pa.table({c: lot.column(c).take(group) for c in ("key", "keys")} | {c: lot.column(c).flatten().take(pa.array(left)) for c in ("node", "n")} | {c: answers.column(c).take(pa.array(at)) for c in ("component", "prints")})
        for x, y in plausible(rows, least, parts, deviations):
            yield at[x], at[y]


def links_across(groups: DataFrame, members: DataFrame, found: DataFrame, sets: DataFrame, least: Fraction, parts: int, deviations: float | None) -> DataFrame:
    """src, dst: enough links between different components to connect, block by block, what all such links of its groups connect.

    groups has block, key, keys (the variants that a group stands for), node, n (arrays), members has block, node, prints;
    found has the components so far, sets the members' shingles. A block and its members meet in one task, where groups of several
    components are compared tile by tile, first by fingerprints; members with a plausible partner fetch their whole sets once a block
    and are compared exactly there. Neither pairs nor members of single groups leave a task.
    """

    def look(groups: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("node").combine_chunks()
        some = np.zeros(answers.num_rows, bool)
        for x, y in across(groups, answers, least, parts, deviations):
            some[x] = some[y] = True
        return answers.filter(pa.array(some))

    def compare(groups: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("node").combine_chunks()
        names, column = answers.column("node").to_numpy(), answers.column("shingles").combine_chunks()
        start, value = column.offsets.to_numpy(), column.values.to_numpy()
        own, of = np.unique(answers.column("component").to_numpy(), return_inverse=True)
        root, src, dst = list(range(len(own))), [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for x, y in across(groups, answers, least, parts, deviations):
            for i, j, a, b in zip(x.tolist(), y.tolist(), of[x].tolist(), of[y].tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b and alike_sets(value[start[i] : start[i + 1]], value[start[j] : start[j + 1]], least):  # components that are linked here are not compared again
                    root[max(a, b)] = min(a, b)
                    src.append(i), dst.append(j)
        return pa.table({"src": pa.array(names[src], pa.int64()), "dst": pa.array(names[dst], pa.int64())})

    def meet(answers: DataFrame, function, schema: str) -> DataFrame:
        return groups.select("block", "key", "keys", "node", "n").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, schema)

    answers = members.join(found, "node", "left").select("block", "node", F.coalesce("component", "node").alias("component"), "prints")
    # not a method of its own: functions with type hints of Arrow are told by their arity
    left = table(meet(answers, lambda g, a: look(g, a), "block int, node long, component long, prints array<int>"))
    return meet(left.join(sets, "node").select(*left.columns, "shingles"), lambda g, a: compare(g, a), "src long, dst long")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, parts: int = PARTS, deviations: float | None = 8.0) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable by links).

    Documents link if the Jaccard similarity of their sets of shingles is least or more and their
    fingerprints differ in two bits or fewer of one of the parts. Groups above SMALL first compare all with one
    member; only pairs across the components that this makes are compared after it, in groups of any size, and in larger ones only pairs
    whose whole fingerprints lie within ``deviations`` standard deviations of what that similarity makes
    (eight: a chance of 1e-15 to miss one; None compares all). Defined results: null, empty and wordless texts have equal, empty sets and make one
    class; fewer words than a shingle make one shingle; rows without an id are left out; of
    documents of equal id each has its set; an empty table gives an empty table.
    """
    share = Fraction(least).limit_denominator(1000)
    docs = documents(docs, key, text)
    made = table(signed(docs, shingle, parts))
    firsts = table(made.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prints").alias("prints")))
    grouped = table(met(firsts.where("n > 0").repartition(max(partitions(docs.sparkSession), 1)), parts))
    # variants of one part in which the same sets meet are one group
    alike = table(grouped.where(F.size("node") > SMALL).groupBy(F.shiftright("key", 32).alias("part"), "node").agg(F.min("key").alias("key"), F.collect_list("key").alias("keys"), F.first("n").alias("n")))
    # a block of them asks once for each member, so that a set in very many groups is no row for each of them
    groups = table(in_blocks(alike))
    members = table(asked(groups).join(firsts.select("node", "prints"), "node"))
    whole = sets_of(members.select("node"), firsts, docs, shingle)
    stars = table(star_links(groups, members.join(whole, "node"), share, parts, deviations))
    found = table(components(stars))
    more = table(links_across(groups, members, found, whole, share, parts, deviations).unionByName(verified(table(apart(small_pairs(grouped, share).distinct(), found)), firsts, docs, shingle, share)))
    of_node = components(stars.unionByName(more))
    rooted = firsts.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return made.select("doc_id", "node").join(rooted.select("node", "component").join(low, "component"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are the smallest of their class of similar texts, with all their columns; rows without an id stay.

    Defined results: of null, empty and wordless texts one stays; of repeated rows of a kept id all stay; very long texts are
    read whole; an empty table gives an empty table; no other column is looked at.
    """
    gone = similar_classes(docs, key, text, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
