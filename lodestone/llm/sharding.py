"""Histogram sort: shards of near-equal bytes by exact counts below candidate key boundaries.

Rows are ordered by three 60-bit keys: a digest of their group, a digest that tells
the group's rows apart, and their place in the written table, for rows that repeat. Each
round counts, across all partitions, the bytes of every probed key range that still holds a
wanted splitter, and refines only ranges whose edges miss it by more than the
tolerance. Ranges of whole groups come first, so a group is cut only where it is too
large for the tolerance itself. When all splitters are set, rows are exchanged once, by range.
Everything is DataFrame expressions; the driver sees counts of probes, never rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

KEYS, BITS = ("_k0", "_k1", "_k2"), 60
#: Bits that the first probe of a key resolves, and those that each further round adds.
FIRST, NEXT = 12, 6


class Range(NamedTuple):
    """Rows whose keys before ``i`` are ``fixed`` and whose key ``i`` without its ``shift`` low bits is ``prefix``."""

    i: int
    shift: int
    fixed: tuple[int, ...]
    prefix: int

    @property
    def finer(self) -> int:
        return self.shift - (FIRST if self.shift == BITS else min(NEXT, self.shift))

    def edge(self, prefix: int, shift: int) -> tuple[int, ...]:
        return (*self.fixed, prefix << shift, *[0] * (len(KEYS) - self.i - 1))


class Counted(NamedTuple):
    """A range's children: prefix, bytes, rows and the keys' extremes of each, by prefix."""

    prefix: int
    size: int
    rows: int
    lows: tuple[int, ...]
    highs: tuple[int, ...]


def digest(value: Column) -> Column:
    """60 bits of a string's digest."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def counted(keyed: DataFrame, probes: list[Range]) -> dict[Range, list[Counted]]:
    """Exact bytes and rows of each probed range's children, in one pass."""
    label, child = F.lit(None).cast("string"), F.lit(None).cast("long")
    names: dict[str, Range] = {}
    for i, shift, finer in sorted({(p.i, p.shift, p.finer) for p in probes}):
        own = {".".join(map(str, (i, shift, *p.fixed, p.prefix))): p for p in probes if (p.i, p.shift) == (i, shift)}
        names |= own
        at = F.concat_ws(".", F.lit(i), F.lit(shift), *KEYS[:i], F.shiftright(KEYS[i], shift))
        inside = at.isin(list(own))
        label, child = F.when(inside, at).otherwise(label), F.when(inside, F.shiftright(KEYS[i], finer)).otherwise(child)
    ends = [f(k).alias(f"{n}{k}") for k in KEYS for n, f in (("low", F.min), ("high", F.max))]
    found = keyed.select(label.alias("label"), child.alias("child"), "_size", *KEYS).where("label is not null").groupBy("label", "child").agg(F.sum("_size").alias("size"), F.count("*").alias("rows"), *ends)
    out: dict[Range, list[Counted]] = {p: [] for p in probes}
    for r in found.collect():
        out[names[r["label"]]].append(Counted(r["child"], int(r["size"]), r["rows"], tuple(r[f"low{k}"] for k in KEYS), tuple(r[f"high{k}"] for k in KEYS)))
    return {p: sorted(c) for p, c in out.items()}


def narrower(p: Range, c: Counted) -> Range | None:
    """Where to look inside a child: at the next key where all its rows share this one; None if there is nothing to tell rows apart."""
    i, shift, fixed, prefix = p.i, p.finer, p.fixed, c.prefix
    while i < len(KEYS) and c.lows[i] == c.highs[i]:
        i, shift, fixed, prefix = i + 1, BITS, (*fixed, c.lows[i]), 0
    return Range(i, shift, fixed, prefix) if i < len(KEYS) else None


def splitters(keyed: DataFrame, shards: int, per_mille: int) -> list[tuple[int, ...]]:
    """The first key of each shard but the first: ``shards - 1`` of them, ascending."""
    total = int(keyed.agg(F.sum("_size")).first()[0] or 0)
    found: dict[int, tuple[int, ...]] = {}
    wanted = {Range(0, BITS, (), 0): (0, list(range(1, shards)))} if total else {}
    while wanted:
        level, deeper = counted(keyed, list(wanted)), {}
        for p, (start, targets) in wanted.items():
            ends = [start]
            for c in level[p]:
                ends.append(ends[-1] + c.size)
            j = 0
            for s in targets:
                while j < len(level[p]) - 1 and shards * ends[j + 1] < s * total:
                    j += 1
                near = min((j, j + 1), key=lambda e: (abs(shards * ends[e] - s * total), e))
                inside = narrower(p, level[p][j])
                if inside is None or 1000 * abs(shards * ends[near] - s * total) <= per_mille * total:
                    found[s] = p.edge(level[p][near].prefix, p.finer) if near < len(level[p]) else p.edge(p.prefix + 1, p.shift)
                else:
                    deeper.setdefault(inside, (ends[j], []))[1].append(s)
        wanted = deeper
    return sorted(found.values())


def shard_of(edges: list[tuple[int, ...]], first: int = 0) -> Column:
    """The number of edges at or below a row's keys, by binary decisions."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    least = F.lit(True)
    for k, v in reversed(list(zip(KEYS, edges[middle], strict=True))):
        least = (F.col(k) > v) | ((F.col(k) == v) & least)
    return F.when(least, shard_of(edges[middle + 1 :], first + middle + 1)).otherwise(shard_of(edges[:middle], first))


def histogram_shards(rows: DataFrame, shards: int, size: str, group: str, order: str, keep: list[str] | None = None, per_mille: int = 2) -> DataFrame:
    """rows (the columns ``keep``, or all) with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Shards are runs of the key order with near-equal sums of ``size``: each edge is within
    ``per_mille`` thousandths of a mean shard of its ideal place, or, where no row ends
    there, at the nearest end of a row. Rows of equal ``group`` share a shard unless their group lies
    across an edge that the tolerance does not let move; ``order`` then decides who goes where.

    Defined results: null sizes count as 0, null groups and orders as empty ones; repeated rows are
    each placed, and a run of them is cut like any other; a table without rows
    gives none; one whose sizes are all 0 lies in shard 0. Columns named shard or slot are replaced.
    The rows kept are written once to the shared folder, so that all rounds see the same ones.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (group, order)]
    names = [c for c in (keep or rows.columns) if c not in ("shard", "slot")]
    keyed = table(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), digest(text[0]).alias(KEYS[0]), digest(text[1]).alias(KEYS[1]), F.monotonically_increasing_id().alias(KEYS[2])))
    edges = splitters(keyed, shards, per_mille)
    placed = keyed.select("_row", shard_of(edges).cast("int").alias("shard"), *KEYS).repartitionByRange("shard", *KEYS).sortWithinPartitions("shard", *KEYS)
    placed = table(placed.select("_row", "shard", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = placed.groupBy("_part", "shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each part and shard that meet
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(runs.withColumn("_before", before).drop("_n"), ["_part", "shard"]).select("_row.*", "shard", (F.col("_before") + F.col("_at") - F.col("_first")).alias("slot"))


def op13(spark, sf_dir: str) -> DataFrame:
    """24 shards of near-equal bytes; null texts have 8 bytes and crc32 0, rows without an id are placed too. Nulls, ties and repeats as in ``histogram_shards``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text.alias("text"))
    placed = histogram_shards(sized, 24, "size", "text", "doc_id", keep=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
