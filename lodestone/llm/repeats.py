"""Passages that repeat across documents: what the two substring de-duplicators share.

A window is ``size`` consecutive units (bytes or words) of one document. A window is
*repeated* if an equal one starts in a document with a smaller id. Windows are judged on
the input, and every unit that a repeated window covers is removed.

A table of N units has about N windows, too many to shuffle one by one. Neighbouring
windows are therefore handled as *runs*: the windows that share one anchor, the smallest
hash among the ``k``-unit strings inside the window. The anchor depends on the window's
content only, so equal windows have equal anchors wherever they stand.

1. A sketch of anchors, counted by document, drops runs whose anchor is in one document
   only. It may let too many pass, never too few. Its size is bounded.
2. Runs are grouped by (anchor, whole content). If the first document of a group is not
   the run's own, all its windows are repeated.
3. Where one anchor has runs of different content, the windows of each content's first
   runs are compared one by one, by a name of the whole window.

Hashes have 64 bits within a group that already shares a 64-bit anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, Substrings, blocks, mix, ranges
from .shared import arrow_map, documents, table

CHUNK = 1 << 18
#: Most windows of a run.
LONGEST = 64
SLICE = 1 << 16
ROWS = 2
#: Default bound of the sketch: slots in each of its rows, a bit each where it is broadcast (128 MB in all).
MOST_SLOTS = 1 << 29


class Units:
    """The units of a block: two hash lanes and the first unit of each document."""

    def __init__(self, block: Block, unit: str):
        if unit == "bytes":
            self.lanes, self.first = (block.data, block.data), block.offsets
        else:
            self.words = block.words()
            self.lanes, self.first = (self.words.hashes(0), self.words.hashes(1)), self.words.first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(units: Units, size: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, content hash, document (its place in the block), first window, number of windows."""
    total, first = len(units.lanes[0]), units.first
    for at in range(0, max(total - size + 1, 0), CHUNK):
        lanes = [x[at : at + CHUNK + size - 1] for x in units.lanes]
        n = len(lanes[0]) - size + 1  # windows that start in this chunk
        one, two = Substrings(lanes[0], 0), Substrings(lanes[1], 1)
        here = np.arange(n + size - k)
        anchor = sliding_min(one.at(here, here + k), size - k + 1)
        start, last = np.clip(first[:-1] - at, 0, n), np.clip(first[1:] - size + 1 - at, 0, n)
        some = last > start
        start, last = start[some], last[some]
        inside = np.zeros(n + 1, np.int8)
        inside[start] += 1
        np.add.at(inside, last, -1)
        new = np.zeros(n, bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[start] = True
        lo = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
        if not len(lo):
            continue
        hi = np.minimum(np.append(lo[1:], n), last[np.searchsorted(start, lo, "right") - 1])
        # no run is long: long strings can be given one polynomial hash (see ``blocks.LONG``)
        lots = -(-(hi - lo) // LONGEST)
        key, hi = np.repeat(anchor[lo], lots), np.repeat(hi, lots)
        lo = np.repeat(lo, lots) + LONGEST * ranges(np.zeros(len(lots), np.int64), lots)
        hi = np.minimum(lo + LONGEST, hi)
        doc = np.searchsorted(first, lo + at, "right") - 1
        yield mix(key), two.at(lo, hi - 1 + size), doc, lo + at - first[doc], hi - lo


def gathered(units: Units, size: int, k: int) -> list[np.ndarray]:
    parts = list(runs(units, size, k))
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate(kinds)]


class Sketch:
    """A count-min sketch of anchors whose counters stop at two, kept as bits 'two or more'."""

    def __init__(self, slots: int, bits: np.ndarray):
        self.slots, self.bits = slots, bits

    @staticmethod
    def places(keys: np.ndarray, slots: int) -> list[np.ndarray]:
        return [(x & np.uint64(slots - 1)) + np.uint64(row * slots) for row, x in enumerate((keys, mix(keys + np.uint64(1))))]

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys of one document."""
        out = np.ones(len(keys), bool)
        for place in self.places(keys, self.slots):
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def capped(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, at most two."""
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.minimum(np.bincount(inverse, weights), 2).astype(np.uint8)


def sketch(docs: DataFrame, unit: str, size: int, k: int, most_slots: int = MOST_SLOTS) -> Sketch:
    """Each task's sketch, as the non-zero counters of slices, merged slice by slice."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = 2 * volume // ((size - k + 2) * (1 if unit == "bytes" else 5))
    slots = min(max(1 << int(2 * anchors).bit_length(), SLICE), most_slots)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            each, n = capped(np.concatenate(keys), np.concatenate(counts))
            slot = np.concatenate(Sketch.places(each, slots))
            slot, n = capped(slot, np.tile(n, ROWS))
            cut = np.flatnonzero(np.diff(slot >> np.uint64(16), prepend=np.uint64(1 << 63)))
            end = np.append(cut[1:], len(slot))
            low = (slot & np.uint64(SLICE - 1)).astype(np.uint16)
            pack = lambda which: pa.array([low[a:b][which[a:b]].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())
            return pa.RecordBatch.from_pydict({"slice": pa.array((slot[cut] >> np.uint64(16)).astype(np.int32)), "once": pack(n == 1), "twice": pack(n == 2)})

        for block in blocks(batches, "doc_id", "text"):
            key, _, doc, _, _ = gathered(Units(block, unit), size, k)
            if not len(key):
                continue
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])  # a document counts once
            each, n = capped(key[new])
            keys.append(each), counts.append(n)
            if (held := held + len(each)) > 1 << 19:
                yield flush()
                keys, counts, held = [], [], 0
        if keys:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        count = np.zeros(SLICE, np.int64)
        for name, weight in (("once", 1), ("twice", 2)):
            for x in group.column(name):
                count[np.frombuffer(x.as_buffer(), np.uint16)] += weight
        return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())})

    merged = arrow_map(docs, partial, "slice int, once binary, twice binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").toArrow()
    bits = np.zeros(ROWS * slots // 8, np.uint8)
    for at, x in zip(merged.column("slice").to_pylist(), merged.column("bits"), strict=True):
        bits[at * SLICE // 8 : (at + 1) * SLICE // 8] = np.frombuffer(x.as_buffer(), np.uint8)
    return Sketch(slots, bits)


RUN = "anchor long, content long, doc long, lo long, n int, more array<struct<doc:long,lo:long>>"
OCCURRENCE = pa.list_(pa.struct([("doc", pa.int64()), ("lo", pa.int64())]))


def run_rows(docs: DataFrame, unit: str, size: int, k: int, kept) -> DataFrame:
    """Runs whose anchor may be in two documents; equal runs of a block make one row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = kept.value
        for block in blocks(batches, "doc_id", "text"):
            parts = gathered(Units(block, unit), size, k)
            use = filter_.repeated(parts[0])
            key, content, doc, lo, n = (x[use] for x in parts)
            if not len(key):
                continue
            doc = block.ids[doc]
            order = np.lexsort((lo, doc, content, key))
            key, content, doc, lo, n = (x[order] for x in (key, content, doc, lo, n))
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            rest = np.flatnonzero(~head)
            group = np.cumsum(head) - 1
            sizes = np.bincount(group[rest], minlength=int(head.sum()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(doc[rest]), pa.array(lo[rest])], ["doc", "lo"]), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(key[head].view(np.int64)), "content": pa.array(content[head].view(np.int64)), "doc": pa.array(doc[head]), "lo": pa.array(lo[head]), "n": pa.array(n[head].astype(np.int32)), "more": more.cast(OCCURRENCE)})

    return arrow_map(docs, scan, RUN)


def ranked(rows: DataFrame) -> DataFrame:
    """doc, lo, n, anchor of each run that is repeated as a whole (anchor null) or must be compared window by window."""
    same, all_ = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    rows = rows.repartition("anchor").withColumn("first", F.min("doc").over(same))
    rows = rows.withColumn("mixed", F.min("content").over(all_) != F.max("content").over(all_)).where("mixed or doc > first or more is not null")
    each = rows.select("anchor", "n", "first", "mixed", F.explode(F.concat(F.array(F.struct("doc", "lo")), F.coalesce("more", F.array().cast("array<struct<doc:long,lo:long>>")))).alias("at"))
    return each.where("mixed or at.doc > first").select("at.doc", "at.lo", "n", F.when(F.col("at.doc") == F.col("first"), F.col("anchor")).alias("anchor"))


def window_names(units: Units, start: np.ndarray, size: int) -> np.ndarray:
    """The 64-bit name of each window's ``size`` units.

    Not two names of halves in 32 bits each: windows of one anchor often share a half, and
    then 32 bits would have to tell them apart.
    """
    return Substrings(units.lanes[1], 1).at(start, start + size)


def windows(docs: DataFrame, open_runs: DataFrame, unit: str, size: int) -> DataFrame:
    """doc, lo of the repeated windows among those of open_runs."""
    by_doc = open_runs.groupBy("doc").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("open"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, seen = batch.column("open"), 0
            for block in blocks(iter([batch]), "doc_id", "text"):
                part = lists.slice(seen, len(block))
                seen += len(block)
                units, flat = Units(block, unit), part.flatten()
                anchor, lo, n = (flat.field(i).to_numpy() for i in range(3))
                row = np.repeat(np.arange(len(block)), part.value_lengths().to_numpy())
                start = np.repeat(units.first[row], n) + ranges(lo, n)
                value = window_names(units, start, size).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor), "doc": pa.array(block.ids[row]), "lo": pa.array(lo), "hashes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))})

    made = arrow_map(docs.join(by_doc, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "open"), hashes, "anchor long, doc long, lo long, hashes array<long>")
    each = made.repartition("anchor").select("anchor", "doc", "lo", F.posexplode("hashes").alias("i", "window"))
    first = F.min("doc").over(Window.partitionBy("anchor", "window"))
    return each.withColumn("first", first).where("doc > first").select("doc", (F.col("lo") + F.col("i")).alias("lo"))


def repeated_spans(docs: DataFrame, unit: str, size: int, k: int, most_slots: int = MOST_SLOTS) -> DataFrame:
    """doc, spans: for each document with repeated windows, their first units and numbers."""
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(sketch(docs, unit, size, k, most_slots))
    found = table(ranked(run_rows(docs, unit, size, k, kept)))
    whole = found.where("anchor is null").select("doc", "lo", "n")
    single = windows(docs, found.where("anchor is not null"), unit, size).withColumn("n", F.lit(1))
    return whole.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


OUT = "doc_id long, n_units long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "bytes", size: int = 50, k: int | None = None, whole_characters: bool = False, carry: list[str] | None = None, most_slots: int = MOST_SLOTS) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans (maximal removed runs), kept (what is left).

    With unit 'words' what is left is the kept words joined by one space. With
    whole_characters, a span of bytes is first narrowed to whole UTF-8 characters. The
    columns named in carry come along in a struct, carried. most_slots bounds the sketch: it has
    2 * most_slots bits, on the driver and in every worker. It keeps out runs of one document
    as long as there are fewer anchors than that (about 13 bytes of text, or 100 where units
    are words, to an anchor); beyond, more runs are grouped exactly, with the same results.

    Defined results: a null, empty or short text (fewer units than size) loses nothing; of
    exact copies the one with the smallest id stays whole; rows without an id are left
    out; documents of equal id count as one document; an empty table gives an empty table.
    """
    carries = carry is not None
    carried = None if carry is None else docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.struct(*carry).alias("carried")).where(F.col("doc_id").isNotNull())
    docs = documents(docs, key, text)
    spans = repeated_spans(docs, unit, size, k or max(size // 2 - 1, 1), most_slots)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, seen = batch.column("spans"), 0
            for block in blocks(iter([batch]), "doc_id", "text"):
                part, at = lists.slice(seen, len(block)), seen
                seen += len(block)
                made = rest(block, part)
                yield made.append_column("carried", batch.column("carried").slice(at, len(block))) if carries else made

    def rest(block: Block, lists: pa.ListArray) -> pa.RecordBatch:
        words = None if unit == "bytes" else block.words()
        first = block.offsets if words is None else words.first
        n, flat = first[-1], lists.flatten()
        row = np.repeat(np.arange(len(block)), lists.value_lengths().fill_null(0).to_numpy())
        start = first[row] + flat.field(0).to_numpy()
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, start + flat.field(1).to_numpy() - 1 + size, -1)
        gone = np.cumsum(step[:-1]) > 0
        if words is None and whole_characters and n:
            begins = (block.data & 0xC0) != 0x80
            character = np.cumsum(begins) - 1
            kept_part = np.bincount(character[~gone], minlength=character[-1] + 1) > 0
            gone &= ~kept_part[character]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        at = first[:-1][first[:-1] < n]
        edge[at] = gone[at]
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
        removed, count = sums(gone), sums(edge)
        if words is None:
            data, length = block.data[~gone], np.diff(first) - removed
        else:
            stay = np.flatnonzero(~gone)
            long = words.end[stay] - words.start[stay] + 1
            index = ranges(words.start[stay], long)
            data = np.append(block.data, np.uint8(32))[np.minimum(index, len(block.data))]
            data[np.cumsum(long) - 1] = 32
            total = np.concatenate([[0], np.cumsum(long)])
            ends = np.concatenate([[0], np.cumsum(~gone)])[first]
            length = np.diff(total[ends])
            last = total[ends[1:]][length > 0] - 1  # no space after the last word
            data = np.delete(data, last)
            length = length - (length > 0)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids), "n_units": pa.array(np.diff(first)), "n_removed": pa.array(removed), "n_spans": pa.array(count), "kept": kept})

    if carried is None:
        return arrow_map(docs.join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans"), cut, OUT)
    out = T._parse_datatype_string(OUT).add(carried.schema["carried"])
    return arrow_map(carried.join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans", "carried"), cut, out)
