"""Content-defined chunking: the one operator whose state runs byte by byte.

The rolling value is rotl(value, 1) xor gear(byte) over the chunk so far. Since rotating by
64 is the identity, value after n bytes is rotl(xor of rotr(gear(b_i), i), n), and xor
prefixes are a NumPy accumulate: boundaries are found a block at a time, not a byte at a time.

A blob may be a row's cell (``chunks``) or any number of parts in order (``streamed``, ``ranged``), of which no
task holds more than one at a time besides the chunk it is in. ``streamed`` runs over a blob's parts in one task.
``ranged`` cuts one blob in many tasks: each byte range finds where the chain of cuts leaves it
for every place where it may enter; these maps are composed by levels, and then every range knows its entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.canonical import digest_json, hashed, object_json
from .graph import running
from .runs import hashed_runs

MIN, AVG, MAX = 512 << 10, 2 << 20, 8 << 20  # fixed defaults


def _gear() -> np.ndarray:
    """A 64-bit mix of each byte value (splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


GEAR = _gear()


def rotated(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    left = left.astype(np.uint64) & np.uint64(63)
    return (x << left) | (x >> ((np.uint64(64) - left) & np.uint64(63)))


def boundaries(data: bytes | pa.Buffer, least: int = MIN, avg: int = AVG, most: int = MAX, step: int = 1 << 16) -> list[int]:
    """Where chunks end: after at least least bytes, where the rolling value's low bits are zero, or after most bytes."""
    raw, mask, ends, start = np.frombuffer(data, np.uint8), np.uint64(avg - 1), [], 0
    while start < len(raw):
        limit, carry, at, end = min(start + most, len(raw)), np.uint64(0), start, None
        while at < limit and end is None:
            part = raw[at : min(at + step, limit)]
            n = np.arange(at - start + 1, at - start + 1 + len(part), dtype=np.uint64)  # bytes so far
            total = np.bitwise_xor.accumulate(rotated(GEAR[part], np.uint64(64) - (n & np.uint64(63)))) ^ carry
            hit = np.flatnonzero((n >= least) & ((rotated(total, n) & mask) == 0))
            if len(hit):
                end = at + int(hit[0]) + 1
            carry, at = total[-1], at + len(part)
        start = limit if end is None else end
        ends.append(start)
    return ends


def chunks(rows: DataFrame, key: str, data: str, least: int = MIN, avg: int = AVG, most: int = MAX) -> DataFrame:
    """key, ordinal, offset, size, content of each chunk; an empty blob has none."""

    kind = dict(rows.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Chunks(batch.schema.field(0).type, False)
            for k, blob in zip(batch.column(0), batch.column(1), strict=True):
                raw, k, at = blob.as_buffer() if blob.is_valid else b"", k.as_py(), 0
                for i, end in enumerate(boundaries(raw, least, avg, most)):
                    out.add(k, i, at, [memoryview(raw)[at:end]])
                    at = end
                    if out.full():
                        yield out.take(key)
            yield out.take(key)

    made = rows.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(cut, f"`{key}` {kind}, ordinal long, offset long, size long, content string, bytes binary")
    return made.select(key, F.col("ordinal").cast("int").alias("ordinal"), "offset", "size", "content")


def chunk_content(rows: DataFrame, listed: DataFrame, key: str, data: str) -> DataFrame:
    """content, bytes of each distinct chunk (write-once)."""
    b = F.col(data).cast("binary")
    return listed.join(rows.select(key, b.alias("_b")), key).select("content", F.substring(F.col("_b"), F.col("offset").cast("int") + 1, F.col("size").cast("int")).alias("bytes")).dropDuplicates(["content"])


def reassembled(listed: DataFrame, content: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """key, size, sha256, valid: chunks in order against the header's logical size and digest, a batch of chunks at a time; no blob is held whole."""

    return put_together(listed, content, headers, key).withColumn("valid", F.coalesce("valid", F.lit(False)))


def reuse(listed: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, logical and stored bytes."""
    each = listed.groupBy("content").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("distinct_chunks"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"))


# ---------------------------------------------------------------- blobs of many parts


class Cutter:
    """Cuts a stream of bytes that comes in any pieces."""

    def __init__(self, least: int, avg: int, most: int, step: int = 1 << 16):
        self.least, self.mask, self.most, self.step = least, np.uint64(avg - 1), most, step
        self.n, self.total = 0, np.uint64(0)

    def ends(self, raw: np.ndarray) -> list[int]:
        """Where chunks end in the next bytes."""
        out, at = [], 0
        while at < len(raw):
            part = raw[at : at + min(self.step, self.most - self.n)]
            n = np.arange(self.n + 1, self.n + 1 + len(part), dtype=np.uint64)
            total = np.bitwise_xor.accumulate(rotated(GEAR[part], np.uint64(64) - (n & np.uint64(63)))) ^ self.total
            hit = np.flatnonzero(((n >= self.least) & ((rotated(total, n) & self.mask) == 0)) | (n == self.most))
            if len(hit):
                at += int(hit[0]) + 1
                out.append(at)
                self.n, self.total = 0, np.uint64(0)
            else:
                at, self.n, self.total = at + len(part), self.n + len(part), total[-1]
        return out


class _Chunks:
    """Rows of chunks; with bytes only if keep."""

    def __init__(self, kind: pa.DataType, keep: bool):
        self.kind, self.keep, self.rows, self.bytes = kind, keep, [], 0

    def add(self, key, ordinal: int | None, offset: int, parts: list[bytes]) -> None:
        digest, size = hashlib.sha256(), 0
        for p in parts:
            digest.update(p)
            size += len(p)
        self.rows.append((key, ordinal, offset, size, "sha256:" + digest.hexdigest(), b"".join(parts) if self.keep else None))
        self.bytes += size if self.keep else 0

    def full(self) -> bool:
        return len(self.rows) >= 4096 or self.bytes >= 1 << 24

    def take(self, name: str) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 6
        self.rows, self.bytes = [], 0
        kinds = (self.kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip((name, "ordinal", "offset", "size", "content", "bytes"), columns, kinds, strict=True)})


def streamed(parts: DataFrame, key: str, order: str, data: str, least: int = MIN, avg: int = AVG, most: int = MAX, keep: bool = False) -> DataFrame:
    """key, ordinal, offset, size, content, bytes (null unless keep) of each chunk of the blobs that parts make, in order.

    A blob's parts run through one task, one at a time, so memory holds a part and a chunk. Null
    and empty parts add nothing; a blob of such parts has no chunk. Parts of equal order come in any order.
    """
    kind = dict(parts.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key_now, cutter, ordinal, offset, open_ = None, None, None, 0, 0, []

        def close():
            nonlocal ordinal, offset, open_
            if open_:
                out.add(key_now, ordinal, offset, open_)
                ordinal, offset, open_ = ordinal + 1, offset + sum(map(len, open_)), []

        for batch in batches:
            out = out or _Chunks(batch.schema.field(0).type, keep)
            for k, blob in zip(batch.column(0), batch.column(1), strict=True):
                k = k.as_py()
                if cutter is None or k != key_now:
                    close()
                    key_now, cutter, ordinal, offset = k, Cutter(least, avg, most), 0, 0
                buffer, at = blob.as_buffer() if blob.is_valid else b"", 0
                raw = np.frombuffer(buffer, np.uint8)
                for end in cutter.ends(raw):
                    open_.append(raw[at:end].tobytes())
                    close()
                    at = end
                    if out.full():
                        yield out.take(key)
                if at < len(raw):
                    open_.append(raw[at:].tobytes())
        if out:
            close()
            yield out.take(key)

    rows = parts.select(key, F.col(data).cast("binary").alias("data"), F.col(order).alias("_order")).repartition(key).sortWithinPartitions(key, "_order").drop("_order")
    return rows.mapInArrow(cut, f"{key} {kind}, ordinal long, offset long, size long, content string, bytes binary")


def next_cuts(raw: np.ndarray, starts: int, least: int, avg: int, most: int) -> np.ndarray:
    """For each of the first places in raw where a chunk may start, where it ends.

    With xor prefixes p, the value of the bytes from s to e is rotl(p[e] xor p[s], e - 1), so a
    cut is where the low bits of both prefixes, rotated alike, are equal: for each of 64 rotations, the ends
    are sorted by these bits and place, and each start looks up its first end from s + least on.
    """
    n = len(raw)
    place = np.arange(n, dtype=np.uint64)
    p = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(rotated(GEAR[raw], np.uint64(64) - (place & np.uint64(63))))])
    s, mask = np.arange(starts, dtype=np.uint64), np.uint64(avg - 1)
    out = np.minimum(s + np.uint64(most), np.uint64(n))
    for turn in range(64):
        e = np.arange(turn + 1, n + 1, 64, dtype=np.uint64)
        if not len(e):
            break
        ends = np.sort((rotated(p[e], np.uint64(turn)) & mask) << np.uint64(32) | e)
        bits = rotated(p[:starts], np.uint64(turn)) & mask
        at = np.minimum(np.searchsorted(ends, bits << np.uint64(32) | (s + np.uint64(least))), len(ends) - 1)
        found = ends[at]
        fits = (found >> np.uint64(32) == bits) & (found & np.uint64(0xFFFFFFFF) >= s + np.uint64(least))
        np.minimum(out, np.where(fits, found & np.uint64(0xFFFFFFFF), out), out=out)
    return out.astype(np.int64)


def leaving(cuts: np.ndarray, least: int) -> np.ndarray:
    """For each start in a range, the first cut of its chain at or behind the range's end."""
    out, size = cuts.copy(), len(cuts)
    for lo in range((size - 1) // least * least, -1, -least):  # a chunk has least bytes, so what it leads to is known
        block = out[lo : lo + least]
        inside = block < size
        block[inside] = out[block[inside]]
    return out


def exits(raw: np.ndarray, size: int, entries: int, least: int, avg: int, most: int) -> np.ndarray:
    """For each of the first entries places in raw, the first cut of the chain from there at or behind size.

    Gives what ``leaving(next_cuts(...))`` does, but looks only at places that these chains meet, which soon share
    their cuts. An end's key is its rotation and the low bits there; ends of a key are linked in order, and a window of least
    places (no chain stays in it) goes forward with the first end of each key behind it. Keys that
    would take more room than the bytes are searched in order instead.
    """
    n, far = len(raw), len(raw) + 1
    place, mask = np.arange(n, dtype=np.uint64), np.uint64(avg - 1)
    p = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(rotated(GEAR[raw], np.uint64(64) - (place & np.uint64(63))))])
    turns = np.arange(64, dtype=np.uint64)
    keys = (place & np.uint64(63)) * np.uint64(avg) + (rotated(p[1:], place) & mask)  # of end i + 1
    order = np.sort(keys << np.uint64(32) | (place + np.uint64(1)))
    ends, same = (order & np.uint64(0xFFFFFFFF)).astype(np.int32), np.diff(order >> np.uint64(32)) == 0
    later = np.full(n + 2, far, np.int32)  # the next end of the same key
    later[ends[:-1]] = np.where(same, ends[1:], far)
    heads = None
    if 64 * avg <= 4 * n + (1 << 20):
        heads, keys = np.full(64 * avg, far, np.int32), keys.astype(np.int64)
        heads[keys[least - 1 :][::-1]] = np.arange(n, least - 1, -1, dtype=np.int32)  # of equal keys the last one written, so the first end, stays

    def ahead(s: np.ndarray) -> np.ndarray:
        key = turns * np.uint64(avg) + (rotated(p[s][:, None], turns) & mask)
        if heads is None:
            at = np.minimum(np.searchsorted(order, key << np.uint64(32) | (s.astype(np.uint64)[:, None] + np.uint64(least))), n - 1)
            found = np.where(order[at] >> np.uint64(32) == key, ends[at], far)
            found[found < s[:, None] + least] = far
        else:
            found, behind = heads[key.astype(np.int64)].ravel(), np.repeat(np.minimum(s + least, far), 64)
            early = np.flatnonzero(found < behind)
            while len(early):
                found[early] = later[found[early]]
                early = early[found[early] < behind[early]]
        return np.minimum(found.reshape(-1, 64).min(axis=1), np.minimum(s + most, n))

    cuts, met = np.zeros(size, np.int64), np.zeros(size, bool)
    met[:entries] = True
    for lo in range(0, size, least):
        starts = lo + np.flatnonzero(met[lo : lo + least])
        for i in range(0, len(starts), 1 << 12):
            s = starts[i : i + (1 << 12)]
            cuts[s] = ahead(s)
        to = cuts[starts]
        met[to[to < size]] = True
        if heads is not None:
            passed = slice(lo + least - 1, lo + 2 * least - 1)
            heads[keys[passed]] = later[1:][:n][passed]
    return leaving(cuts, least)[:entries]


def ranged(parts: DataFrame, key: str, order: str, data: str, least: int = MIN, avg: int = AVG, most: int = MAX, size: int | None = None, fan: int = 64, keep: bool = False) -> DataFrame:
    """What ``streamed`` gives, for blobs too large for one task: ranges of ``size`` bytes are cut side by side.

    Costs 64 lookups for each place that a range's chains meet where ``streamed`` takes one step a byte, but no task runs over more
    than a range and the longest chunk. Maps hold ``most`` places; ``fan`` of them are composed in a task,
    level by level, and entries are handed down the same way. Keys are not null.
    """
    size = size or max(1 << 26, most)
    if size < most:
        raise ValueError("a range must hold the longest chunk")
    kind = dict(parts.dtypes)[key]
    rows = parts.select(key, F.col(order).alias("_order"), F.col(data).cast("binary").alias("_data")).where("octet_length(_data) > 0")
    rows = running(rows.withColumn("_size", F.octet_length("_data").cast("long")), [key, "_order"], "_size", "_upto")
    first = rows.groupBy(key).agg(F.min(F.col("_upto") - F.col("_size")).alias("_zero"), F.max("_upto").alias("_end"))
    rows = rows.join(first, key).select(key, "_data", (F.col("_upto") - F.col("_size") - F.col("_zero")).alias("lo"), (F.col("_upto") - F.col("_zero")).alias("hi"), (F.col("_end") - F.col("_zero")).alias("whole"))
    # a piece for each range that a part meets; a range also sees the longest chunk's bytes behind it
    low = F.greatest(F.lit(0), F.expr(f"(lo - {most}) div {size}"))
    pieces = rows.select("*", F.explode(F.sequence(low, F.expr(f"(hi - 1) div {size}"))).alias("range"))
    start = F.greatest("lo", F.col("range") * size)
    pieces = pieces.withColumn("_a", start).withColumn("_b", F.least("hi", F.col("range") * size + size + most)).where("_a < _b")
    pieces = pieces.select(key, "range", "whole", F.col("_a").alias("at"), F.substring("_data", (F.col("_a") - F.col("lo")).cast("int") + 1, (F.col("_b") - F.col("_a")).cast("int")).alias("data"))

    def bytes_of(table: pa.Table, number: int) -> np.ndarray:
        raw = np.zeros(max((a - number * size + len(d) for a, d in zip(table["at"].to_pylist(), table["data"].to_pylist(), strict=True)), default=0), np.uint8)
        for a, d in zip(table["at"].to_pylist(), table["data"].to_pylist(), strict=True):
            raw[a - number * size : a - number * size + len(d)] = np.frombuffer(d, np.uint8)
        return raw

    def maps(table: pa.Table) -> pa.Table:
        number, whole = table["range"][0].as_py(), table["whole"][0].as_py()
        raw, here = bytes_of(table, number), min(size, whole - number * size)
        out = exits(raw, here, min(here, most), least, avg, most) - size
        if number * size + size >= whole:
            out[:] = 0  # the chain ends here
        return pa.table({key: table[key].slice(0, 1), "node": pa.array([number], pa.int64()), "level": pa.array([0], pa.int64()), "map": pa.array([out.astype("<i8").tobytes()], pa.binary())})

    pieces = written(pieces)
    shape = f"{key} {kind}, node long, level long, map binary"
    levels = [written(pieces.groupBy(key, "range").applyInArrow(lambda t: maps(t), shape))]

    def composed(table: pa.Table) -> pa.Table:
        order_ = np.argsort(table["node"].to_numpy())
        chain = [np.frombuffer(table["map"][int(i)].as_py(), "<i8") for i in order_]
        out = chain[0]
        for m in chain[1:]:
            out = m[np.minimum(out, len(m) - 1)]
        node, level = table["node"][int(order_[0])].as_py() // fan, table["level"][0].as_py() + 1
        return pa.table({key: table[key].slice(0, 1), "node": pa.array([node], pa.int64()), "level": pa.array([level], pa.int64()), "map": pa.array([out.astype("<i8").tobytes()], pa.binary())})

    while not levels[-1].where("node > 0").isEmpty():
        levels.append(written(levels[-1].withColumn("_up", F.expr(f"node div {fan}")).groupBy(key, "_up").applyInArrow(lambda t: composed(t.drop_columns(["_up"])), shape)))
    entries = levels[-1].select(key, "node", F.lit(0).cast("long").alias("entry"))

    def handed(table: pa.Table) -> pa.Table:
        order_ = np.argsort(table["node"].to_numpy())
        entry, nodes, out = table["entry"][0].as_py(), [], []
        for i in order_:
            m = np.frombuffer(table["map"][int(i)].as_py(), "<i8")
            nodes.append(table["node"][int(i)].as_py())
            out.append(entry)
            entry = int(m[min(entry, len(m) - 1)])
        return pa.table({key: table[key].slice(0, 1).take([0] * len(nodes)), "node": pa.array(nodes, pa.int64()), "entry": pa.array(out, pa.int64())})

    for level in reversed(levels[:-1]):
        below = level.withColumn("_up", F.expr(f"node div {fan}")).join(entries.withColumnRenamed("node", "_up"), [key, "_up"])
        entries = written(below.groupBy(key, "_up").applyInArrow(lambda t: handed(t), f"{key} {kind}, node long, entry long"))

    def cut(table: pa.Table) -> pa.Table:
        number, whole, entry = table["range"][0].as_py(), table["whole"][0].as_py(), table["entry"][0].as_py()
        raw, out, base, here = bytes_of(table, number), _Chunks(table.schema.field(key).type, keep), number * size, min(size, whole - number * size)
        ends = Cutter(least, avg, most, min(1 << 16, 2 * avg)).ends(raw[entry:]) if entry < here else []
        for end in [*(entry + e for e in ends), len(raw)]:
            if entry < min(here, end):
                out.add(table[key][0].as_py(), None, base + entry, [raw[entry:end].tobytes()])
                entry = end
        return pa.Table.from_batches([out.take(key)])

    made = pieces.join(entries.withColumnRenamed("node", "range"), [key, "range"]).groupBy(key, "range").applyInArrow(lambda t: cut(t), f"{key} {kind}, ordinal long, offset long, size long, content string, bytes binary")
    made = running(written(made.drop("ordinal")).withColumn("_one", F.lit(1).cast("long")), [key, "offset"], "_one", "_nth")
    first = made.groupBy(key).agg(F.min("_nth").alias("_first"))
    return made.join(first, key).select(key, (F.col("_nth") - F.col("_first")).alias("ordinal"), "offset", "size", "content", "bytes")


def headers_of(parts: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key, logical_size, logical_sha256 of the blobs that parts make, in order; a batch of parts at a time."""
    return hashed_runs(parts, [key], [order], F.col(data)).select(key, F.col("size").alias("logical_size"), F.col("sha256").alias("logical_sha256"))


def put_together(listed: DataFrame, content: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """key, size, sha256, valid: chunks (content, bytes) in order against each blob's header, a chunk at a time; a missing chunk is not valid."""
    chunks_ = listed.select(key, "ordinal", "content").join(content.select("content", "bytes"), "content", "left")
    found = headers_of(headers.select(key, F.lit(-1).cast("long").alias("ordinal"), F.lit(None).cast("binary").alias("bytes")).unionByName(chunks_.select(key, F.col("ordinal").cast("long").alias("ordinal"), "bytes")), key, "ordinal", "bytes")
    both = found.withColumnRenamed("logical_size", "size").withColumnRenamed("logical_sha256", "sha256").join(headers, key)
    return both.select(key, "size", "sha256", ((F.col("size") == F.col("logical_size")) & (F.col("sha256") == F.col("logical_sha256"))).alias("valid"))


def chunk_manifests(listed: DataFrame, headers: DataFrame, key: str, least: int = MIN, avg: int = AVG, most: int = MAX) -> DataFrame:
    """key, manifest, content of each blob's chunk manifest: canonical JSON that names its chunks in order."""
    number = lambda c: F.col(c).cast("string")
    entry = object_json(content=digest_json("content"), size=number("size"))
    each = listed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("j")))), lambda x: x["j"]), ",").alias("_c"))
    manifest = object_json(version=F.lit("1"), logical_size=number("logical_size"), logical_sha256=digest_json("logical_sha256"), min_chunk=F.lit(str(least)), avg_chunk=F.lit(str(avg)), max_chunk=F.lit(str(most)), chunks=F.concat(F.lit("["), F.coalesce("_c", F.lit("")), F.lit("]")))
    return headers.join(each, key, "left").select(key, manifest.alias("manifest")).withColumn("content", hashed(F.col("manifest")))
