"""Hashes over rows in order, a batch at a time: what a group's concatenated bytes come to without holding them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, int, int]]:
    """Equal keys that follow one another: the key, and where its rows start and end."""
    keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield keys[at], at, i
            at = i


def _bytes(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset), memoryview(data if data is not None else b"")


def in_order(rows: DataFrame, keys: list[str], order: list[str], data: Column) -> DataFrame:
    """keys and data, a group's rows one after the other in a partition, in order: one shuffle, and a sort that can spill."""
    named = rows.select(*keys, data.cast("binary").alias("_data"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    return named.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).select(*keys, "_data")


def hashed_runs(rows: DataFrame, keys: list[str], order: list[str], data: Column, before: bytes = b"", after: bytes = b"", skip: int = 0) -> DataFrame:
    """keys, parts (rows), size, sha256 (hex) of before, each group's data in order, and after.

    The first skip bytes of a group's first row are left out, so data may begin with a separator. Null data adds
    nothing. A group of any size runs through one task with a batch in memory, as SHA-256 can't be split.
    """
    types = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, digest, out, kinds = None, 0, 0, None, [], None

        def close() -> None:
            if digest is not None:
                digest.update(after)
                out.append((*now, parts, size + len(after), digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * (len(keys) + 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int64(), pa.int64(), pa.string()], strict=True)], [*keys, "parts", "size", "sha256"])

        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(keys))]
            offsets, raw = _bytes(b.column(len(keys)))
            for key, lo, hi in _runs(b, len(keys)):
                start = int(offsets[lo])
                if digest is None or key != now:
                    close()
                    now, parts, size, digest = key, 0, len(before), hashlib.sha256(before)
                    start = min(start + skip, int(offsets[lo + 1]))
                digest.update(raw[start : int(offsets[hi])])
                parts, size = parts + hi - lo, size + int(offsets[hi]) - start
            if len(out) >= 4096:
                yield batch()
        close()
        if kinds:
            yield batch()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    return in_order(rows, keys, order, data).mapInArrow(run, f"{fields}, parts long, size long, sha256 string")


def pieces(rows: DataFrame, keys: list[str], order: list[str], data: Column, before: bytes = b"", after: bytes = b"", skip: int = 0, most: int = 1 << 20) -> DataFrame:
    """keys, ordinal, data: what ``hashed_runs`` hashes, in pieces of about most bytes, so that no cell grows with its group."""
    types = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ordinal, held, kinds, started = None, 0, bytearray(), None, False

        def piece() -> pa.RecordBatch:
            nonlocal ordinal, held
            row = pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(now, kinds, strict=True)], pa.array([ordinal], pa.int64()), pa.array([bytes(held)], pa.binary())], [*keys, "ordinal", "data"])
            ordinal, held = ordinal + 1, bytearray()
            return row

        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(keys))]
            offsets, raw = _bytes(b.column(len(keys)))
            for key, lo, hi in _runs(b, len(keys)):
                start = int(offsets[lo])
                if not started or key != now:
                    if started:
                        held += after
                        yield piece()
                    now, ordinal, held, started = key, 0, bytearray(before), True
                    start = min(start + skip, int(offsets[lo + 1]))
                for at in range(start, int(offsets[hi]), most):
                    held += raw[at : min(at + most, int(offsets[hi]))]
                    if len(held) >= most:
                        yield piece()
        if started:
            held += after
            yield piece()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    return in_order(rows, keys, order, data).mapInArrow(run, f"{fields}, ordinal long, data binary")
