"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's tokens fill whole
windows first; the rest goes to the fullest window that has room (best fit). When none has
room and all windows are open, the fullest is emitted, topped up by a cut of the document
if its gap is worth one. What stays open at a partition's end is merged with other
partitions' leftovers in bounded groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, documents, table
from .tokens import END, token_blocks, tokenizer_path

NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECE = ", ".join(f"{n} long" for n in NAMES) + ", ids binary"
#: Sequence ids of merged leftovers start here, above those of partitions.
MERGED = 1 << 62


class Packer:
    """Open windows as lists of pieces (doc_id, start, ids, doc_tokens); emits full ones."""

    def __init__(self, size: int, open_windows: int, least_cut: int):
        self.size, self.most, self.least_cut = size, open_windows, least_cut
        self.windows: list[list] = []
        self.free: list[int] = []
        self.full: list[list] = []

    def add(self, doc: int, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        at = 0
        while len(ids) - at >= self.size:
            self.full.append([(doc, start + at, ids[at : at + self.size], total)])
            at += self.size
        while at < len(ids):
            n = len(ids) - at
            fits = [f for f in self.free if f >= n]
            if fits:
                i = self.free.index(min(fits))
            elif len(self.free) < self.most:
                self.windows.append([]), self.free.append(self.size)
                i = len(self.free) - 1
            else:
                i = self.free.index(min(self.free))
                if self.free[i] < self.least_cut:  # not worth a cut: it goes as it is
                    self._emit(i)
                    continue
                n = self.free[i]
            self.windows[i].append((doc, start + at, ids[at : at + n], total))
            self.free[i] -= n
            at += n
            if not self.free[i]:
                self._emit(i)

    def _emit(self, i: int) -> None:
        self.full.append(self.windows.pop(i))
        self.free.pop(i)

    def taken(self) -> list[list]:
        full, self.full = self.full, []
        return full


def rows(windows: list[list], first: int, keep: bool) -> pa.RecordBatch:
    """The pieces of windows numbered from first; ids themselves only if keep."""
    out = []
    for k, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            raw = ids.astype("<u4").tobytes()
            out.append((doc, start, len(ids), zlib.crc32(raw), total, first + k, offset, raw if keep else None))
            offset += len(ids)
    columns = list(zip(*out, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(NAMES, columns, strict=False)} | {"ids": pa.array(columns[7], pa.binary())})


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4096, open_windows: int = 32, path: str | None = None, least_cut: int = 16, group: int = 32, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence), ids (binary; null unless asked for).

    Every id of every document, and the end id after each, lies in exactly one piece. Sequences
    have size ids at most; those with fewer are to be padded to size, or, where that is less,
    to a power of two. ``group`` partitions' leftovers, at most group * open_windows windows,
    are merged in one task.

    Defined results: a null or empty text is its end id alone; repeated rows are packed
    each; rows without an id are left out; an empty table gives no piece.
    """
    path = path or tokenizer_path()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(size, open_windows, least_cut), TaskContext.get().partitionId() << 40
        for block, tokens, offsets in token_blocks(batches, path, END):
            for i, doc in enumerate(block.ids.tolist()):
                packer.add(doc, tokens[offsets[i] : offsets[i + 1]])
            full = packer.taken()
            yield rows(full, number, ids)
            number += len(full)
            packer.windows = [[(d, s, x.copy(), t) for d, s, x, t in w] for w in packer.windows]  # else they hold the block's ids
        left = rows(packer.windows, -number - 1, True)  # negative: still open
        yield left.set_column(left.schema.get_field_index("sequence_id"), "sequence_id", pa.array(np.full(left.num_rows, -1 - (number >> 40)), pa.int64()))

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, open_windows, 1)
        for p in pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True]).itertuples():
            packer.add(p.doc_id, np.frombuffer(p.ids, "<u4"), p.start, p.doc_tokens)
        # the windows still open, one after the other, so that one alone is not full
        rest = Packer(size, 1, 1)
        for window in packer.windows:
            for doc, start, x, total in window:
                rest.add(doc, x, start, total)
        windows = packer.taken() + rest.taken() + [w for w in rest.windows if w]
        return rows(windows, MERGED + (int(pieces.lot.iloc[0]) << 32), ids).to_pandas()[[*NAMES, "ids"]]

    made = table(arrow_map(documents(docs, key, text), place, PIECE, "word_bpe"))
    done = made.where("sequence_id >= 0")
    left = made.where("sequence_id < 0").withColumn("lot", F.floor((-F.col("sequence_id") - 1) / group).cast("long"))
    return done.unionByName(left.groupBy("lot").applyInPandas(merge, PIECE))


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*NAMES)
