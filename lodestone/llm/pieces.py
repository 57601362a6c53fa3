"""SentencePiece encoding and decoding by a streaming Viterbi search.

The public model's pieces were made by byte-pair merges, so the best segmentation is not the
one of the highest summed score: it is the one in which every two neighbouring pieces would
stay apart if they were merged alone. Exactly one piece that ends at a position fulfils this
with the piece before it, so the search keeps one backpointer a position, as Viterbi does,
with this test in place of the score. The result equals the merge algorithm's.

No piece is longer than ``longest``, so paths that survive end within that window. Whenever
all of them run through one boundary, the ids before it are committed and forgotten.
Characters that are no piece become their bytes' ids.

Whole texts are cut only where no piece can reach across (before a space that follows no
space, and around line feeds); each worker searches every distinct part once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, blocks, mix, named, ranges
from .shared import arrow_map, documents, kept
from .tokens import Flat

SPACE = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces, scores and byte ids, and which pairs of pieces stay apart."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        byte = {i for i in range(size) if model.is_byte(i)}
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in byte}
        self.ids = {p: i for i, p in enumerate(self.names) if i not in special and i not in byte}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        content = [b"" if i in special else bytes([int(p[1:-1], 16)]) if i in byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self.data = np.frombuffer(b"".join(content), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in content])])
        self.apart = lru_cache(maxsize=500_000)(self._apart)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best-scored pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]


class StreamingViterbi:
    """Encodes text given in any parts; push and finish return the ids committed so far."""

    def __init__(self, pieces: Pieces, check: int = 64):
        self.pieces, self.check = pieces, check
        self.window = ""  # text from the last committed boundary
        self.back = [0]  # length of the last piece of the best path to each position of the window
        self.before: str | None = None  # the piece committed last
        self.most = 0  # the longest window so far

    def push(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), self.check):
            self._extend(text[at : at + self.check])
            self.most = max(self.most, len(self.window))
            out += self._commit(False)
        return out

    def finish(self) -> list[int]:
        return self._commit(True)

    def _piece(self, end: int) -> str | None:
        """The last piece of the path to a position."""
        return self.window[end - self.back[end] : end] if end else self.before

    def _extend(self, text: str) -> None:
        ids, apart, longest, back = self.pieces.ids, self.pieces.apart, self.pieces.longest, self.back
        begin = len(self.window)
        self.window += text
        window = self.window
        for end in range(begin + 1, len(window) + 1):
            length = 1  # a character that is no piece stands alone
            for n in range(min(longest, end), 0, -1):
                piece = window[end - n : end]
                if n > 1 and piece not in ids:
                    continue
                left = self._piece(end - n)
                if left is None or (left not in ids) or (piece not in ids) or apart(left, piece):
                    length = n
                    break
            back.append(length)

    def _commit(self, all_: bool) -> list[int]:
        end = len(self.window)
        if all_:
            boundary = end
        else:
            alive = set(range(max(0, end - self.pieces.longest + 1), end + 1))
            while len(alive) > 1:  # the latest position steps back until all meet
                last = max(alive)
                alive.remove(last)
                alive.add(last - self.back[last])
            boundary = alive.pop()
        found, at = [], boundary
        while at:
            found.append(self.window[at - self.back[at] : at])
            at -= self.back[at]
        out: list[int] = []
        for piece in reversed(found):
            known = self.pieces.ids.get(piece)
            out += self.pieces.bytes_of(piece) if known is None else [known]
        if boundary:
            self.before = found[0]
            self.window = self.window[boundary:]
            self.back = [0, *self.back[boundary + 1 :]]
        return out


def worker(path: str) -> tuple[Pieces, Flat]:
    """This worker's pieces and the ids of the parts it has met."""

    def make() -> tuple[Pieces, Flat]:
        pieces = Pieces(path)

        def search(parts: list[bytes]) -> list[list[int]]:
            out = []
            for part in parts:
                search_ = StreamingViterbi(pieces)
                out.append(search_.push(part.decode().replace(" ", SPACE)) + search_.finish())
            return out

        return pieces, Flat(search)

    return kept(("pieces", path), make)


def parts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the parts that no piece crosses."""
    data, offsets = block.data, block.offsets
    space, feed = data == 32, data == 10
    blank = space.copy()  # the last byte of a space, which U+2581 also is
    blank[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1][1:] = (space[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def encode(block: Block, pieces: Pieces, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block and where each document's start; a text that isn't empty begins with a space of its own."""
    if not len(block.data):
        return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
    start, end, doc = parts(block)
    head = np.zeros(len(start), bool)
    head[1:] = doc[1:] != doc[:-1]
    head[0] = True
    keys = mix(named(block.data, start, end) + head.astype(np.uint64))
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    content = lambda i: b" " * int(head[first[i]]) + block.data[start[first[i]] : end[first[i]]].tobytes()
    at, count = flat.places(distinct, content)
    each = count[inverse]
    total = np.concatenate([[0], np.cumsum(each)])
    return flat.ids[ranges(at[inverse], each)], total[np.searchsorted(start, block.offsets)]


def decode(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each document's ids, without the space that encoding put first, and their offsets."""
    length = pieces.start[ids.astype(np.int64) + 1] - pieces.start[ids]
    data = pieces.data[ranges(pieces.start[ids], length)]
    bounds = np.concatenate([[0], np.cumsum(length)])[offsets]
    first = bounds[:-1][np.diff(bounds) > 0]
    return np.delete(data, first), bounds - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])


def sentencepiece(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text back), ids (binary; null unless asked for).

    Defined results: a null or empty text has no ids; the model reads U+2581 as a space, so
    a text with that character does not come back as it was and round_trip is false; rows
    without an id are left out; an empty table gives an empty table.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, flat = worker(path)
        for block in blocks(batches, "doc_id", "text", 1 << 20):
            found, offsets = encode(block, pieces, flat)
            back, bounds = decode(found, offsets, pieces)
            raw = [found[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            same = [back[bounds[i] : bounds[i + 1]].tobytes() == block.text(i) for i in range(len(block))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids, pa.int64()), "n_ids": pa.array(np.diff(offsets)), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()), "round_trip": pa.array(same, pa.bool_()), "ids": pa.array(raw if ids else [None] * len(block), pa.binary())})

    return arrow_map(documents(docs, key, text), run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids binary", "pieces")


def op6(spark, sf_dir: str) -> DataFrame:
    return sentencepiece(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
