"""Token ids of whole documents by a public word-level BPE, a word at a time.

The tokenizer drops white space and never joins across it, so a text's ids are its words'
ids one after the other. Each worker encodes a word when it first meets it and keeps the
ids in flat arrays; a text is then a NumPy gather.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .blocks import Block, Words, blocks, ranges
from .shared import kept

END = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Flat:
    """Ids by a 64-bit key, in sorted flat arrays; forgotten altogether past a bound of keys or of ids."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_000_000, most_ids: int = 8_000_000):
        self.encode, self.most, self.most_ids = encode, most, most_ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def places(self, keys: np.ndarray, content: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of each key; keys are sorted and distinct, content(i) gives the i-th one's bytes."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > self.most or len(self.ids) > self.most_ids:
                self.clear()
                new = np.arange(len(keys))
            each = []
            for lot in np.array_split(new, len(new) // 20_000 + 1):
                each += self.encode([content(i) for i in lot.tolist()])
            count = np.fromiter(map(len, each), np.int64, len(each))
            start = np.cumsum(count) - count + len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter((x for e in each for x in e), np.uint32, int(count.sum()))])
            order = np.argsort(all_keys := np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys = all_keys[order]
            self.start, self.count = np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]
            at = np.searchsorted(self.keys, keys)
        return self.start[at], self.count[at]


def word_bpe(path: str, special: bool = True) -> Flat:
    """This worker's tokenizer and the ids of the words it has met; with special, the tokenizer's special strings in a text are special tokens, as by default, else ordinary text."""

    def make() -> Flat:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        return Flat(lambda words: [x.ids for x in tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)])

    return kept(("word_bpe", path, special), make)


def folded(block: Block) -> Words:
    """Words with A-Z lower-cased, as the tokenizer does, but for those that may hold a special string, which it looks for before."""
    words = block.words(fold=True)
    at = np.flatnonzero((block.data[:-1] == ord("<")) & (block.data[1:] == ord("|")))
    if len(at):
        some = np.unique(np.searchsorted(words.start, at, "right") - 1)
        index = ranges(words.start[some], words.end[some] - words.start[some])
        words.data[index] = block.data[index]
    return words


def encoded(block: Block, flat: Flat, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, each document's followed by end, and where documents start."""
    words = folded(block)
    distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    start, count = flat.places(distinct, lambda i: words.bytes(first[i]))
    each = count[inverse]
    ids = flat.ids[ranges(start[inverse], each)]
    total = np.concatenate([[0], np.cumsum(each)])
    bounds = total[words.first]
    if end is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


def token_blocks(batches: Iterator[pa.RecordBatch], path: str, end: int | None = END, special: bool = True) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    flat = word_bpe(path, special)
    for block in blocks(batches, "doc_id", "text", 1 << 20):
        yield block, *encoded(block, flat, end)
