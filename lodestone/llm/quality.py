"""Quality rules as a short-circuit cascade.

Each rule rejects documents. On a sample, every rule's cost (seconds a document) and
selectivity (share rejected) are measured; rules then run in the order of rejections per
second among the documents that earlier rules left, and a document that one rule rejects
is not shown to the next. The order changes the work only, never the verdict.

Defined results: a null or empty text has no words, so it fails ``few_words``; very long
texts are read whole; equal rows get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Substrings, blocks, mix
from .shared import arrow_map, documents, filtered

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LETTER = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that start a code point
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """Counts of one block's documents, each worked out when first asked for."""

    def __init__(self, block: Block):
        self.block, self.known = block, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, name)()
        return self.known[name]

    def _bytes(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.block.offsets])

    def words(self):
        return self.block.words()

    def hashes(self):
        return self["words"].hashes()

    def n_words(self) -> np.ndarray:
        return self["words"].counts()

    def word_chars(self) -> np.ndarray:
        words = self["words"]
        total = np.zeros(len(self.block.data) + 1, np.int64)
        np.cumsum(FIRST[self.block.data], out=total[1:])
        each = np.zeros(len(words) + 1, np.int64)
        np.cumsum(total[words.end] - total[words.start], out=each[1:])
        return np.diff(each[words.first])

    def n_symbols(self) -> np.ndarray:
        return self._bytes(SYMBOLS[self.block.data])

    def n_exclaims(self) -> np.ndarray:
        return self._bytes(self.block.data == ord("!"))

    def n_upper(self) -> np.ndarray:
        return self._bytes(UPPER[self.block.data])

    def n_letters(self) -> np.ndarray:
        return self._bytes(LETTER[self.block.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line that has a word."""
        data, offsets = self.block.data, self.block.offsets
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        breaks = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
        start = start[start < len(data)]
        end = np.append(start[1:], len(data))
        end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10))
        words = self["words"]
        some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
        start, end = start[some], end[some]
        return start, end, np.searchsorted(offsets, start, "right") - 1

    def n_lines(self) -> np.ndarray:
        return np.bincount(self["lines"][2], minlength=len(self.block))

    def n_dup_lines(self) -> np.ndarray:
        start, end, doc = self["lines"]
        view = memoryview(self.block.data.tobytes())
        key = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
        _, first = np.unique(key ^ mix(doc.astype(np.uint64) * np.uint64(2) + np.uint64(1)), return_index=True)
        return self["n_lines"] - np.bincount(doc[first], minlength=len(self.block))

    def n_repeat_words(self, size: int = 5) -> np.ndarray:
        words, hashes = self["words"], self["hashes"]
        doc = words.doc()
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(len(self.block), np.int64)
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        key = Substrings(hashes).at(at, at + size) + mix(doc[at].astype(np.uint64) * np.uint64(2) + np.uint64(1))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + size, -1)
        return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=len(self.block))

    def n_adjacent(self) -> np.ndarray:
        """Words equal to the word before them."""
        words, hashes = self["words"], self["hashes"]
        doc = words.doc()
        same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        return np.bincount(doc[1:][same], minlength=len(self.block))


Rule = Callable[[Features], np.ndarray]

#: Rules of the default cascade; True rejects. The first two are the fixed base rules.
RULES: dict[str, Rule] = {
    "few_words": lambda f: f["n_words"] < 10,
    "repeated_words": lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"],
    "symbols": lambda f: 10 * f["n_symbols"] > f["n_words"],
    "exclamations": lambda f: 5 * f["n_exclaims"] > f["n_words"],
    "upper_case": lambda f: 10 * f["n_upper"] > 4 * f["n_letters"],
    "duplicate_lines": lambda f: 2 * f["n_dup_lines"] > f["n_lines"],
    "word_length": lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"]),
    "adjacent_words": lambda f: 10 * f["n_adjacent"] > 2 * f["n_words"],
}
BASE = ("few_words", "repeated_words")


def part(block: Block, keep: np.ndarray) -> Block:
    """The block's documents where keep is true."""
    length = np.diff(block.offsets)
    data = block.data[np.repeat(keep, length)]
    return Block(block.ids[keep], data, np.concatenate([[0], np.cumsum(length[keep])]))


def cascade(block: Block, order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """For each document, the place in order of the rule that rejects it, or -1."""
    verdict, alive, rest = np.full(len(block), -1), np.arange(len(block)), block
    features = Features(rest)
    for place, name in enumerate(order):
        if not len(alive):
            break
        out = rules[name](features)
        if out.any():
            verdict[alive[out]] = place
            alive = alive[~out]
            if out.mean() > 0.2:  # below that, making a smaller block costs more than it saves
                rest = part(rest, ~out)
                features = Features(rest)
            else:
                features.known = {k: v[~out] for k, v in features.known.items() if isinstance(v, np.ndarray) and len(v) == len(out) and k not in ("hashes",)}
                rest = part(rest, ~out)
                features.block = rest
    return verdict


def plan(sample: list[Block], rules: dict[str, Rule]) -> list[str]:
    """Rules by rejections per second among documents still alive, greedily, on the sample."""
    order, left = [], dict(rules)
    while left:
        best, rate, best_blocks = None, -1.0, sample
        for name, rule in left.items():
            began, rejected = time.perf_counter(), 0
            kept = []
            for block in sample:
                out = rule(Features(block))
                rejected += int(out.sum())
                kept.append((block, out))
            cost = time.perf_counter() - began
            if (now := rejected / max(cost, 1e-9)) > rate:
                best, rate, best_blocks = name, now, kept
        order.append(best)
        left.pop(best)
        sample = [part(b, ~out) for b, out in best_blocks]
        if not sum(map(len, sample)):
            return order + [x for x in rules if x in left]
    return order


def sampled(docs: DataFrame, rows: int, seed: int = 7) -> list[Block]:
    """At most rows documents from all over the table, for estimates only."""
    total = docs.count()
    if not total:
        return []
    taken = docs.sample(False, min(1.0, 1.5 * rows / total), seed).limit(rows).toArrow()
    return list(blocks(iter(taken.to_batches()), "doc_id", "text"))


def quality_cascade(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = 400, metrics: bool = False) -> DataFrame:
    """doc_id, kept (no rule rejects), base_failed; with metrics also METRICS, counted for every document.

    sample_rows bounds the documents on which the order of the rules is estimated. Without
    metrics, a rejected document costs nothing more. Defined results: a null or empty text has
    no words, so it fails ``few_words``; rows without an id are left out; very long texts are read
    whole; equal rows get equal verdicts; an empty table gives an empty table.
    """
    rules = RULES if rules is None else rules
    docs = documents(docs, key, text)
    order = plan(sampled(docs, sample_rows), rules)
    order += [x for x in rules if x not in order]
    base = [order.index(x) for x in BASE if x in order]
    schema = "doc_id long, " + "".join(f"{m} long, " for m in METRICS) * metrics + "base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "doc_id", "text"):
            verdict = cascade(block, order, rules)
            columns = {"doc_id": pa.array(block.ids, pa.int64())}
            if metrics:
                features = Features(block)
                columns |= {m: pa.array(features[m], pa.int64()) for m in METRICS}
                failed = np.logical_or.reduce([rules[x](features) for x in BASE if x in rules] or [np.zeros(len(block), bool)])
            else:
                failed = np.isin(verdict, base)
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array((verdict < 0) & ~failed)})

    return arrow_map(docs, judge, schema)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = 400) -> DataFrame:
    """The rows of docs that pass the cascade, with all their columns; no shuffle.

    Defined results: null and empty texts have no words and fail the rule on their number; rows without an id are
    judged like others; repeated rows are each judged; very long texts are read whole; an empty
    table gives an empty table; no other column is looked at.
    """
    rules = RULES if rules is None else rules
    order = plan(sampled(documents(docs, key, text), sample_rows), rules)
    order += [x for x in rules if x not in order]
    return filtered(docs, text, lambda block: cascade(block, order, rules) < 0)


def op9(spark, sf_dir: str) -> DataFrame:
    return quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"), metrics=True).select("doc_id", *METRICS, F.col("base_failed"), F.col("kept"))
