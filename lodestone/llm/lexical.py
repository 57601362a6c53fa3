"""Ranked lexical search: all items' scores of a block of documents at once, common parts computed once.

A score is a sum over terms, so term sets that several items share are sums they share.
Terms that the same items hold are one class; a class's accumulator (a number for each document of
a block) is made once. Items, as sequences of classes in one order, are then rewritten by the pairs of
neighbours that two or more of them hold, again and again: each pair is a node of the query-sharing
DAG, added up once for all items above it. A task keeps each item's best documents only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, Words, blocks, named
from .shared import arrow_map, documents, table

#: Bytes between terms: ASCII that is no letter or digit.
BETWEEN = np.zeros(256, bool)
BETWEEN[:0x80] = [not chr(b).isalnum() for b in range(0x80)]
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers that a block's accumulators hold at most, unless one document has more.
CELLS = 1 << 21


def shared_pairs(sequences: list[list[int]], first: int) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
    """Sequences rewritten, and layers of pairs of nodes, numbered from first: each layer's nodes need earlier ones only.

    In each round, the neighbours that most sequences hold become one node, then those that
    don't overlap with them, until no pair is held twice. Linear in the sequences' length a round.
    """
    layers = []
    while True:
        held = Counter(p for s in sequences for p in set(zip(s, s[1:], strict=False)))
        taken: set[int] = set()
        chosen: dict[tuple[int, int], int] = {}
        for pair, n in sorted(held.items(), key=lambda x: (-x[1], x[0])):
            if n > 1 and not taken & set(pair):
                chosen[pair] = first + len(chosen)
                taken |= set(pair)
        if not chosen:
            return sequences, layers
        first += len(chosen)
        layers.append(list(chosen))
        rewritten = []
        for s in sequences:
            out, i = [], 0
            while i < len(s):
                node = chosen.get((s[i], s[i + 1])) if i + 1 < len(s) else None
                out.append(s[i] if node is None else node)
                i += 1 if node is None else 2
            rewritten.append(out)
        sequences = rewritten


class Program:
    """What a lot of items asks: terms, their classes, the DAG over classes, and the nodes of each item."""

    def __init__(self, classes: list[tuple[list[int], list[str]]]):
        """classes: the items that hold a set of terms, and those terms."""
        classes = sorted(classes, key=lambda c: (-len(c[0]), c[1]))
        self.terms = [t for _, terms in classes for t in terms]
        self.of = np.repeat(np.arange(len(classes)), [len(terms) for _, terms in classes])
        self.items = sorted({i for items, _ in classes for i in items})
        place, sequences = {i: k for k, i in enumerate(self.items)}, [[] for _ in self.items]
        for k, (items, _) in enumerate(classes):
            for i in items:
                sequences[place[i]].append(k)
        self.classes = len(classes)
        sequences, layers = shared_pairs(sequences, self.classes)
        self.layers = [np.array(layer).T for layer in layers]
        self.nodes = self.classes + sum(map(len, layers))
        self.flat = np.array([x for s in sequences for x in s], np.int64)
        self.starts = np.cumsum([0, *map(len, sequences)])[:-1]
        encoded = [t.encode() for t in self.terms]
        ends = np.cumsum([0, *map(len, encoded)])
        hashes = named(np.frombuffer(b"".join(encoded), np.uint8), ends[:-1], ends[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The places of words that are terms, and which."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == hashes)
        return place, self.order[at[place]]

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """Items by documents, from the parts that terms (ascending in each document) add to documents (ascending)."""
        totals = np.zeros((self.nodes, docs), np.int64)
        if len(doc):
            cell = self.of[term] * docs + doc
            new = np.flatnonzero(np.diff(cell, prepend=-1))
            totals.reshape(-1)[cell[new]] = np.add.reduceat(part, new)
        at = self.classes
        for left, right in self.layers:
            totals[at : at + len(left)] = totals[left] + totals[right]
            at += len(left)
        return np.add.reduceat(totals[self.flat], self.starts, axis=0)


def _words(block) -> Words:
    return Words(LOWER[block.data], block.offsets, BETWEEN)


def _counted(block, program: Program) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each document, and document, term and frequency of the program's terms."""
    words = _words(block)
    place, term = program.found(words)
    pairs, tf = np.unique(words.doc()[place] * len(program.terms) + term, return_counts=True)
    return words.counts(), pairs // len(program.terms), pairs % len(program.terms), tf


class Best:
    """The k best documents of each item so far; equal scores by smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = np.zeros((3, 0), np.int64)  # item, document, score
        self.new: list[np.ndarray] = []

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.new.append(np.stack([item, ids[doc], scores[item, doc]]))
        if sum(x.shape[1] for x in self.new) > 4 * self.k * len(self.least):
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.new], axis=1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows, self.new = rows[:, rank < self.k], []
        full = rows[:, rank == self.k - 1]
        self.least[full[0]] = full[2]
        return self.rows


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _lot(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The result for one lot of items: asked has item, term."""
    held = asked.groupBy("term").agg(F.array_sort(F.collect_set("item")).alias("items"))
    program = Program([(r["items"], sorted(r["terms"])) for r in held.groupBy("items").agg(F.collect_list("term").alias("terms")).collect()])
    nothing = docs.sparkSession.createDataFrame([], "item long, part long, doc_id long, score long")
    terms = len(program.terms)
    if not terms:
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)  # documents with each term, documents with any, terms
        for block in blocks(batches, "doc_id", "text"):
            n, _, term, _ = _counted(block, program)
            total[:terms] += np.bincount(term, minlength=terms)
            total[terms:] += (np.count_nonzero(n), n.sum())
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(terms + 2)), "n": pa.array(total)})

    stats = {r["at"]: r["n"] for r in arrow_map(docs, count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    number, length = stats.get(terms, 0), stats.get(terms + 1, 0)
    if not number:
        return nothing
    weights = np.array([weight(number, stats[t]) for t in range(terms)], np.int64)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wide = Best(len(program.items), k), max(1, CELLS // max(program.nodes, len(program.flat)))
        for block in blocks(batches, "doc_id", "text"):
            n, doc, term, tf = _counted(block, program)
            m = np.array([50 + 50 * x * number // length for x in n.tolist()], np.int64)
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            for lo in range(0, len(block), wide):
                hi = min(lo + wide, len(block))
                a, b = np.searchsorted(doc, [lo, hi])
                best.add(block.ids[lo:hi], program.scores(doc[a:b] - lo, term[a:b], part[a:b], hi - lo))
        item, doc, score = best.cut()
        task = np.full(len(item), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pydict({"item": pa.array(np.array(program.items, np.int64)[item]), "part": pa.array(task), "doc_id": pa.array(doc), "score": pa.array(score)})

    return arrow_map(docs, rank, "item long, part long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_items: int = 2048) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.
    Statistics are of all documents. Items are asked in lots of about ``most_items``, each of
    which reads the documents twice, so a program's size is bounded; no item or document is left out.

    Defined results: null and empty texts hold no term and are in no result; items of equal id are one
    item with the terms of all; rows without an id, of both tables, are left out and not
    counted; repeated documents are each counted and ranked, the same document then has several
    ranks; empty tables give an empty table. Very long texts are read whole. Terms are told apart by 64-bit names.
    """
    docs = documents(docs, key, text)
    terms = F.explode(F.array_distinct(F.expr(f"regexp_extract_all(translate(item_text, '{UPPER}', '{SMALL}'), '{PATTERN.replace(chr(92), chr(92) * 2)}', 0)")))
    asked = table(items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).cast("string").alias("item_text")).where("item is not null").select("item", terms.alias("term")).distinct())
    lots = max(1, math.ceil(asked.select("item").distinct().count() / most_items))
    found = None
    for lot in range(lots):
        part = _lot(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == lot), k)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.col("doc_id")]
    # the best of 256 tasks first, so that an item's last sort stays small however many tasks there are
    some = found.withColumn("part", F.shiftright("part", 8)).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; nulls, ties and repeats as in ``ranked``."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
