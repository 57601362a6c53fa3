"""Language-model scores by a weighted backoff automaton of words, pairs and triples of words.

The root has an arc for every known word; every known word and every known pair of words is
a state. A state has arcs for the words seen after it and a failure arc to the state of its
history without the oldest word (the root, at last). With c the counts, t_n the strength of order n:

* An arc of state h for word w weighs (c(hw) + t_n P(w | h')) / (c(h) + t_n), h' being what h's
  failure arc leads to, and the failure arc t_n / (c(h) + t_n) (Dirichlet smoothing).
* The root's arcs weigh P(w) = (c(w) - d) / N, and one arc for all unknown words d V / N
  (absolute discounting, d from the numbers of words seen once and twice).

A document begins in the state of the end token and is traversed once from left to right: a
word takes its arc, or failure arcs until a state has one, and log-weights add up. The state
carried on is that of the longest known history. The documents of a block take their
steps together.

The counts grow with the corpus, so no worker holds the whole automaton. Documents form
blocks; a block asks for the counts of its own words, pairs and triples (hashes, sorted, dealt
out in slices of the hash range); each slice adds up what all blocks learned and answers
every block; a block's answers are its part of the automaton. A slice covers a fixed
volume of text, and a block sends nothing to a slice where it has no key, so requests
grow in proportion to the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, mix
from .shared import arrow_map, documents, table

END_HASH = np.uint64(0x9E3779B97F4A7C15)
TOKENS = 1_500_000  # of a block
BYTES_PER_SLICE = 1 << 23


def grams(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The hash of each token, of it with the one before it, and with the two before it; documents begin after an end token."""
    out = [tokens]
    for _ in range(2):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[first[:-1]] = END_HASH
        out.append(mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens))
    return out


class Corpus:
    """Consecutive documents' token hashes, each document's followed by the end token."""

    def __init__(self, ids: np.ndarray, learn: np.ndarray, tokens: np.ndarray, first: np.ndarray):
        self.ids, self.learn, self.tokens, self.first = ids, learn, tokens, first

    @property
    def name(self) -> int:
        """The same for the same ids and tokens, whichever task reads them."""
        turn = lambda x: (x.astype(np.uint64) * (2 * np.arange(len(x), dtype=np.uint64) + np.uint64(1))).sum()
        x = np.array([turn(mix(self.ids.astype(np.uint64))), turn(self.tokens), turn(mix(self.first.astype(np.uint64)))], np.uint64)
        return int(mix(np.cumsum(mix(x)))[-1] >> np.uint64(1))


def corpora(batches: Iterator[pa.RecordBatch], learned: Callable[[int], bool]) -> Iterator[Corpus]:
    ids, tokens, lengths, held = [], [], [], 0

    def made() -> Corpus:
        every = np.concatenate(ids)
        return Corpus(every, np.array([learned(x) for x in every.tolist()], bool), np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))

    for block in blocks(batches, "doc_id", "text", 1 << 20):
        words = block.words(fold=True)
        new = np.insert(words.hashes(), words.first[1:], END_HASH)
        ids.append(block.ids), tokens.append(new), lengths.append(words.counts() + 1)
        if (held := held + len(new)) > TOKENS:
            yield made()
            ids, tokens, lengths, held = [], [], [], 0
    if ids:
        yield made()


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Unsigned integers of width bytes by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpacked(raw: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)), 8)


def keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, 8), dtype=np.uint64)


REQUEST = "slice int, block long, kind int, keys binary, learned binary"
ANSWER = "block long, kind int, slice int, counts binary, total long, distinct long, once long, twice long"


@dataclass
class Totals:
    tokens: int
    words: int
    discount: float


class Automaton:
    """A block's part of the automaton: for the arcs that its words can take, their weights.

    counts and inverse hold, for words, pairs and triples, the counts and which of them stands
    at each position.
    """

    def __init__(self, corpus: Corpus, counts: list[np.ndarray], inverse: list[np.ndarray], totals: Totals, strengths: tuple[float, float]):
        self.first = corpus.first
        word, pair, triple = (c[i].astype(float) for c, i in zip(counts, inverse, strict=True))
        end = word[corpus.first[1:] - 1]  # every document ends with the end token, and begins after one
        self.first_state = (end > 0).astype(np.int8)
        before, pair_before = (np.concatenate([[0.0], x[:-1]]) for x in (word, pair))
        before[corpus.first[:-1]] = end
        root = np.where(word > 0, (word - totals.discount) / totals.tokens, totals.discount * totals.words / totals.tokens)
        fail = [strengths[0] / (before + strengths[0]), strengths[1] / (pair_before + strengths[1])]
        low = np.where(pair > 0, (pair + strengths[0] * root) / (before + strengths[0]), fail[0] * root)
        high = (triple + strengths[1] * low) / (pair_before + strengths[1])
        #: Log-weights at each position: of the word's arc from the root, a word's state and a pair's state; of the failure arcs of the latter two.
        self.arc, self.fail = [np.log10(root), np.log10(low), np.log10(high)], [np.zeros(len(word)), *map(np.log10, fail)]
        self.has = [np.ones(len(word), bool), pair > 0, triple > 0]
        self.known, self.known_pair = word > 0, pair > 0

    def traverse(self) -> np.ndarray:
        """The sum of each document's log-weights; states are told by the length of their history."""
        length = np.diff(self.first)
        order = np.argsort(-length, kind="stable")
        start = self.first[:-1][order]
        ascending = np.sort(length)
        state, total = self.first_state[order].copy(), np.zeros(len(length))
        for step in range(int(length.max(initial=0))):
            alive = len(length) - int(np.searchsorted(ascending, step, "right"))
            at, now = start[:alive] + step, state[:alive]
            for n in (2, 1):  # failure arcs, from states that have no arc for the word
                lost = (now == n) & ~self.has[n][at]
                if lost.any():
                    total[:alive][lost] += self.fail[n][at[lost]]
                    now[lost] = n - 1
            total[:alive] += np.choose(now, [x[at] for x in self.arc])
            # the longest known history that this word ends; a document's first word has the end token before it
            now[:] = np.where(self.known_pair[at], 2, self.known[at])
        out = np.empty(len(length))
        out[order] = total
        return out


def score_block(corpus: Corpus, counts: list[np.ndarray], inverse: list[np.ndarray], totals: Totals, strengths: tuple[float, float]) -> dict[str, np.ndarray]:
    """What the query reports of each document."""
    n, v = totals.tokens, totals.words
    own = counts[0][inverse[0]].astype(float)
    add = lambda x: np.add.reduceat(x, corpus.first[:-1])
    base = add(np.log10((own + 0.5) / (n + 0.5 * (v + 1))))
    score = Automaton(corpus, counts, inverse, totals, strengths).traverse() if n else base
    return {"n_tokens": np.diff(corpus.first), "n_known": add((own > 0).astype(np.int64)), "base_score": base, "score": score}


def lm_scores(docs: DataFrame, learned: Callable[[int], bool], key: str = "doc_id", text: str = "text", strengths: tuple[float, float] = (30.0, 10.0)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Counts are taken over all documents for whose id learned is true; strengths are those of
    pairs and triples. The table is read twice and must give its rows in one order: else the job
    fails, it never scores with wrong counts. Defined results: a null or
    empty text is its end token alone; without any training document nothing is known and
    score equals base_score; very long texts are traversed whole; repeated rows count and are scored each; rows without an id are
    left out; an empty table gives an empty table.
    """
    docs = documents(docs, key, text)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(volume // BYTES_PER_SLICE).bit_length())

    def split(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for corpus in corpora(batches, learned):
            learn = np.repeat(corpus.learn, np.diff(corpus.first))
            for kind, tokens in enumerate(grams(corpus.tokens, corpus.first)):
                keys, inverse = np.unique(tokens, return_inverse=True)
                count = np.bincount(inverse[learn], minlength=len(keys)).astype("<u4")
                cut = split(keys)
                some = [s for s in range(1 << bits) if cut[s + 1] > cut[s]]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(some, pa.int32()), "block": pa.array([corpus.name] * len(some), pa.int64()), "kind": pa.array([kind] * len(some), pa.int32()),
                    "keys": pa.array([steps(keys[cut[s] : cut[s + 1]]) for s in some], pa.binary()), "learned": pa.array([packed(count[cut[s] : cut[s + 1]]) for s in some], pa.binary()),
                })

    def answer(rows: pa.Table) -> pa.Table:
        keys = [keys_of(x.as_py()) for x in rows.column("keys")]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpacked(x.as_py()) for x in rows.column("learned")]), len(every)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
        found = total[inverse]
        stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        first = lambda x: [x] + [0] * (len(keys) - 1)  # noqa: E731  a slice's figures stand in its first row
        return pa.table({"block": rows.column("block"), "kind": rows.column("kind"), "slice": rows.column("slice"), "counts": pa.array([packed(found[a:b], 8) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())} | {n: pa.array(first(x), pa.int64()) for n, x in zip(("total", "distinct", "once", "twice"), stats, strict=True)})

    answers = table(arrow_map(docs, ask, REQUEST).groupBy("slice", "kind").applyInArrow(answer, ANSWER))
    n, v, once, twice = answers.where("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "once", "twice"))).first()
    totals = Totals(n, v, min(max(once / max(once + 2 * twice, 1), 0.1), 0.9))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for corpus in corpora(batches, learned):
            keys, inverse = np.unique(corpus.tokens, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"block": pa.array([corpus.name], pa.int64()), "ids": pa.array([corpus.ids.astype("<i8").tobytes()], pa.binary()), "learn": pa.array([np.packbits(corpus.learn).tobytes()], pa.binary()), "lengths": pa.array([packed(np.diff(corpus.first))], pa.binary()), "words": pa.array([keys.tobytes()], pa.binary()), "tokens": pa.array([packed(inverse)], pa.binary())})

    def traverse(block: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by([("kind", "ascending"), ("slice", "ascending")])
        kinds = given.column("kind").to_numpy()
        # equal blocks, from repeated rows, get equal answers: one of each will do
        key = np.stack([kinds, given.column("slice").to_numpy()])
        one = np.ones(len(kinds), bool)
        one[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        given, kinds = given.filter(pa.array(one)), kinds[one]
        every = [unpacked(x.as_py(), 8) for x in given.column("counts")]
        counts = [np.concatenate([x for x, k in zip(every, kinds, strict=True) if k == kind] or [np.zeros(0, np.uint64)]) for kind in (0, 1, 2)]
        out = []
        for row in range(block.num_rows):  # one, unless rows repeat
            get = lambda c: block.column(c)[row].as_py()  # noqa: B023, E731
            ids = np.frombuffer(get("ids"), "<i8")
            first = np.concatenate([[0], np.cumsum(unpacked(get("lengths")).astype(np.int64))])
            inverse = unpacked(get("tokens"))
            tokens = np.frombuffer(get("words"), np.uint64)[inverse]
            corpus = Corpus(ids, np.unpackbits(np.frombuffer(get("learn"), np.uint8), count=len(ids)).astype(bool), tokens, first)
            places = [inverse, *(np.unique(x, return_inverse=True)[1] for x in grams(tokens, first)[1:])]
            if any(int(p.max()) >= len(c) for p, c in zip(places, counts, strict=True)):
                raise RuntimeError("a block's counts are missing: its documents were read in another order")
            out.append(pa.table({"doc_id": pa.array(ids), "held_out": pa.array(~corpus.learn), "train_tokens": pa.array(np.full(len(ids), n), pa.int64())} | {k: pa.array(x) for k, x in score_block(corpus, counts, places, totals, strengths).items()}))
        return pa.concat_tables(out).select(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]) if out else SCORED_EMPTY

    held = arrow_map(docs, hold, "block long, ids binary, learn binary, lengths binary, words binary, tokens binary")
    return held.groupBy("block").cogroup(answers.select("block", "kind", "slice", "counts").groupBy("block")).applyInArrow(traverse, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


def every_fifth_left_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


def op5(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), every_fifth_left_out)
