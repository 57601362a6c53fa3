"""Toxicity by compression distance.

Two zstandard dictionaries hold ordinary and toxic text. A window of text that the toxic
dictionary compresses much better than the ordinary one speaks for toxicity. Windows are
single words (very long ones in pieces), since a few words among hundreds make a text toxic;
each distinct word is compressed once per worker.

A short word hardly shows in a compressed length: a match costs three or four bytes, as
much as the letters. So every byte is spelled as a fixed four-byte code first. The length
then counts how many dictionary matches make up the window, which is the distance wanted.

What the dictionaries hold is chosen by counts over the labelled sample, not by zstandard's
own trainer, whose dictionaries gave worse results (README has the figures):

* The ordinary one holds the words that most ordinary texts have.
* The toxic one holds those too, and after them the words that set toxic texts apart:
  frequent among them, after many different neighbours (copies of one passage don't
  count), and rare in ordinary texts.

A document's features are its best window's relative gain, its best excess of the ordinary
length over twice the toxic length, and how many windows gain clearly. A logistic fit on
labelled documents calibrates them to a score, moved so that 0.3 is the cut with the best
F1 on those documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .shared import arrow_map, documents, filtered, kept, partitions, table

_CODES = [bytes(code) for code in np.random.Generator(np.random.PCG64(9)).integers(0, 256, (256, 4), dtype=np.uint8)]
_WORD = r"[^\x20\x09-\x0D]+"
PIECE = 48
CLEAR = 0.3  # a window's relative gain that counts as clear


def spelled(text: bytes) -> bytes:
    return b"".join([_CODES[b] for b in text])


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


class Windows:
    """Gains of distinct windows under one model, remembered up to a bound."""

    def __init__(self, model: Model, most: int = 400_000):
        # tables are sized by what a window can have; larger ones only cost time
        params = zstandard.ZstdCompressionParameters.from_level(19, source_size=8 * PIECE, dict_size=4 * len(model.toxic), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        make = lambda text: zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(spelled(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
        self.ordinary, self.toxic = make(model.ordinary), make(model.toxic)
        self.known: dict[int, tuple[float, float]] = {}
        self.most = most

    def gain(self, word: bytes) -> tuple[float, float]:
        best = (-1.0, -1e9)
        for at in range(0, len(word), PIECE):
            window = spelled(b" " + word[at : at + PIECE] + b" ")
            a, b = len(self.ordinary(window)), len(self.toxic(window))
            best = (max(best[0], (a - b) / a), max(best[1], float(a - 2 * b)))
        return best

    def features(self, block: Block) -> np.ndarray:
        words = block.words(fold=True)
        distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.known.clear()
        values, known = np.empty((len(distinct), 2)), self.known
        for i, (h, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            found = known.get(h)
            if found is None:
                found = known[h] = self.gain(words.bytes(at))
            values[i] = found
        out = np.zeros((len(block), 3))
        out[:, 1] = -20.0
        some = words.counts() > 0
        if some.any():
            each, starts = values[inverse], words.first[:-1][some]
            out[some, 0] = np.maximum.reduceat(each[:, 0], starts)
            out[some, 1] = np.maximum.reduceat(each[:, 1], starts)
            out[some, 2] = np.log1p(np.add.reduceat((each[:, 0] >= CLEAR).astype(float), starts))
        return out


def score(model: Model, features: np.ndarray) -> np.ndarray:
    x = (features - np.array(model.centre)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights[1:]) + model.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge; both classes weigh the same."""
    x = np.hstack([np.ones((len(x), 1)), x])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) * 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + keep @ w
        hessian = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + keep + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(x: np.ndarray, y: np.ndarray, ordinary_share: float) -> float:
    """Where to cut x for the best F1, if ordinary texts are ordinary_share of all; midway between neighbours."""
    order = np.argsort(-x, kind="stable")
    x, y = x[order], y[order]
    weight = ordinary_share / (1 - ordinary_share) * y.sum() / max((~y).sum(), 1)
    hit, false = np.cumsum(y), np.cumsum(~y) * weight
    f1 = 2 * hit / (hit + false + y.sum())
    f1[:-1][x[:-1] == x[1:]] = -1  # equal values stay together
    at = int(np.argmax(f1))
    return float((x[at] + (x[at + 1] if at + 1 < len(x) else x[at] - 1)) / 2)


def dictionaries(sample: DataFrame, base_words: int = 1000) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of sample (doc_id, toxic, text with A-Z lower-cased); of equal texts the last by hash of id counts.

    Words are counted by Spark; only those of the dictionaries reach the driver.
    """
    last = sample.groupBy(F.sha2("text", 256)).agg(F.max_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("doc_id")).select("doc_id")
    one = sample.join(F.broadcast(last), "doc_id", "left_semi").select("toxic", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
    n = one.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    least = max(5, 0.008 * n[1])
    held = table(one.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("plain"), F.count_if(F.col("toxic") == 1).alias("docs")))
    likely = held.where(F.col("docs") >= least)
    pairs = one.where("toxic = 1").select(F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("before"), F.col("words").alias("word"))))
    beside = pairs.join(likely.select("word"), "word", "left_semi").distinct().groupBy("word").agg(F.count("before").alias("neighbours"))
    apart = (F.col("neighbours") >= least) & (F.col("plain") * n[1] <= F.lit(0.02) * F.col("docs") * max(n[0], 1))
    marks = sorted((r.docs, r.word.encode()) for r in likely.join(beside, "word").where(apart).select("docs", "word").collect())
    most = held.where("plain > 0").orderBy(F.desc("plain"), "word").limit(base_words).collect()
    base = b" " + b" ".join(r.word.encode() for r in most) + b" "
    return base, base + b" ".join(w for _, w in marks) + b" " * bool(marks)


def calibrated(model: Model, x: np.ndarray, toxic: np.ndarray, ordinary_share: float) -> Model:
    """model with weights learned from features x of labelled documents."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = logistic((x - centre) / scale, toxic.astype(float))
    w[0] += np.log(0.3 / 0.7) - best_cut(np.hstack([np.ones((len(x), 1)), (x - centre) / scale]) @ w, toxic, ordinary_share)
    return Model(model.ordinary, model.toxic, tuple(w), tuple(centre), tuple(scale))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = 1500, most_ordinary: int = 3000, most_bytes: int = 8 << 20, base_words: int = 1000, calibration: int = 1800) -> Model | None:
    """A model from a bounded sample of labelled documents.

    Of each class, those with the smallest hashes of their ids: at most most_toxic and most_ordinary
    documents, and as many whole texts as fit in most_bytes, those above an eighth of it last, so that a few very
    long texts don't take the place of all others. The ordinary dictionary holds
    base_words words; calibration bounds the documents that the score is calibrated on, about a third
    of them toxic. The sample is written once in the shared checkpoint folder; tasks count its words and
    compress its texts, and the driver gets the dictionaries' words and a row of features for each
    document of the calibration, but no text.

    Defined results: of several labels of an id the greater counts, and of several texts of an id one; null
    and empty texts are learned from as texts without words; labels that are neither 0 nor 1 and rows without an
    id are left out; None if one of the classes has no document. If a class has documents but
    none fits in most_bytes, a ValueError says so.
    """
    rows = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = rows.agg(F.avg((F.col("toxic") == 0).cast("double"))).first()[0]
    pick = lambda y, n: rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, most_toxic).unionByName(pick(0, most_ordinary))
    texts = documents(docs, key, text).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    sizes = table(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size")))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.col("size") > most_bytes // 8, F.xxhash64("doc_id"), "doc_id"))  # of the chosen few
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    fitting = sizes.where(F.col("size") <= most_bytes).withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "toxic", nth.alias("nth"))
    found = {r[0] for r in fitting.select("toxic").distinct().collect()}
    lost = {r[0] for r in sizes.select("toxic").distinct().collect()} - found
    if lost:
        raise ValueError(f"no document labelled {sorted(lost)} has a text of at most {most_bytes} bytes: raise most_bytes")
    if len(found) < 2:
        return None
    one = texts.join(F.broadcast(fitting), "doc_id").repartition(partitions(docs.sparkSession), "doc_id").groupBy("doc_id", "toxic", "nth").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    sample = table(one.withColumn("text", F.translate("text", ascii_uppercase, ascii_lowercase)))
    model = Model(*dictionaries(sample.select("doc_id", "toxic", "text"), base_words), (0.0,) * 4, (0.0,) * 3, (1.0,) * 3)
    third = calibration // 3
    place = F.when(F.col("toxic") == 1, F.col("nth")).otherwise(F.col("nth") + third)  # the toxic ones first

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "place", "text"):
            x = windows_of(model).features(block)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), *(pa.array(x[:, i]) for i in range(3))], ["place", "x0", "x1", "x2"])

    used = sample.where(F.col("nth") <= F.when(F.col("toxic") == 1, third).otherwise(calibration - third)).select(place.cast("long").alias("place"), "text")
    x = arrow_map(used, measure, "place long, x0 double, x1 double, x2 double", "toxicity").toArrow().sort_by("place")
    return calibrated(model, np.column_stack([x.column(f"x{i}") for i in range(3)]), x.column("place").to_numpy() <= third, min(max(share or 0.5, 0.01), 0.99))


def windows_of(model: Model) -> Windows:
    """This worker's windows under model; its weights don't matter to them."""
    return kept(("toxicity", model.ordinary, model.toxic), lambda: Windows(model))


def toxicity(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text.

    Defined results: a null or empty text, or one without words, has no windows and so a
    low score; without a model every score is 0; rows without an id are left out; equal
    texts score alike; an empty table gives an empty table.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "doc_id", "text"):
            value = np.zeros(len(block)) if model is None else score(model, windows_of(model).features(block))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids, pa.int64()), "score": pa.array(value)})

    return arrow_map(documents(docs, key, text), judge, "doc_id long, score double", "toxicity")


def fold(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns; no shuffle.

    Defined results: null and empty texts score low and stay; rows without an id are judged and kept like
    others; repeated rows are each judged; very long texts are read whole; without a model, as when labels
    lack a class, all rows stay; an empty table gives an empty table; no other column is looked at.
    """
    model = fit(docs, labels, text=text)

    def good(block: Block) -> np.ndarray:
        return np.ones(len(block), bool) if model is None else score(model, windows_of(model).features(block)) < threshold

    return filtered(docs, text, good, "toxicity")


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, fit(docs, labels, fold("doc_id", 4) != 2))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
