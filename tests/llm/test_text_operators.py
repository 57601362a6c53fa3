"""Operators over texts against brute-force versions on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import packing, pieces, quality, repeats, scoring, separators, simhash, tokens, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 90").collect()]
    rnd = random.Random(5)
    odd = [None, "", " \n\t ", "x" * 700, "x" * 70, "é" * 80, "aé" + "é" * 60, "Foo bar", "fOO BAR", "it's ΑΣ \u0085x y\x1cz <|endoftext|> don't'll Á #", "▁a ▁ b  c", "a b c d e " * 40, "\n\na\na\n a\n", found[3][1], found[3][1]]
    morse = ["".join("ab"[(i.bit_count() + k) & 1] for i in range(2048)) for k in (0, 1)]  # both have one polynomial hash modulo 2^64
    odd += ["\n".join(morse), " ".join([*morse, "and", morse[0]]), "a <|endoftext|> b x<|startoftext|>y <|ENDOFTEXT|> <| |>"]
    odd += ["".join(rnd.choice("ab ") for _ in range(rnd.choice([30, 49, 50, 51, 300]))) for _ in range(25)]
    return found + [(5000 + i, t) for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With null ids and extra columns whose names operators use inside."""
    df = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").repartition(5)
    return df.withColumn("lo", F.lit(1)).withColumn("doc", F.lit("x")).withColumn("n", F.lit(None).cast("string")).withColumn("component_id", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def brute_repeats(rows, unit, size):
    units = {d: (t or "").encode() if unit == "bytes" else re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in rows}
    first, out = {}, {}
    key = bytes if unit == "bytes" else tuple
    for d in sorted(units):
        for p in range(len(units[d]) - size + 1):
            first.setdefault(key(units[d][p : p + size]), d)
    for d, u in units.items():
        gone = [False] * len(u)
        for p in range(len(u) - size + 1):
            if first[key(u[p : p + size])] < d:
                gone[p : p + size] = [True] * size
        left = [c for c, g in zip(u, gone) if not g]
        kept = bytes(left) if unit == "bytes" else b" ".join(left)
        out[d] = (len(u), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("unit", "size", "k"), [("bytes", 50, None), ("bytes", 10, None), ("words", 50, 8), ("words", 4, 1)])
def test_repeats(rows, docs, unit, size, k, monkeypatch):
    if size == 10:  # chunk edges in the midst of documents
        monkeypatch.setattr(repeats, "CHUNK", 1000)
    got = repeats.remove_repeats(docs, unit=unit, size=size, k=k).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.h) for r in got} == brute_repeats(rows, unit, size)


def test_prefix_doubling(spark, rows):
    from lodestone.llm.suffixes import repeated_by_doubling

    first, want = {}, set()
    for d, t in sorted(rows):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], d) < d:
                want.add((d, p))
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").repartition(3)
    got = [(r.doc, r.lo) for r in repeated_by_doubling(docs).collect()]
    assert set(got) == want and len(got) == len(want) > 1000


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_windows_that_share_a_half(spark, unit):
    """Two windows with an equal first half, and second halves whose hashes agree in 32 bits, are not equal."""
    rnd = np.random.default_rng(7)
    names = 200_000
    if unit == "bytes":  # 25 bytes that both documents start with, then 25 that differ
        k, letters = 24, rnd.integers(97, 123, (names, 25), dtype=np.uint8)
        texts = [x.tobytes().decode() for x in letters]
        joined = np.frombuffer("".join(texts).encode(), np.uint8)
        starts = [rnd.integers(97, 123, 25, dtype=np.uint8).tobytes().decode() for _ in range(3000)]
        hashes = repeats.Substrings(np.frombuffer("".join(starts).encode(), np.uint8), 0)
    else:
        k, letters = 24, rnd.integers(0, 1000, (names, 25))
        texts = [" " + " ".join(map(str, x)) for x in letters.tolist()]
        words = lambda t: repeats.Block(np.array([1]), (data := np.frombuffer("".join(t).encode(), np.uint8)), np.array([0, len(data)])).words()
        joined = words(texts).hashes(1)
        starts = [" " + " ".join(map(str, x)) for x in rnd.integers(0, 1000, (3000, 25)).tolist()]
        hashes = repeats.Substrings(words(starts).hashes(0), 0)
    at = np.arange(0, 25 * names, 25)
    high = repeats.Substrings(joined, 1).at(at, at + 25) >> np.uint64(32)
    order = np.argsort(high)
    same = np.flatnonzero(high[order][1:] == high[order][:-1])
    assert len(same)
    one, two = texts[order[same[0]]], texts[order[same[0] + 1]]
    at = np.arange(0, 25 * 3000, 25)
    prefix = starts[int(hashes.at(at, at + k).argmin())]  # so low that both windows have their anchor in it
    docs = spark.createDataFrame([(1, prefix + one), (2, prefix + two), (3, prefix + one)], "doc_id long, text string")
    got = repeats.remove_repeats(docs, unit=unit, size=50, k=k).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 50)]


def test_runs_do_not_depend_on_chunks(rows, monkeypatch):
    """Windows near chunk edges fall into other runs, but every window is in one run."""
    text = rows[5][1].encode() * 2
    block = repeats.Block(np.array([1]), np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for chunk in (1 << 18, 100, 7):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        _, _, _, lo, n = repeats.gathered(repeats.Units(block, "bytes"), 50, 24)
        assert sorted(x for a, b in zip(lo, n) for x in range(a, a + b)) == list(range(len(text) - 49))


def test_results_do_not_depend_on_the_sketch(rows, docs):
    """With far too few slots the filter lets more through, and results stay the same."""
    got = repeats.remove_repeats(docs, unit="words", size=50, k=8, most_slots=1 << 16).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.h) for r in got} == brute_repeats(rows, "words", 50)


def test_sketch_loses_none():
    keys = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(repeats.ROWS * (1 << 16) // 8, np.uint8)
    flags = np.zeros(repeats.ROWS << 16, bool)
    for place in repeats.Sketch.places(keys[:100], 1 << 16):
        flags[place] = True
    bits = np.packbits(flags, bitorder="little")
    assert repeats.Sketch(1 << 16, bits).repeated(keys[:100]).all()


def test_cut_repeats_keeps_columns(spark, rows):
    from lodestone.llm.suffixes import cut_repeats

    df = spark.createDataFrame([(d, t, "en", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, n_chars long")
    out = cut_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) and "�" not in r.text for r in got.values())
    assert got[5014].text == "" and got[3].text


def brute_simhash(rows, shingle=3, radius=3):
    prints = {}
    for d, t in rows:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in prints}


@pytest.mark.parametrize("shingle", [3, 5])
def test_simhash(rows, docs, shingle):
    got = simhash.simhash_classes(docs, shingle=shingle).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute_simhash(rows, shingle)


def test_balls_meet(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 25, dtype=np.uint64)
    every = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(20):
            y = x
            for k in rnd.choice(64, rnd.integers(1, 6), replace=False):
                y ^= 1 << int(k)
            every.add(y)
    values = np.array(sorted(every), np.uint64).view(np.int64)
    near = np.bitwise_count(values[:, None].view(np.uint64) ^ values[None, :].view(np.uint64)) <= 3
    made = simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in values], "print long"), tile=8))
    got = {r.node: r.component for r in made.collect()}
    label = np.arange(len(values))
    for _ in range(len(values)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    same = lambda f: {frozenset(np.flatnonzero(np.array([f(i) == f(j) for j in range(len(values))]))) for i in range(len(values))}
    assert same(lambda i: label[i]) == same(lambda i: got.get(int(values[i]), int(values[i])))


def test_components_of_paths_and_stars(spark):
    from lodestone.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_metrics(rows, docs):
    got = {r.doc_id: r for r in quality.quality_cascade(docs, metrics=True).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, lines, seen, dup = WORD.findall(t or ""), (t or "").split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, hit = collections.Counter(windows), [False] * len(w)
        for i, x in enumerate(windows):
            if count[x] > 1:
                hit[i : i + 5] = [True] * 5
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(hit))
        assert r.base_failed == (len(w) < 10 or 100 * sum(hit) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_cascade_order_changes_nothing(docs):
    block = quality.sampled(docs.select("doc_id", "text").where("doc_id is not null"), 10_000)
    names = list(quality.RULES)
    for b in block:
        one, two = quality.cascade(b, names, quality.RULES) < 0, quality.cascade(b, names[::-1], quality.RULES) < 0
        assert (one == two).all()
        assert (one == ~np.logical_or.reduce([r(quality.Features(b)) for r in quality.RULES.values()])).all()
    assert sorted(quality.plan(block, quality.RULES)) == sorted(names)


def test_quality_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality.op9(spark, "/root/testdata/sf0.01").collect()
    judged = [(labels[r.doc_id], r.kept) for r in got if r.doc_id in labels and not r.base_failed]
    assert sum(q == k for q, k in judged) / len(judged) > 0.98


def test_toxicity_held_out(spark, empty):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 4) != 2)
    held = docs.join(labels.where(toxicity.fold("doc_id", 4) == 2).select("doc_id", "toxic"), "doc_id")
    truth = {r.doc_id: r.toxic for r in held.select("doc_id", "toxic").collect()}
    got = {r.doc_id: r.score for r in toxicity.toxicity(held, model).collect()}
    hit = sum(got[d] >= 0.3 and y for d, y in truth.items())
    assert hit / sum(truth.values()) > 0.75 and hit / sum(s >= 0.3 for s in got.values()) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "z" * 5000)], "doc_id long, text string")
    assert all(0 <= r.score < 0.3 for r in toxicity.toxicity(odd, model).collect())
    assert {r.score for r in toxicity.toxicity(odd, None).collect()} == {0.0}
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None


def test_scores(rows, docs):
    got = {r.doc_id: r for r in scoring.lm_scores(docs, scoring.every_fifth_left_out, strengths=(30.0, 4.0)).collect()}
    tokens_ = {d: re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())) + ["end"] for d, t in rows}
    c, n_of = collections.Counter(), [collections.Counter() for _ in range(4)]
    for d, ts in tokens_.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(ts)
            line = ["end", *ts]
            for k in (2, 3):
                n_of[k].update(tuple(line[i : i + k]) for i in range(len(line) - k + 1))
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    dis = min(max(once / (once + 2 * twice), 0.1), 0.9)

    # the automaton as dictionaries: states by their history, arcs and failure arcs with their weights
    def chance(history, w):
        if not history:
            return (c[w] - dis) / n if c[w] else dis * v / n
        seen = c[history[0]] if len(history) == 1 else n_of[2][history]
        t = (30.0, 4.0)[len(history) - 1]
        return (n_of[len(history) + 1][(*history, w)] + t * chance(history[1:], w)) / (seen + t)

    def walk(ts):
        state, total = ("end",), 0.0
        for w in ts:
            history = state
            while state and not n_of[len(state) + 1][(*state, w)]:
                t = (30.0, 4.0)[len(state) - 1]
                total += math.log10(t / ((c[state[0]] if len(state) == 1 else n_of[2][state]) + t))
                state = state[1:]
            total += math.log10(chance(state, w))
            state = (*history, w)[-2:]
            while state and not (n_of[2][state] if len(state) == 2 else c[state[0]]):
                state = state[1:]
        return total

    for d, ts in tokens_.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(c[t] > 0 for t in ts), n, zlib.crc32(str(d).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert math.isclose(r.score, walk(ts), rel_tol=1e-9)
    # every state's arcs and failure arc spend exactly its probability
    for history in [("end",), *random.Random(2).sample(sorted(k for k in n_of[2] if "end" not in k), 3)]:
        assert math.isclose(sum(chance(history, w) for w in c) + chance(history, "unknown word"), 1, rel_tol=1e-9)


def test_repeated_rows_score_alike(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    got = scoring.lm_scores(df.union(df).repartition(3), lambda d: True).collect()
    assert len(got) == 4 and len({(r.doc_id, round(r.score, 9)) for r in got}) == 2 and got[0].train_tokens == 12


def tokenizer(special=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = not special
    return t


def test_packing(rows, docs):
    t = tokenizer()
    want = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in rows}
    got = packing.pack(docs, size=512, open_windows=4, group=2).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))

    def gapless(parts):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        return at

    assert {d: gapless(p) for d, p in by_doc.items()} == {d: len(x) for d, x in want.items()}
    sizes = [gapless(p) for p in by_sequence.values()]
    total = sum(map(len, want.values()))
    padded = sum(512 if n > 256 else 1 << (n - 1).bit_length() for n in sizes)
    assert max(sizes) <= 512 and padded / total < 1.05


def test_token_counts(rows, docs):
    t = tokenizer(special=False)
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in rows}
    got = separators.token_counts(docs, ids_per_block=100).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(rows)
    assert all(r.file.startswith("/") or r.file.startswith("file:") for r in got)


@pytest.mark.parametrize("k", [1, 2, 3, 100])
def test_flat_files(spark, tmp_path, k):
    for name, ids in {"a": [5, 6, 2, 2, 7, 2, 9, 9], "b": [2, 2], "c": [3, 3, 3], "d": []}.items():
        np.array(ids, "<u2").tofile(tmp_path / f"{name}.bin")
    got = separators.separator_scan(separators.read_blocks(separators.token_file_list(spark, str(tmp_path)), "<u2", k), 2, "<u2", k).collect()
    assert sorted((r.file[-5], r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == [("a", 0, 0, 3, True), ("a", 1, 3, 1, True), ("a", 2, 4, 2, True), ("a", 3, 6, 2, False), ("b", 0, 0, 1, True), ("b", 1, 1, 1, True), ("c", 0, 0, 3, False)]


def test_sentencepiece(rows, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for r in pieces.sentencepiece(docs, ids=True).collect():
        text = dict(rows)[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == model.encode(text) and r.n_ids == len(model.encode(text))
        assert r.round_trip == ("▁" not in text)


def test_viterbi_window_stays_small():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    p = pieces.Pieces(pieces.model_path())
    rnd = random.Random(3)
    for _ in range(30):
        text = "".join(rnd.choice("thein é①\n▁ab  ") for _ in range(rnd.randint(0, 300)))
        v, out, at = pieces.StreamingViterbi(p), [], 0
        fed = (" " + text if text else "").replace(" ", pieces.SPACE)
        while at < len(fed):
            n = rnd.randint(1, 90)
            out += v.push(fed[at : at + n])
            at += n
        assert out + v.finish() == model.encode(text)
    v = pieces.StreamingViterbi(p)
    n = sum(len(v.push("thequickbrown" * 100)) for _ in range(50)) + len(v.finish())
    assert v.most < 300 and n > 10_000


def test_empty_tables(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    assert simhash.simhash_classes(empty).count() == 0
    assert quality.quality_cascade(empty, metrics=True).count() == 0
    assert scoring.lm_scores(empty, lambda d: True).count() == 0
    assert packing.pack(empty).count() == 0
    assert separators.token_counts(empty).count() == 0
    assert pieces.sentencepiece(empty).count() == 0
