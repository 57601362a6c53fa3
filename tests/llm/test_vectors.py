import numpy as np

from lodestone.llm import embeddings


def brute(rows, threshold=0.98):
    fine = [r for r in rows if r[1] is not None and r[2] and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    x = [np.array(r[2], float) for r in fine]
    for i in range(len(fine)):
        for j in range(i):
            if fine[i][1] == fine[j][1] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold:
                links[fine[i][0]] += 1
                links[fine[j][0]] += 1
                a, b = sorted((find(fine[i][0]), find(fine[j][0])))
                root[b] = a
    return {k: (links[k], find(k), find(k) == k) for k in links}


def table():
    rnd, rows = np.random.default_rng(3), []
    for label in range(2):
        centre = rnd.normal(size=64)
        for _ in range(60):
            rows.append((len(rows), label, [float(np.float32(v)) for v in centre + rnd.normal(size=64) * rnd.uniform(0.05, 0.25)]))
        rows += [(len(rows) + i, label, rows[-1][2]) for i in range(4)]
    k = len(rows)
    return rows + [(k, None, rows[-1][2]), (k + 1, 1, None), (k + 2, 1, [0.0] * 64), (k + 3, 1, [float("nan")] * 64), (k + 4, 1, [1.0] * 3), (k + 5, 1, [1.0, 1.0, 1.01]), (k + 6, 1, []), (k + 7, 1, [None] + [1.0] * 63), (k + 8, 1, [float("inf")] + [1.0] * 63)]


def test_links(spark):
    rows = table()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, rep string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == brute(rows) and sum(n for n, _, _ in got.values()) > 100


def test_large_cells_are_tiled(spark):
    rows = [r for r in table() if r[2] and len(r[2]) == 64 and r[1] == 0]
    df = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "rep long, label long, vector array<double>").selectExpr("*", "1L as copies", "size(vector) as dim")
    found = embeddings.joined(embeddings.cells(df, 0.04), df, 0.98, most=5).where("kind = 0").groupBy("a").sum("b").collect()
    assert {r[0]: r[1] for r in found} == {k: n for k, (n, _, _) in brute(rows).items() if n}


def test_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
