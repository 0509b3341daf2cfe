import numpy as np

from groundline.llm import neighbors


def brute(rows, k, least):
    ids = sorted(rows)
    unit = np.array([rows[i] for i in ids], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = unit @ unit.T
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(score[i, j], 9), ids[j]))[:k]
        out |= {(min(a, ids[j]), max(a, ids[j])) for j in order if score[i, j] >= least}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, 1) for i, v in rows], "id string, embedding array<float>, h int").repartition(4)


def clustered(seed, groups, size, width=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, width))
    return {f"v{g:03}{i:03}": (centers[g] + rng.normal(size=width) * 0.15).astype("f").tolist() for g in range(groups) for i in range(size)}


def test_recall_against_brute_force(spark):
    rows = clustered(1, 250, 6)
    got = {tuple(r) for r in neighbors.similar_pairs(frame(spark, rows.items()), 3, 0.9, 16).collect()}
    want = brute(rows, 3, 0.9)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.01 * len(want)


def test_crowded_lists_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LIST_ROWS", 40)
    rows = clustered(2, 3, 60)
    got = {tuple(r) for r in neighbors.similar_pairs(frame(spark, rows.items()), 5, 0.9, 16).collect()}
    assert got == brute(rows, 5, 0.9)


def test_copies_scales_and_unusable_vectors(spark):
    one, two = np.eye(16)[0], np.eye(16)[0] + 0.05 * np.eye(16)[1]
    rows = [(f"c{i}", one) for i in range(9)] + [("c3", one), ("t", two), ("s", 7 * two), ("zero", np.zeros(16)), ("nan", [float("nan")] * 16), ("inf", [float("inf")] + [0.0] * 15), ("short", [1.0]), ("null", None), ("empty", []), (None, one), ("far", np.eye(16)[5])]
    got = {tuple(r) for r in neighbors.similar_pairs(frame(spark, rows), 2, 0.9, 16).collect()}
    want = brute({i: v for i, v in rows if i and i[0] in "cts" and i != "short"}, 2, 0.9)
    assert got == want


def test_empty_and_single(spark):
    assert neighbors.similar_pairs(frame(spark, []), 5, 0.9, 16).count() == 0
    assert neighbors.similar_pairs(frame(spark, [("a", np.ones(16))]), 5, 0.9, 16).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    sample = neighbors.unit(rng.normal(size=(6000, 16)), np.float32)
    graph = neighbors.Graph(sample, 500, 0)
    ids, _ = graph.search(sample[:500], 1)
    assert (ids[:, 0] == (sample[:500] @ graph.centroids.T).argmax(axis=1)).mean() > 0.95
