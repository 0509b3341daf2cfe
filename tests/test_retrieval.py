import numpy as np

from groundline.operators import retrieval


def test_batch_top_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    chunks, asked = rng.normal(size=(300, 8)).astype("f"), rng.normal(size=(5, 8)).astype("f")
    chunks[7] = chunks[3]  # a tie
    c = spark.createDataFrame([(f"c{i:03}", v.tolist()) for i, v in enumerate(chunks)], "chunk_id string, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<float>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.batch_top(q, c, 6, 8).collect()}
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = unit(asked) @ unit(chunks).T
    for i in range(5):
        best = sorted(range(300), key=lambda j: (-round(scores[i, j], 12), j))[:6]
        assert [got[str(i), n + 1] for n in range(6)] == [f"c{j:03}" for j in best]


def test_scope_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) document_id", "'x' course_id").write.parquet(str(tmp_path / "c"))
    plan = retrieval.in_scope(spark.read.parquet(str(tmp_path / "c")), course_id="x")._jdf.queryExecution().toString()
    assert "EqualTo(course_id,x)" in plan


def test_bad_vectors_have_no_score_and_displace_nothing(spark):
    rows = [("a", [1.0, 0.0]), ("b", [float("nan"), 1.0]), ("z", [0.0, 0.0]), ("n", None)]
    df = spark.createDataFrame(rows, "chunk_id string, v array<float>")
    from pyspark.sql import functions as F

    scored = df.select("chunk_id", retrieval.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(1.0))).alias("score"))
    assert [r["chunk_id"] for r in retrieval.top_chunks(scored, 3).collect()] == ["a"]
    assert [r[0] for r in df.select(retrieval.usable(F.col("v"), 2)).collect()] == [True, False, False, False]


def test_top_k_plans(spark):
    df = spark.range(100).selectExpr("cast(id as string) chunk_id", "id % 7 as g", "rand() as score")
    assert "TakeOrderedAndProject" in retrieval.top_chunks(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in retrieval.top_chunks(df, 5, ("g",))._jdf.queryExecution().executedPlan().toString()


def test_lexical_vectors(spark):
    texts = spark.createDataFrame([(1, "Variance estimation variance"), (2, "estimation de la VARIANCE"), (3, "poisson rouge"), (4, "le de la"), (5, None), (6, " \u00a0")], "id int, text string")
    rows = retrieval.lexical_vectors(texts).collect()
    vectors = {}
    for r in rows:
        vectors.setdefault(r["id"], {})[r["bucket"]] = r["weight"]
    dot = lambda a, b: sum(w * vectors[b].get(k, 0) for k, w in vectors[a].items())
    assert set(vectors) == {1, 2, 3, 4} and list(vectors[4].values()) == [1] and all(abs(dot(i, i) - 1) < 1e-9 for i in vectors)
    assert dot(1, 2) > 0.3 and dot(1, 3) == 0


def test_lexical_top_equals_the_vectors(spark):
    texts = ["Variance estimation variance", "estimation de la VARIANCE", "poisson rouge", "le de la", "rouge variance", "rouge variance", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "variance rouge"), (2, "le de la"), (3, None)], "query_id long, text string")
    vectors = {}
    for kind, rows in (("d", retrieval.lexical_vectors(docs, "doc_id")), ("q", retrieval.lexical_vectors(asked, "query_id"))):
        for r in rows.collect():
            vectors.setdefault((kind, r[0]), {})[r["bucket"]] = r["weight"]
    dot = lambda q, d: round(sum(w * vectors["d", d].get(b, 0) for b, w in vectors["q", q].items()), 9)
    got = {}
    for r in retrieval.lexical_top(asked, docs, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == {q: [(d, dot(q, d)) for d in sorted(range(6), key=lambda d: (-dot(q, d), d))[:3]] for q in (1, 2)}


def test_batch_top_counts_copies_once_and_keeps_scopes_apart(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 24)  # three queries a slice
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 16)
    rng = np.random.default_rng(2)
    chunks, asked = rng.normal(size=(60, 8)).astype("f"), rng.normal(size=(7, 8)).astype("f")
    rows = [(f"c{i:02}", f"s{i % 3}" if i % 7 else None, v.tolist()) for i, v in enumerate(chunks)]
    c = spark.createDataFrame(rows + rows + rows + rows[:20], "chunk_id string, scope string, vector array<float>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = unit(asked) @ unit(chunks).T
    got = {}
    for r in retrieval.batch_top(q, c, 4, 8, scope="scope").orderBy("rank").collect():
        got.setdefault((r["query_id"], r["scope"]), []).append(r["chunk_id"])
    for i in range(7):
        for scope in ("s0", "s1", "s2", None):
            mine = [j for j in range(60) if rows[j][1] == scope]
            assert got[str(i), scope] == [f"c{j:02}" for j in sorted(mine, key=lambda j: -scores[i, j])[:4]]
    whole = retrieval.batch_top(q, c, 4, 8).filter("query_id = '3'").orderBy("rank").collect()
    assert [r["chunk_id"] for r in whole] == [f"c{j:02}" for j in np.argsort(-scores[3])[:4]]


def test_ranks(spark):
    got = retrieval.rank_report(spark.createDataFrame([(1,), (2,), (None,), (8,)], "rank int")).first()
    assert (got["hit_1"], got["hit_3"], got["hit_8"], got["mrr"]) == (0.25, 0.5, 0.75, (1 + 0.5 + 0.125) / 4)
