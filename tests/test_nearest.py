"""Cosine search in groups: odd vectors as in the SQL, ties across groups, and no plan that makes all pairs."""

import random

import duckdb
from quillmatch.operators import nearest as N
from quillmatch.operators import retrieval as R
from quillmatch.plans import queries as Q
from quillmatch.plans.oracle import ORACLES


def test_zero_and_null_vectors_as_in_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)], i % 3) for i in range(90)]
    rows += [(100, [0.0] * 4, 1), (101, None, 1), (102, [0.0] * 4, 2), (120, [1.0, 0.0, 0.0, 0.0], 0)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    for name in ("dense_cosine_topk", "dense_filtered_topk", "fewshot_knn"):
        got = Q.QUERIES[name](spark, str(tmp_path)).select("query_id", "vec_id", "score", "rank").collect()
        want = con.execute(f"SELECT query_id, vec_id, score, rank FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_groups_keep_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_VECTORS", 7)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 3)
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(60)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(10)], "query_id long, query array<float>")
    for last, want in ((False, [1, 3, 5, 7]), (True, [59, 57, 55, 53])):
        found = R.dense(vectors, queries, 4, last)
        got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
        assert got == {(q, k + 1): v for q in range(10) for k, v in enumerate(want)}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
