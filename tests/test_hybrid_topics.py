"""The hybrid run searches for every topic's own vector, not only for those whose id is divisible by 20."""

import duckdb
from quillmatch.plans import queries as Q
from quillmatch.plans.oracle import ORACLES


def test_every_topic_has_both_runs(spark, tmp_path):
    docs = [(i, f"word{i % 7} melanoma") for i in range(60)]
    # topic 70 has no vector, topic 3 stands twice, and 40 is a query by its id alone
    topics = [(0, "melanoma"), (1, "melanoma"), (3, "melanoma"), (3, "word3"), (21, "melanoma"), (70, "melanoma"), (None, "melanoma")]
    vectors = [(i, [1.0, i / 10], 0) for i in range(60)] + [(80, None, 0)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string"),
        ("benchmark", topics, "item_id long, text string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = Q.rrf_hybrid(spark, str(tmp_path)).select("topic_id", "doc_id", "score", "n_runs", "rank").collect()
    both = {r.topic_id for r in got if r.n_runs == 2}
    assert both == {0, 1, 3, 21} and {r.topic_id for r in got} == both | {20, 40, 70, 80, None}
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT topic_id, doc_id, score, n_runs, rank FROM ({ORACLES['rrf_hybrid']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
