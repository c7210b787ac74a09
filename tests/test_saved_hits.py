"""A saved index is searched without a shuffle of scored pairs: counted terms go to their document's task as numbers."""

from pyspark.sql import functions as F
from quillmatch.operators import lexical as L


def test_hits_are_scored_in_place(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"red w{k % 5} pear pear") for k in range(40)], "doc_id long, text string")
    L.add(docs, str(tmp_path), {"all": F.col("text")}, block_rows=20)
    topics = spark.createDataFrame([(1, "all", "pear w1"), (2, "all", "w2 red"), (None, "all", "w3")], "topic_id long, field string, text string")
    found = L.search(spark, str(tmp_path), topics, 100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any("Aggregate" in line and "doc_id" in line for line in plan.splitlines())
    rows = found.collect()
    assert [sum(r.topic_id == t for r in rows) for t in (1, 2, None)] == [40, 40, 8]
    best = {r.topic_id: r.doc_id for r in rows if r["rank"] == 1}
    assert best == {1: 1, 2: 2, None: 3}
