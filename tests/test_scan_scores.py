"""BM25 scored in the scan's tasks: the rows of the joined form, without a shuffle of scored pairs."""

from pyspark.sql import functions as F
from quillmatch.functions import fixed as X
from quillmatch.operators import retrieval as R
from quillmatch.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_scan_equals_joins(spark):
    fields = list(X.FIELD_WEIGHTS)
    docs, topics = Q.documents(spark, SF), Q.topics(spark, SF)
    copies = docs.where("doc_id % 5 = 0").crossJoin(spark.range(1, 9)).select((F.col("doc_id") + F.col("id") * 10**6).alias("doc_id"), "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "the of")], "doc_id long, text string")
    docs = docs.unionByName(copies).unionByName(odd)
    found = R.bm25(docs, topics, 7, fields)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [field" in plan and "topic_id#" in plan
    assert not any("Aggregate" in line and "doc_id" in line for line in plan.splitlines())
    scored = R.joined_scores(docs, R.query_terms(topics), fields, X.K1, X.B)
    want = R.top(scored, ["field", "topic_id"], [F.desc("score"), F.asc("doc_id")], 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))
    assert R.bm25(docs.where("false"), topics, 7).count() == 0 == R.bm25(docs, topics.where("false"), 7).count()


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "red apple"), (1, "red pear"), (2, "red"), (None, "apple")], "doc_id long, text string")
    topics = spark.createDataFrame([(5, "red apple")], "topic_id long, text string")
    got = R.bm25(docs, topics, 5).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])].count(1) == 1 and len(got) == 3
