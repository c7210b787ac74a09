"""Views are made of pieces that are tokenised once, and the documents are scanned once to count and once to score."""

from pyspark.sql import functions as F
from quillmatch.functions import fixed as X
from quillmatch.functions.text import index_tokens
from quillmatch.operators import retrieval as R


def test_pieces_make_up_each_view(spark):
    lines = ["red AppleΣ", "", "pear_2 the", "fig fig", "plum", "x1 kiwi", "líme"]
    rows = [(n, "\n".join(lines[:n])) for n in range(1, 8)] + [(8, None), (9, ""), (10, "\n"), (11, "a1\n\n\n\nb2\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    views, parts = R.fields_of(F.col("text")), R.PIECES
    whole = {r.doc_id: r.asDict() for r in docs.select("doc_id", *[index_tokens(views[f]).alias(f) for f in parts]).collect()}
    for r in R.tokenised(docs).collect():
        for f, pieces in parts.items():
            assert sorted(t for p in pieces for t in r[p]) == sorted(whole[r.doc_id][f]), (r.doc_id, f)
        assert r.text == whole[r.doc_id]["all"]


def test_documents_are_scanned_twice(spark, tmp_path):
    rows = [(k, f"red w{k}\napple\npear w{k % 7}\nfig\nplum w1") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, topics = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame([(1, "w1 w2 plum"), (2, None)], "topic_id long, text string")
    found = R.bm25(docs, topics, 5, list(X.FIELD_WEIGHTS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("parquet" in line and "Relation" in line for line in plan.splitlines()) == 2
    assert plan.count("regexp_extract_all(lower") <= 2 * 6 + 3  # six pieces in each scan; the topics' words thrice
    assert found.count() > 0
