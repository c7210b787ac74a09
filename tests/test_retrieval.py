"""Retrieval on small fixtures where a cap or a bound would show."""

import math

from pyspark.sql import functions as F
from quillmatch.functions import fixed as X
from quillmatch.operators import lexical as L
from quillmatch.operators import retrieval as R
from quillmatch.plans import queries as Q
from quillmatch.sources import sinks


def test_dense_takes_any_number_of_queries(spark):
    angle = lambda i: [math.cos(i), math.sin(i)]
    n = 10_050
    vectors = spark.createDataFrame([(i, angle(2.5 * i)) for i in range(5)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, angle(i)) for i in range(n)], "query_id long, query array<double>")
    got = {r.query_id: r.vec_id for r in R.dense(vectors, queries, 1).collect()}
    want = {q: max(range(5), key=lambda v: (round(math.cos(q - 2.5 * v), 6), -v)) for q in range(n)}
    assert got == want


def test_fewshot_takes_the_last_of_many_ties(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i < 10 else [2.0, 0.0], 0) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r["rank"]): r.vec_id for r in Q.fewshot_knn(spark, str(tmp_path)).collect()}
    assert got == {(q, k): 80 - k for q in (0, 20, 40, 60) for k in (1, 2, 3)}  # queries: ids divisible by 20


def test_fielded_fuses_ranks_beyond_200(spark, tmp_path):
    """A document at rank 250 of a field counts with that rank, too."""
    # longer titles rank lower; only the last 40 documents have the word in their other lines
    rows = [(i, "melanoma " + "filler " * i + ("\nmelanoma" * 50 if i >= 210 else "\nother\nnothing")) for i in range(250)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "melanoma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, topics = Q.documents(spark, str(tmp_path)), Q.topics(spark, str(tmp_path))
    ranks = {}
    for r in R.bm25(docs, topics, 250, list(X.FIELD_WEIGHTS)).collect():
        ranks.setdefault(r.doc_id, []).append((X.FIELD_WEIGHTS[r.field], r["rank"]))
    fused = {d: sum(w / (X.RRF_K + k) for w, k in x) for d, x in ranks.items()}
    got = Q.bm25_fielded_rrf(spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(abs(r.score - fused[r.doc_id]) < 2e-6 for r in got)
    assert min(r.score for r in got) > max(v for d, v in fused.items() if d not in {r.doc_id for r in got}) - 2e-6
    late = {d for d, x in ranks.items() if any(k > 200 for _, k in x)}
    assert late & {r.doc_id for r in got}


def test_saved_index(spark, tmp_path):
    """The saved index ranks like the scan, reads no text and only the blocks of the terms."""
    docs, topics = Q.documents(spark, "/root/testdata/sf0.001"), Q.topics(spark, "/root/testdata/sf0.001").where("topic_id < 4")
    docs = docs.unionByName(spark.createDataFrame([(10**6, ""), (10**6 + 1, None)], "doc_id long, text string"), allowMissingColumns=True)
    fields = ["condition_title", "eligibility"]
    sinks.write_index(docs, str(tmp_path), fields)
    each = lambda t: t.select("topic_id", "text", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    found = L.search(spark, str(tmp_path), each(topics), 10)
    assert sorted(found.collect()) == sorted(R.bm25(docs, topics, 10, fields).collect())
    word = spark.read.parquet(f"{tmp_path}/lexicon").first().term
    one = spark.createDataFrame([(0, word), (1, None)], "topic_id long, text string")
    read, _ = L.hits(spark, str(tmp_path), L.asked_terms(each(one)))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert L.search(spark, str(tmp_path), each(one.where("text is null")), 10).count() == 0


def test_frequent_terms_are_not_gathered(spark):
    """Document frequencies meet the postings by broadcast: no task gets all postings of a term."""
    docs = spark.createDataFrame([(k, "common word" if k % 2 else "common") for k in range(50)], "doc_id long, text string")
    run = R.bm25(docs, spark.createDataFrame([(1, "common word")], "topic_id long, text string"), 5)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 4
    assert run.count() == 5
