"""The audit reads the corpus once; sinks and readers of judged material."""

import json

import pytest
from pyspark.sql import functions as F
from quillmatch.functions import criteria as C
from quillmatch.operators import audit as A
from quillmatch.operators import retrieval as R
from quillmatch.operators import retrieval_audit as RA
from quillmatch.plans import queries as Q
from quillmatch.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_reports_come_from_one_pass(spark):
    docs, topics = Q.documents(spark, SF), Q.topics(spark, SF).where("topic_id < 4")
    runs = RA.runs_of(docs, topics, 20, None, 20, field_k=50)
    judged = Q.qrels(spark, SF).withColumn("topic_id", F.pmod("doc_id", F.lit(4)).cast("long"))
    found = RA.audit(runs, topics, judged, docs, docs.where("doc_id % 2 = 0"))
    for report in (found.stages, found.aggregate):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(filter(regexp_extract_all" not in plan and "documents.parquet" not in plan
    stages = found.stages.collect()
    names = {r.stage for r in stages}
    assert names == {"bm25", "fused", *(f"bm25_field_{f}" for f in ("all", "condition_title", "eligibility", "intervention", "summary_description"))}
    assert len(stages) == 4 * len(names) * 5 and all(r.judged == r.eligible + r.excludes + r.irrelevant for r in stages)
    got = {(r.side, r.label): (r.total, r.covered, r.missing) for r in found.coverage.collect()}
    assert got["corpus", "all_judged"][2] == 0 and got["index", "all_judged"][1] < got["index", "all_judged"][0]


def test_empty_audit(spark):
    docs, topics = Q.documents(spark, SF).limit(0), Q.topics(spark, SF).where("topic_id < 2")
    none = Q.qrels(spark, SF).withColumn("topic_id", F.lit(0).cast("long")).limit(0)
    found = RA.audit(RA.runs_of(docs, topics, 5), topics, none, docs, docs)
    assert found.stages.count() == found.aggregate.count() == found.missing.count() == found.overlap.count() == 0
    assert all((r.total, r.covered, r.coverage) == (0, 0, 0.0) for r in found.coverage.collect())


def test_criterion_annotations(spark, tmp_path):
    rows = [("1", "N1", "i_1", "met"), ("1", "N1", "i_1", "NEI"), ("2", "N1", "i_1", "not_met"), ("1", "N1", "i_2", "odd"), ("1", "N1", None, "met")]
    text = "\n".join(json.dumps(dict(zip(("topic_id", "nct_id", "criterion_id", "label"), r))) for r in rows)
    (tmp_path / "gold.jsonl").write_text(text + "\n\nnot json\n")
    gold = readers.criterion_annotations(spark, str(tmp_path / "gold.jsonl"))
    assert sorted(tuple(r) for r in gold.collect()) == [("1", "N1", "i_1", "NEI"), ("2", "N1", "i_1", "not_met")]
    said = spark.createDataFrame([("1", "N1", "i_1", "met"), ("2", "N1", "i_1", "not_met"), ("3", "N1", "i_1", "met")], "topic_id string, trial string, criterion string, label string")
    scores = {r["class"]: (r.tp, r.fp, r.fn) for r in A.criterion_scores(said, gold).collect()}
    assert scores[1] == (1, 0, 0) and scores[0] == (0, 1, 0) and scores[2] == (0, 0, 1)


def test_predictions_file(spark, tmp_path):
    ranked = spark.createDataFrame(
        [("t2", "N1", 1, 0.123456, "eligible", "why", 0.33333, "ranked"), ("t1", "N3", 2, -2.0, "excludes", None, 1.0, "excluded"), ("t1", "N2", 1, 0.5, "irrelevant", None, 0.0, "tail")],
        "topic_id string, nct_id string, rank int, score double, label string, rationale string, fraction_nei double, source string",
    )
    sinks.write_predictions(ranked, str(tmp_path / "p"), {"mode": "benchmark", "top_k": 2})
    (line,) = spark.read.text(str(tmp_path / "p")).collect()
    got = json.loads(line.value)
    assert got["metadata"] == {"mode": "benchmark", "top_k": "2"} and [t["topic_id"] for t in got["topics"]] == ["t1", "t2"]
    first = got["topics"][0]["ranked_trials"]
    assert [(t["nct_id"], t["predicted_trec_qrel"], t["hard_excluded_fill"], t["retrieval_tail_fill"]) for t in first] == [("N2", 0, False, True), ("N3", 1, True, False)]
    assert got["topics"][1]["ranked_trials"][0]["score"] == 0.1235 and got["topics"][1]["ranked_trials"][0]["fraction_nei"] == 0.333


def test_runs_by_mode(spark):
    v, q = Q._vectors(spark, SF)
    assert R.dense_run(v, q, 3, "off").count() == 0 and R.dense_run(v, q, 3).count() == 3 * q.count()
    means = R.mean_vectors(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>"), True)
    got = {r.query_id: r.query for r in means.collect()}
    assert got[2] == [0.0, 0.0] and [round(x, 6) for x in got[1]] == [round(2 / 20**0.5, 6), round(4 / 20**0.5, 6)]
    for bad in (lambda: R.dense_run(v, q, 3, "other"), lambda: R.lexical(v, q, 3, "other")):
        with pytest.raises(ValueError):
            bad()


def test_aliases(spark):
    df = spark.createDataFrame([("Yes-No", "Very High"), ("composite", "normal"), (" odd kind ", "odd"), (None, None)], "t string, p string")
    rows = [tuple(r) for r in df.select(C.data_type(F.col("t")), C.priority_alias(F.col("p"))).collect()]
    assert rows == [("boolean", "critical"), ("text", "medium"), ("odd_kind", "odd"), (None, None)]
