from pyspark.sql import functions as F
from quillmatch.operators import dossier as D


def test_markdown(spark):
    evals = spark.createDataFrame(
        [(7, 1, 1, "i_1", "inclusion", "age", "Age | 18", "met", "is 40", 0.9, True, None), (7, 1, 2, "e_1", "exclusion", "lab", "ANC low", "NEI", None, 0.2, False, None), (8, 1, 1, "i_1", "inclusion", "age", "Age | 18", "NEI", None, 0.1, True, None)],
        "topic_id long, trial long, criterion int, id string, polarity string, type string, text string, label string, evidence string, confidence double, mandatory boolean, reasoning string",
    )
    trials = spark.range(1, 2).select(
        F.col("id").alias("trial"), F.lit("T").alias("title"), F.lit("About").alias("brief_summary"), F.lit("PHASE2").alias("phase"), F.lit("RECRUITING").alias("status"),
        F.lit(None).cast("array<struct<city:string,country:string>>").alias("locations"), F.lit(None).cast("array<struct<name:string,email:string,phone:string>>").alias("contacts"),
    )
    judged = spark.createDataFrame([(7, 1, 1, 0.5, None), (7, 2, 2, 0.1, "why"), (8, 1, 1, 0.4, None)], "topic_id long, trial long, rank int, score double, rationale string")
    made = D.dossiers(judged, evals, trials, D.fallback_questions(evals))
    rows = {r.trial: r.markdown for r in D.markdown(made.where("topic_id = 7")).collect()}
    # the same trial for another patient: other labels, other questions
    (other,) = made.where("topic_id = 8").collect()
    assert (other.inclusion_met, other.inclusion_nei, other.exclusion_total) == (0, 1, 0) and [q.criterion_id for q in other.missing_information] == ["i_1"]
    assert rows[1].startswith("# 1 T\n") and "Age \\| 18" in rows[1] and "- [medium] For trial 1" in rows[1]
    assert "About" in rows[1] and "why" in rows[2] and "(no locations listed)" in rows[2]
