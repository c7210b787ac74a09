"""Patterns of criterion types are tried once a criterion, and not at all where only headings count."""

from quillmatch.operators import criteria_table as K

TEXT = "- Age 18 years or younger than 80\n\nSee Disease Characteristics\nOrgan function:\n- no HIV\nfor control participants\n\nmore"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_types_are_tried_once(spark):
    rows = spark.createDataFrame([(1, TEXT, ""), (2, None, TEXT)], "trial long, inclusion_text string, exclusion_text string")
    found = K.segment(rows).select("trial", "id", "type", "text")
    assert plan(found).count("younger") == 1 and plan(K.segment_counts(rows)).count("younger") == 0
    assert {r.type for r in found.collect()}.isdisjoint({"section_header"}) and found.count() > 0
