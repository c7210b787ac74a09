"""Profile coercion: good items stay, bad ones go alone, unusable answers leave the text."""

import json

from pyspark.sql import functions as F
from quillmatch.functions.lenient import lenient_json
from quillmatch.functions.profiles import profile


def read(spark, *answers):
    rows = [(k, a if a is None or isinstance(a, str) else json.dumps(a)) for k, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "k int, t string")
    made = df.select("k", profile(lenient_json(F.col("t")), F.concat(F.lit("p"), "k"), F.lit("note")).alias("p"))
    return [r.p.asDict(recursive=True) for r in sorted(made.collect(), key=lambda r: r.k)]


def test_mixed_lists_keep_their_good_items(spark):
    (p,) = read(
        spark,
        {
            "age_years": "61.5", "sex": "Female", "ecog": 1.0, "karnofsky": 90, "location": "USA", "extra": {"x": 1},
            "secondary_diagnoses": ["asthma", 3, None, "gout"],
            "biomarkers": [{"name": "HER2", "status": "positive", "value": None}, {"name": "EGFR"}, {"name": 5, "status": "x"}, "KRAS", {"name": "ALK", "status": "negative", "value": 3}, None],
            "prior_treatments": [{"name": "A", "line": "2", "ended_on": "2020-02-03", "ongoing": "yes"}, {"name": "B", "line": 1.5}, {"name": "C", "ongoing": None}, {"name": "D", "ended_on": "2020-13-01"}, {"name": "E"}],
            "comorbidities": [{"name": "copd", "active": 1, "onset": None}, {"name": "x", "active": "maybe"}, {"active": True}],
            "labs": [{"name": "ANC", "value": "1.5", "units": "g/L", "measured_on": "2021-05-06"}, {"name": "Hb", "value": "low"}, {"name": "Na", "value": 1e2}],
            "pregnancy": {"pregnant": False, "contraception": "pill"},
        },
    )
    assert p["extracted"] and (p["topic_id"], p["raw_text"], p["age_years"], p["sex"], p["ecog"], p["karnofsky"], p["location"]) == ("p0", "note", 61.5, "female", 1, 90, "USA")
    assert p["secondary_diagnoses"] == ["asthma", "gout"]
    assert p["biomarkers"] == [{"name": "HER2", "status": "positive", "value": None, "method": None}]
    assert [(t["name"], t["line"], str(t["ended_on"]), t["ongoing"]) for t in p["prior_treatments"]] == [("A", 2, "2020-02-03", True), ("E", None, "None", False)]
    assert [(c["name"], c["active"]) for c in p["comorbidities"]] == [("copd", True)]
    assert [(x["name"], x["value"], x["units"], str(x["measured_on"])) for x in p["labs"]] == [("ANC", 1.5, "g/L", "2021-05-06"), ("Na", 100.0, None, "None")]
    assert p["pregnancy"] == {"pregnant": False, "breastfeeding": None, "childbearing_potential": None, "contraception": "pill"}


def test_unusable_answers(spark):
    plain = {"ecog": 6}, {"karnofsky": -1}, {"age_years": "old"}, {"biomarkers": {"name": "x"}}, {"pregnancy": {"pregnant": "perhaps"}}, {"primary_diagnosis": 3}, {"sex": 1}, [], "no json", None, "{"
    for p in read(spark, *plain):
        assert not p["extracted"] and p["raw_text"] == "note" and p["sex"] == "unknown" and p["labs"] == [] == p["secondary_diagnoses"]
        assert all(p[x] is None for x in ("age_years", "ecog", "karnofsky", "primary_diagnosis", "pregnancy"))


def test_nulls_and_empties(spark):
    got = read(spark, {}, {"biomarkers": None, "labs": [], "secondary_diagnoses": None, "pregnancy": None, "sex": None, "ecog": None}, {"sex": "other", "pregnancy": {}}, {"ecog": True})
    assert all(p["extracted"] and p["sex"] == "unknown" and p["biomarkers"] == [] and p["pregnancy"] is None for p in got)
    assert [p["ecog"] for p in got] == [None, None, None, 1]
