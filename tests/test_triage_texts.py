"""Triage reads each different text once where these are few, and deals the criteria by trial once."""

from pyspark.sql import functions as F
from quillmatch.operators import criteria_table as K
from quillmatch.plans import matching as N
from quillmatch.plans import queries as Q


def plans(df):
    made = df._jdf.queryExecution()
    return made.optimizedPlan().toString().splitlines(), made.executedPlan().toString().splitlines()


def test_texts_are_read_once(spark, monkeypatch):
    rows = [
        (i // 6, i % 6, "exclusion" if i % 4 == 1 else "inclusion", ("other", "lab", None)[i % 3], (None, *Q.CRITERIA)[i * 5 % 21], i % 2 == 0, i % 3 == 0)
        for i in range(240)
    ]
    criteria = spark.createDataFrame(rows, "trial long, pos int, polarity string, type string, text string, mandatory boolean, typed boolean").localCheckpoint()
    terms = F.array(F.lit("melanoma"), F.lit("hiv"))
    found = K.triaged(criteria, terms, 3)
    shown, dealt = plans(K.triage_summary(found))
    told = [i for i, line in enumerate(shown) if "RLIKE" in line]
    assert len(told) == 1 and any("Aggregate [text" in line for line in shown[told[0] :]) and any("LeftOuter" in line and "broadcast" in line for line in shown[: told[0]])
    assert sum("Exchange hashpartitioning(trial" in line for line in dealt) == 1
    got = sorted(map(str, found.collect()))
    assert len(got) == 240 and sum("selected=True" in r for r in got) == 120
    monkeypatch.setattr(K, "fits", lambda *a: False)
    assert sorted(map(str, K.triaged(criteria, terms, 3).collect())) == got


def test_evaluations_are_dealt_once(spark):
    _, dealt = plans(N.triage_diagnostics(spark, "/root/testdata/sf0.001"))
    assert sum("Exchange hashpartitioning(trial" in line for line in dealt) == 1
