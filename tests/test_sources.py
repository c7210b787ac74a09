import json

from quillmatch.functions import text as T
from quillmatch.sources import readers as R
from quillmatch.sources import sinks
from quillmatch.streaming.ingest import follow, timings
from pyspark.sql import functions as F


def study(n, **more):
    section = {
        "identificationModule": {"nctId": f"NCT{n}", "briefTitle": f"Title {n}"},
        "conditionsModule": {"conditions": ["A", "B"]},
        "designModule": {"phases": ["PHASE2", "PHASE3"], "studyType": "INTERVENTIONAL"},
        "statusModule": {"overallStatus": "Recruiting", "lastUpdatePostDateStruct": {"date": "2020-05"}},
        "eligibilityModule": {
            "eligibilityCriteria": "Inclusion Criteria:\n- x\nExclusion Criteria:\n- y",
            "minimumAge": "18 Years", "maximumAge": "N/A", "sex": "ALL", "healthyVolunteers": "No",
        },
        "contactsLocationsModule": {"locations": [{"city": f"c{i}", "country": "Spain"} for i in range(60)]},
    }
    return {"protocolSection": section | more}


def test_studies_json(spark, tmp_path):
    (tmp_path / "page_00000.json").write_text(json.dumps([study(1), study(2), {"protocolSection": {}}]))
    (tmp_path / "page_00001.json").write_text("not json [")
    rows = {r.nct_id: r for r in R.studies_json(spark, str(tmp_path)).collect()}
    assert set(rows) == {"NCT1", "NCT2"}
    r = rows["NCT1"]
    assert (r.title, r.phase, r.status, r.interventional) == ("Title 1", "PHASE2", "RECRUITING", True)
    assert (r.eligibility.inclusion_text, r.eligibility.exclusion_text) == ("- x", "- y")
    assert (r.eligibility.age_range.min_days, r.eligibility.age_range.max_days) == (18 * 365, None)
    assert len(r.locations) == 50 and r.contacts == [] and str(r.last_update_date) == "2020-05-01"
    assert r.eligibility.accepts_healthy_volunteers is False


def test_studies_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<clinical_study><id_info><nct_id> NCT9 </nct_id></id_info><brief_title>A\n  b</brief_title><condition>C</condition>"
        "<keyword>k</keyword><condition_browse><mesh_term>m</mesh_term></condition_browse><phase>Phase 1/Phase 2</phase>"
        "<overall_status>Not yet recruiting</overall_status><eligibility><criteria><textblock>Exclusion criteria: z</textblock></criteria>"
        "<gender>Both</gender><minimum_age>6 Months</minimum_age></eligibility><last_update_posted>May 3, 2019</last_update_posted>"
        "<location><facility><name>F</name><address><city>X</city><country>Peru</country></address></facility></location></clinical_study>"
    )
    (r,) = R.studies_xml(spark, str(tmp_path)).collect()
    assert (r.nct_id, r.title, r.keywords, r.phase, r.status) == ("NCT9", "A b", ["k", "m"], "PHASE1_PHASE2", "NOT_YET_RECRUITING")
    assert (r.eligibility.exclusion_text, r.eligibility.sex, r.eligibility.age_range.min_days) == ("z", "ALL", 180)
    assert str(r.last_update_date) == "2019-05-03" and r.locations[0].country == "Peru"


def test_topics(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<topics><topic number="1">  first </topic><topic number="2"> </topic><topic number="3">third</topic></topics>')
    (tmp_path / "t.json").write_text(json.dumps([{"topic_id": "a", "text": "x"}, {"patient_id": "b", "raw_text": "y"}]))
    xml = R.read_topics(spark, str(tmp_path / "t.xml"))
    assert sorted(tuple(r) for r in xml.collect()) == [("1", "first"), ("3", "third")]
    assert sorted(tuple(r) for r in R.read_topics(spark, str(tmp_path / "t.json")).collect()) == [("a", "x"), ("b", "y")]
    assert [r.topic_id for r in R.pick_topics(xml, "3, 1").collect()] == ["3", "1"]
    try:
        R.pick_topics(xml, "9")
        raise AssertionError
    except ValueError as e:
        assert "9" in str(e)


def test_qrels(spark, tmp_path):
    (tmp_path / "q.txt").write_text("t1 0 N1 2\nt1 0 N2 x\n\nt1 0 N1 1\nbad line\nt2\t0\tN3\t0\n")
    rows = sorted(tuple(r) for r in R.qrels_text(spark, str(tmp_path / "q.txt")).collect())
    assert rows == [("t1", "N1", 1), ("t2", "N3", 0)]


def test_bank_and_predictions(spark, tmp_path):
    lines = [{"id": str(i), "category": "c" if i < 3 else "d", "criterion_text": f"t{i % 4}", "decision": d} for i, d in enumerate(["met", "NEI", "not_met", "met", "odd"])]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    found = {(r.problem, r.key) for r in R.bank_problems(R.example_bank(spark, str(tmp_path / "b.jsonl"))).collect()}
    assert found == {("label", "4"), ("repeated criterion_text", "t0"), ("one-sided category", "d")}
    (tmp_path / "p.json").write_text(json.dumps({"topics": [{"topic_id": "1", "ranked_trials": [{"nct_id": "N", "score": 0.5}]}]}))
    assert [tuple(r)[:4] for r in R.predictions_run(spark, str(tmp_path / "p.json")).collect()] == [("1", "N", 0.5, 0)]


def test_thesaurus(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<DescriptorRecordSet><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Asthma</String></DescriptorName>"
        "<TreeNumberList><TreeNumber>C08</TreeNumber></TreeNumberList><ConceptList><Concept><TermList><Term><String>Asthma</String></Term>"
        "<Term><String>Bronchial Asthma</String></Term></TermList></Concept></ConceptList></DescriptorRecord></DescriptorRecordSet>"
    )
    concepts = R.thesaurus_xml(spark, str(tmp_path / "d.xml"))
    assert [tuple(r) for r in concepts.collect()] == [("D1", "Asthma", ["Asthma", "Bronchial Asthma"], ["C08"])]
    assert {r.synonym for r in R.synonym_index(concepts).collect()} == {"asthma", "bronchial asthma"}


def test_index_sink(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "the of")], "doc_id long, text string")
    sinks.write_index(docs, str(tmp_path / "i"), ["all"])
    rows = spark.read.parquet(str(tmp_path / "i/postings")).select("term", "doc_id", "tf", "dl").collect()
    assert sorted(map(tuple, rows)) == [("alpha", 1, 1, 3), ("beta", 1, 2, 3)]
    assert sinks.manifest(docs, "doc_id").first().doc_count == 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert timings(events).agg(F.sum("n")).first()[0] == events.count()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"trial": 1, "label": "met"}\n{"trial": 2, "label": "NEI"}\n')
    q = follow(spark, str(tmp_path / "in"), "trial long, label string", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_text_rules(spark):
    df = spark.createDataFrame(
        [("Exclusion criteria: b\nInclusion criteria: a",), ("Inclusion criteria: only",), ("none",), (None,)], "t string"
    ).select(T.split_eligibility(F.col("t")).alias("x"))
    got = [tuple(r.x) for r in df.collect()]
    assert got[0] == ("Exclusion criteria: b\nInclusion criteria: a", "") and got[1] == ("only", "") and got[2] == ("none", "")
    days = spark.createDataFrame([("within 3 months",), ("within the past 30 days",), ("2 weeks ago",), ("ongoing",), ("x",)], "t string")
    got = [(r.x.relation, r.x.days) for r in days.select(T.temporal(F.col("t")).alias("x")).collect()]
    assert got[0] == ("within", 90) and got[2] == ("within", 14) and got[3] == ("ongoing", None) and got[4] == (None, None)
