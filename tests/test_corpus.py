"""Random access by id: what is read again, what is pruned, which study counts."""

import json
import os

from quillmatch.sources import corpus as C
from quillmatch.sources import readers as R


def page(folder, name, *studies):
    (folder / name).write_text(json.dumps([{"protocolSection": {"identificationModule": {"nctId": i, "briefTitle": t}}} for i, t in studies]))


def ask(spark, index, *wanted):
    df = spark.createDataFrame([(w,) for w in wanted], "id string")
    return {r.nct_id: r.title for r in C.look_up(spark, index, df).collect()}


def test_pages_are_read_once(spark, tmp_path):
    dump, index = tmp_path / "dump", str(tmp_path / "index")
    dump.mkdir()
    page(dump, "page_00000.json", ("N1", "one"), ("N2", "two"))
    page(dump, "page_00001.json", ("N3", "three"))
    page(dump, "page_00002.json", ("N4", "four"), ("", "no id"))
    assert C.refresh(spark, str(dump), index) == C.Refresh(0, 3, 0, 0)
    assert C.refresh(spark, str(dump), index) == C.Refresh(0, 0, 3, 0)
    assert {r.id for r in C.ids(spark, index).collect()} == {"N1", "N2", "N3", "N4"}
    assert ask(spark, index, "N1", "N4", "N9", None) == {"N1": "one", "N4": "four"}
    # one of three files changes: only it is read, its old entries no longer count
    page(dump, "page_00001.json", ("N3", "three again"), ("N5", "five"))
    assert C.refresh(spark, str(dump), index) == C.Refresh(1, 1, 2, 0)
    written = spark.read.parquet(f"{index}/entries").where("generation = 1")
    assert {os.path.basename(r.path) for r in written.collect()} == {"page_00001.json"}
    assert ask(spark, index, "N1", "N3", "N5") == {"N1": "one", "N3": "three again", "N5": "five"}
    (dump / "page_00000.json").unlink()
    assert C.refresh(spark, str(dump), index) == C.Refresh(2, 0, 2, 1)
    assert ask(spark, index, "N1", "N3") == {"N3": "three again"}


def test_the_last_study_of_an_id_counts(spark, tmp_path):
    dump, index = tmp_path / "dump", str(tmp_path / "index")
    dump.mkdir()
    page(dump, "page_00000.json", ("N1", "first"), ("N2", "early"), ("N2", "late"))
    page(dump, "page_00001.json", ("N1", "last"))
    (dump / "page_00002.json").write_text("[ broken")
    (dump / "other.xml").write_text("<clinical_study><id_info><nct_id>X</nct_id></id_info></clinical_study>")
    assert C.refresh(spark, str(dump), index).read == 3  # XML counts only without pages
    assert ask(spark, index, "N1", "N2", "X") == {"N1": "last", "N2": "late"}
    assert C.refresh(spark, str(dump), index).read == 0  # the broken file is remembered


def test_xml_and_empty(spark, tmp_path):
    dump, index = tmp_path / "xml", str(tmp_path / "index")
    (dump / "deep").mkdir(parents=True)
    assert C.refresh(spark, str(dump), index) == C.Refresh(0, 0, 0, 0)
    assert ask(spark, index, "N1") == {} and C.ids(spark, index).count() == 0
    for n in range(3):
        text = f"<clinical_study><id_info><nct_id>N{n}</nct_id></id_info><brief_title>t\n{n}</brief_title></clinical_study>"
        (dump / "deep" / f"N{n}.xml").write_text(text)
    (dump / "bad.xml").write_text("<clinical_study><id_info>")
    assert C.refresh(spark, str(dump), index).read == 4
    assert ask(spark, index, "N0", "N2", "N7") == {"N0": "t 0", "N2": "t 2"}


def test_version(spark, tmp_path, monkeypatch):
    dump, index = tmp_path / "dump", str(tmp_path / "index")
    dump.mkdir()
    page(dump, "page_00000.json", ("N1", "one"))
    C.refresh(spark, str(dump), index)
    monkeypatch.setattr(C, "VERSION", 2)
    assert C.refresh(spark, str(dump), index).read == 1
    assert ask(spark, index, "N1") == {"N1": "one"}


def test_look_up_prunes_buckets(spark, tmp_path):
    dump, index = tmp_path / "dump", str(tmp_path / "index")
    dump.mkdir()
    for f in range(4):
        page(dump, f"page_0000{f}.json", *[(f"N{f}_{k}", "t") for k in range(50)])
    C.refresh(spark, str(dump), index, buckets=16)
    at = C.locate(spark, index, spark.createDataFrame([("N2_7",)], "id string"))
    plan = at._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [(r.id, os.path.basename(r.path), r.position) for r in at.collect()] == [("N2_7", "page_00002.json", 7)]


def test_beyond_the_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "NAMED", 2)
    dump, index = tmp_path / "dump", str(tmp_path / "index")
    dump.mkdir()
    for f in range(4):
        page(dump, f"page_0000{f}.json", (f"N{f}", f"t{f}"), (f"M{f}", "no"))
    C.refresh(spark, str(dump), index)
    assert ask(spark, index, "N0", "N1", "N2", "N3") == {f"N{f}": f"t{f}" for f in range(4)}


def test_probe_parses_ids_only(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<clinical_study><id_info><nct_id>N1</nct_id></id_info><brief_title>t</brief_title></clinical_study>")
    probe = C.id_probe(spark, [str(tmp_path / "a.xml")], "xml")
    scan = probe._jdf.queryExecution().executedPlan().toString()
    assert "brief_title" not in scan and [r.id for r in probe.collect()] == ["N1"]
    assert R.studies_xml(spark, str(tmp_path)).count() == 1
