"""Texts of documents that are no candidates stay where they are, and the run is made once."""

from quillmatch.operators import ranking as G
from quillmatch.operators import selection as S
from quillmatch.plans import matching as N
from quillmatch.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_candidates_are_joined(spark):
    run = Q.bm25_topk(spark, SF).where("topic_id < 3")
    people = Q.topics(spark, SF).selectExpr("topic_id", "text AS conditions", "text AS treatments")
    told = N.texts(spark, SF).selectExpr("doc_id", "title AS titles", "raw_text AS treatments")
    found = S.irrelevance_signals(run, people, told)
    assert "MapInArrow" not in plan(found) and "LeftSemi, (doc_id" in plan(found)
    assert any("LeftSemi" in line and "strategy=broadcast" in line for line in plan(found).splitlines())
    assert found.count() == run.count() > 0
    shown = plan(N._entity(spark, SF))
    assert "MapInArrow" not in shown and any("LeftSemi" in line and "strategy=broadcast" in line for line in shown.splitlines())
    assert G.cut is S.cut
