"""Every query of profiles, criteria, ranking steps, audits, access and manifests against its SQL on DuckDB."""

import pytest
from quillmatch.plans import access, diagnosis, matching
from test_oracles import SF, duck, rows_of  # noqa: F401

QUERIES = matching.QUERIES | access.QUERIES | diagnosis.QUERIES
ORACLES = matching.ORACLES | access.ORACLES | diagnosis.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == b
