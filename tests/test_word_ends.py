"""Word ends beside letters outside A-Z, and odd spaces, as in the SQL."""

import duckdb
from quillmatch.plans import queries as Q
from quillmatch.plans.oracle import ORACLES

TEXTS = ["o noñl x. y", "iónos cannoté; no", "ñno. ño; b", "a.\x0bno b. c", "x ongoingé 3 days ago", "éhistory of", None, "", "never\x01no. z", "at least\x0b3 weeks since", "no\x0bhistory of x", "current1 currentñ"]


def test_as_in_sql(spark, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(6 * i, j, t) for i, t in enumerate(TEXTS) for j in (2, 4)], "conv_id long, turn long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    for name in ("negation_cue", "temporal_extract", "temporal_annotate"):
        df = Q.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)), name
