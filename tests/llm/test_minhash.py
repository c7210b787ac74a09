import random

import brute
from pyspark.sql import functions as F
from quillmatch.llm.minhash import components, near_duplicates, on_hot_key


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_dict(near_duplicates(docs, 4)) == brute.near_duplicates(rows, 4, 80)


def test_chains_and_small_sets(spark):
    rng = random.Random(3)
    rows, text = [], [f"w{i}" for i in range(60)]
    for i in range(40):  # a drifting family: neighbours are alike, the ends are not
        text[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(f"s{j}" for j in range(4 + i % 7))) for i in range(14)]
    rows += [(200, "a b"), (201, "A\tb"), (202, ""), (203, " \n "), (204, None), (205, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "'x' as bucket", "2 as digest")
    assert as_dict(near_duplicates(df, 4)) == brute.near_duplicates(rows, 4, 80)


def test_nulls_repeats_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1), (1, 1), (2, 1), (3, 3), (None, None)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_families_below_and_above(spark):
    """Families around one text: stars fail, only the exact prefixes can tell."""
    rng = random.Random(11)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(80)]
        for k in range(25):
            text = list(base)
            for _ in range(rng.randrange(1, 9)):
                text[rng.randrange(80)] = f"y{rng.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, 4, 80)
    assert as_dict(near_duplicates(df, 4)) == want
    assert 10 < len({c for _, c in want.values()}) < 70


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, a), (5, b), (9, b + " z"), (11, "c d e f g h"), (11, None), (12, a + " y"), (None, a), (20, "q r s t u"), (20, "v w x y z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(
        [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (11, 11, True), (11, 11, True), (12, 3, False), (20, 20, True), (20, 20, True)]
    )
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_hot_keys_join_whole(spark):
    many = spark.range(6000).selectExpr("id", "if(id < 2500, 0, id) as bucket")
    few = many.groupBy("bucket").agg(F.count("*").alias("k"), F.min("id").alias("least"))
    got = on_hot_key(many, few, "bucket", 6000)
    assert got.count() == 6000 and got.where("least <> if(id < 2500, 0, id)").count() == 0


def test_copies_do_not_multiply_pairs(spark, monkeypatch):
    """300 rows of each of two alike texts are two documents and one pair, whose sets are sent once."""
    from quillmatch.llm import minhash

    left, right = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(62))
    rows = [(1, left)] * 300 + [(2, right)] * 300 + [(3, "a b c d e f g"), (None, left)]
    confirmed = []
    plain = minhash._confirm

    def counted(pairs, *rest):
        out = plain(pairs, *rest)
        confirmed.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_confirm", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert confirmed == [(1, 1)]
    assert len(got) == 602 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3), (None, None)}
