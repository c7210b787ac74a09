import brute
import corpus_pipeline
import pytest
from quillmatch.llm.substring import without_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert docs.columns == columns
        out = {r.doc_id: r.text for r in docs.collect()}
        assert len(out) == docs.count() and set(out) <= set(rows)
        if name == "quality rules":
            for i, t in rows.items():
                n, chars, symbols, dups, repeats = brute.measures(t)
                if n < 50 or 100 * repeats > 50 * n or 10 * symbols > n:
                    assert i not in out
            assert len(out) > len(rows) / 2
        if name == "near dedup":
            groups = brute.near_duplicates(list(rows.items()), 5, 80)
            assert set(out) == {i for i, (_, c) in groups.items() if c == i}
        if name == "substring dedup":
            gone = brute.removed_words(list(rows.items()), 35)
            for (i, t), g in zip(rows.items(), gone.values()):
                kept = [w for j, w in enumerate(brute.words(t)) if j not in g]
                assert brute.words(out[i]) == kept
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(out) == {i for i, t in rows.items() if not brute.contaminated(t, items)}
        rows = out
    pieces = docs.toPandas()
    assert set(pieces.doc_id) == set(rows)
    whole = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, pieces[key].values.tolist()))


@pytest.mark.parametrize("k", range(5))
def test_odd_tables(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    schema = "owner int, doc_id long, text string, lang string, source string, n_chars long, marks string"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, 1, text, None, None, None, "x"), (2, 2, None, "en", "s", 0, None), (3, None, text, "en", "s", 1, "y"), (4, 4, "", None, None, 0, "")]
    rows += [(5, 5, text + " end", "en", "s", 1, "y")] * 2
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, SF)
    if k < 4:
        assert out.columns == df.columns
    assert len(out.collect()) >= 1
    assert stage(spark, df.where("false"), SF).count() == 0


def test_null_text_stays(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "a  b", 4)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in without_repeats(df).collect()) == [(1, None), (2, "a  b")]
