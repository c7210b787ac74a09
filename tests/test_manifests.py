"""Manifests: digests, ordered reasons, drift and policies."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from quillmatch.functions import fixed as X
from quillmatch.sources import manifests as M


def judged(spark, payload, listed=X.INDEX_FIELDS):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    df = spark.createDataFrame([(text,)], "t string")
    known = F.array(*map(F.lit, listed)).cast("array<string>")
    return df.select(M.index_reasons(M.parsed(F.col("t")), known)).first()[0]


PLAIN = {"manifest_type": M.INDEX_TYPE, "index_kind": "bm25", "snapshot_date": X.SNAPSHOT_DATE, "doc_count": 3, "nct_ids_sha256": "x", "filters_applied": []}
PART = {"doc_count": 3, "nct_ids_sha256": "y"}
FIELDED = PLAIN | {"index_kind": "bm25_fielded_rrf", "nct_ids_sha256": None, "subindices": {f: PART for f in X.INDEX_FIELDS}}


def test_index_reasons(spark):
    assert judged(spark, PLAIN) == [] and judged(spark, FIELDED) == []
    for missing in (None, "", "not json", "[1]", "3"):
        assert judged(spark, missing) == ["missing_index_manifest"]
    assert judged(spark, {}) == ["invalid_manifest_type", "unsupported_index_kind", "snapshot_date_mismatch"]
    assert judged(spark, PLAIN | {"filters_applied": ["harmless", "sex_filter"], "snapshot_date": "2020-01-01"}) == ["snapshot_date_mismatch", "destructive_filters_applied"]
    assert judged(spark, PLAIN | {"nct_ids_sha256": ""}) == ["missing_nct_ids_hash"]
    few = FIELDED | {"subindices": {"all": PART | {"doc_count": 2}, "summary_description": {"doc_count": 3}}}
    assert judged(spark, few, ["all"]) == ["missing_fielded_subindices", "missing_fielded_nct_ids", "fielded_doc_count_mismatch", "missing_fielded_nct_ids_hash"]
    assert judged(spark, FIELDED | {"doc_count": 0}) == ["fielded_doc_count_mismatch"]
    assert judged(spark, PLAIN | {"filters_applied": "sex_filter", "doc_count": "many"}) == []


def aligned(spark, index, corpus, folder="/data/a", there=True):
    text = [None if x is None else json.dumps(x) for x in (index, corpus)]
    df = spark.createDataFrame([(*text, folder, there)], "i string, c string, d string, there boolean")
    return df.select(M.alignment_reasons(M.parsed(F.col("i")), M.parsed(F.col("c")), F.col("d"), F.col("there"))).first()[0]


def test_alignment(spark):
    index = PLAIN | {"corpus_manifest_path": "/m"}
    corpus = {"manifest_type": M.CORPUS_TYPE, "snapshot_date": X.SNAPSHOT_DATE, "doc_count": 3, "corpus_dir": "/data/a", "filters_applied": []}
    assert aligned(spark, index, corpus) == []
    for same in ("/data/a/", "file:///data/a", "/data/./a", "/data//a/."):
        assert aligned(spark, index, corpus, same) == [], same
    assert aligned(spark, None, corpus) == ["missing_index_manifest"]
    assert aligned(spark, PLAIN, corpus) == ["missing_corpus_manifest_path"]
    assert aligned(spark, index, None) == ["missing_or_invalid_corpus_manifest"]
    assert aligned(spark, index, corpus | {"doc_count": 4, "manifest_type": "x"}, "/data/b", False) == [
        "invalid_corpus_manifest_type", "corpus_index_doc_count_mismatch", "agent_corpus_dir_mismatch", "agent_corpus_dir_missing",
    ]
    assert aligned(spark, index, corpus | {"corpus_dir": None, "filters_applied": ["age_filter"]}) == ["corpus_destructive_filters_applied", "missing_corpus_dir_in_manifest"]


def test_digests(spark, tmp_path):
    ids = [f"N{k}" for k in range(50)]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos int")
    one = lambda d, x: d.agg(x.alias("x")).first().x
    whole = one(df, M.set_digest(F.col("id")))
    assert whole == str(sum(int(hashlib.sha256(i.encode()).hexdigest()[:15], 16) for i in ids))
    assert one(df.orderBy(F.desc("pos")).repartition(7), M.set_digest(F.col("id"))) == whole
    turned = df.withColumn("pos", 49 - F.col("pos"))
    assert one(df, M.list_digest(F.col("id"), F.col("pos"))) != one(turned, M.list_digest(F.col("id"), F.col("pos")))
    assert one(df.where("pos < 0"), M.set_digest(F.col("id"))) == "0"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("abc")
    assert [(r.size, r.sha256) for r in M.file_digests(spark, str(tmp_path)).collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]


def test_drift(spark):
    rows = lambda *x: spark.createDataFrame([*x], "lang string, id long")
    corpus = rows(("en", 1), ("en", 2), ("de", 3), ("fr", 4), ("es", 9))
    index = rows(("en", 2), ("en", 1), ("de", 7), ("fr", 4), ("fr", 4), ("it", 5))
    got = {r.lang: r.reasons for r in M.drift(corpus, index, "id", "lang").collect()}
    assert got == {
        "en": [], "de": ["ids_digest_mismatch"], "fr": ["doc_count_mismatch", "ids_digest_mismatch"],
        "es": ["not_indexed", "doc_count_mismatch", "ids_digest_mismatch"], "it": ["not_in_corpus", "doc_count_mismatch", "ids_digest_mismatch"],
    }
    assert M.drift(corpus, corpus, "id").first().reasons == []


def test_written_manifests_and_policy(spark, tmp_path):
    corpus_dir = tmp_path / "corpus"
    corpus_dir.mkdir()
    docs = spark.createDataFrame([(k, f) for k in range(6) for f in X.INDEX_FIELDS], "id long, field string")
    one = docs.where("field = 'all'")
    M.write_manifest(spark, str(tmp_path / "c"), M.corpus_manifest(one, "id", str(corpus_dir)))
    index = M.index_manifest(docs, "id", "field", corpus_manifest_path=str(tmp_path / "c"), weights={"all": 2.0})
    assert index["doc_count"] == 6 and index["subindices"]["all"]["weight"] == 2.0
    M.write_manifest(spark, str(tmp_path / "i"), index)
    assert M.check_index(spark, str(tmp_path / "i"), list(X.INDEX_FIELDS)) == []
    assert M.check_alignment(spark, str(tmp_path / "i"), str(corpus_dir)) == []
    wrong = M.check_alignment(spark, str(tmp_path / "i"), str(tmp_path / "elsewhere"))
    assert wrong == ["agent_corpus_dir_mismatch", "agent_corpus_dir_missing"]
    assert M.check_index(spark, str(tmp_path / "none"), []) == ["missing_index_manifest"]
    assert M.enforce(wrong, "off", "corpus") == M.enforce(wrong, "require", "corpus", "clinical") == "disabled"
    assert M.enforce([], "require", "corpus") == "ok"
    with pytest.warns(UserWarning, match="agent_corpus_dir_mismatch"):
        assert M.enforce(wrong, "warn", "corpus") == wrong[0]
    with pytest.raises(ValueError, match="agent_corpus_dir_missing"):
        M.enforce(wrong, "require", "corpus")
