"""Manifests of corpora and indexes: digests, what they must say, and whether they agree.

A manifest is JSON text, read as a VARIANT; a missing or broken one is null.
The rules give all reasons against a manifest in a fixed order, as an array
Column, so that any number of manifests is judged in one pass; the first
reason is the verdict, none is ``ok``.

Digests of tables are sums of 60 bits of each row's SHA-256: partial sums
combine before the shuffle, no row order is needed, and with a position in
the row the digest depends on the order without a sort.

Defined cases: a null manifest has one reason only; fields of another type
than expected count as missing; a count of 0 is no count; repeated ids add up
twice; an empty table has count 0 and digest 0.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.sources import folders

INDEX_TYPE, CORPUS_TYPE = "benchmark_index", "benchmark_corpus"
VERSION = 1


# --- digests -----------------------------------------------------------------------


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of every file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def set_digest(row_id: Column) -> Column:
    """An aggregate that tells tables with other ids apart, whatever their order."""
    return F.coalesce(F.sum(_bits(row_id.cast("string"))), F.lit(0).cast("decimal(38,0)")).cast("string")


def list_digest(row_id: Column, position: Column) -> Column:
    """The same for ids at positions: another order is another digest."""
    return set_digest(F.concat_ws(" ", position.cast("string"), row_id.cast("string")))


def contents(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """doc_count and ids_digest of ``rows``, per group of the columns ``by``."""
    return rows.groupBy(*by).agg(F.count("*").alias("doc_count"), set_digest(F.col(key)).alias("ids_digest"))


# --- manifests ---------------------------------------------------------------------


def write_manifest(spark: SparkSession, path: str, payload: dict) -> None:
    """``payload`` as one JSON text in the folder ``path``."""
    text = json.dumps(payload, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def corpus_manifest(rows: DataFrame, key: str, corpus_dir: str, snapshot_date: str = X.SNAPSHOT_DATE, **more) -> dict:
    """What a corpus holds, counted from its rows; ``more``: source, source_format, filters_applied."""
    found = contents(rows, key).first()
    plain = {"manifest_type": CORPUS_TYPE, "version": VERSION, "corpus_dir": corpus_dir, "snapshot_date": snapshot_date, "filters_applied": []}
    return plain | {"doc_count": found.doc_count, "ids_digest": found.ids_digest} | more


def index_manifest(rows: DataFrame, key: str, field: str | None, snapshot_date: str = X.SNAPSHOT_DATE, **more) -> dict:
    """What an index holds; with ``field``, a column that names each row's field, a fielded one with a part per field."""
    plain = {"manifest_type": INDEX_TYPE, "version": VERSION, "snapshot_date": snapshot_date, "filters_applied": []}
    if field is None:
        found = contents(rows, key).first()
        return plain | {"index_kind": "bm25", "doc_count": found.doc_count, "nct_ids_sha256": found.ids_digest} | more
    # one row per field
    parts = {
        r[field]: {"doc_count": r.doc_count, "nct_ids_sha256": r.ids_digest, "weight": float(more.get("weights", {}).get(r[field], 1.0))}
        for r in contents(rows, key, field).collect()
    }
    most = max((p["doc_count"] for p in parts.values()), default=0)
    return plain | {"index_kind": "bm25_fielded_rrf", "doc_count": most, "subindices": parts} | more


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row with the manifest as VARIANT ``manifest``, null where it is missing, broken or no object."""
    empty = spark.range(1).select(F.lit(None).cast("string").alias("value"))
    if not folders.exists(spark, path):
        return empty.select(parsed(F.col("value")).alias("manifest"))
    # one row whatever the folder holds: an empty one is a missing manifest
    text = spark.read.option("wholetext", True).text(path).agg(F.max("value").alias("value"))
    return text.select(parsed(F.col("value")).alias("manifest"))


def parsed(text: Column) -> Column:
    """JSON text as a VARIANT, null if it is no object."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


# --- rules -------------------------------------------------------------------------


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def _count(v: Column, path: str, none: int) -> Column:
    n = F.try_variant_get(v, f"$.{path}", "long")
    return F.when(n.isNull() | (n == 0), F.lit(none)).otherwise(n)


def _filters(v: Column) -> Column:
    found = F.coalesce(F.try_variant_get(v, "$.filters_applied", "array<string>"), F.array().cast("array<string>"))
    return F.array_sort(F.array_intersect(found, F.array(*map(F.lit, X.DESTRUCTIVE_FILTERS))))


def _reasons(v: Column, missing: str, rules: list[tuple[str, Column]]) -> Column:
    found = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])
    none = F.array().cast("array<string>")
    return F.when(v.isNull(), F.array(F.lit(missing))).otherwise(F.coalesce(F.filter(found, lambda x: x.isNotNull()), none))


def index_reasons(v: Column, listed: Column, expected_date: str = X.SNAPSHOT_DATE) -> Column:
    """All that speaks against an index manifest; ``listed``: the fields whose id lists exist."""
    kind = _text(v, "index_kind")
    fielded = F.coalesce(kind == "bm25_fielded_rrf", F.lit(False))
    part = {f: F.try_variant_get(v, f"$.subindices.{f}", "variant") for f in X.INDEX_FIELDS}
    any_part = lambda bad: fielded & F.greatest(*[p.isNotNull() & F.coalesce(bad(f, p), F.lit(True)) for f, p in part.items()])
    rules = [
        ("invalid_manifest_type", ~_text(v, "manifest_type").eqNullSafe(INDEX_TYPE)),
        ("unsupported_index_kind", ~F.coalesce(kind.isin(*X.INDEX_KINDS), F.lit(False))),
        ("snapshot_date_mismatch", ~_text(v, "snapshot_date").eqNullSafe(expected_date)),
        ("destructive_filters_applied", F.size(_filters(v)) > 0),
        ("missing_nct_ids_hash", kind.eqNullSafe("bm25") & (F.coalesce(_text(v, "nct_ids_sha256"), F.lit("")) == "")),
        ("missing_fielded_subindices", fielded & F.greatest(*[p.isNull() for p in part.values()])),
        ("missing_fielded_nct_ids", any_part(lambda f, p: ~F.array_contains(listed, f))),
        ("fielded_doc_count_mismatch", any_part(lambda f, p: _count(p, "doc_count", -1) != _count(v, "doc_count", -2))),
        ("missing_fielded_nct_ids_hash", any_part(lambda f, p: F.coalesce(_text(p, "nct_ids_sha256"), F.lit("")) == "")),
    ]
    return _reasons(v, "missing_index_manifest", rules)


def plain_path(path: Column) -> Column:
    """A path without ``file:``, ``/./``, repeated and closing slashes."""
    flat = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"/(\./)+", "/")
    return F.regexp_replace(F.regexp_replace(flat, "/+", "/"), r"(.)/\.?$", "$1")


def alignment_reasons(index: Column, corpus: Column, corpus_dir: Column, there: Column, expected_date: str = X.SNAPSHOT_DATE) -> Column:
    """All that speaks against using the corpus in ``corpus_dir`` with an index; ``there``: whether that folder exists."""
    said = _text(corpus, "corpus_dir")
    rules = [
        ("invalid_corpus_manifest_type", ~_text(corpus, "manifest_type").eqNullSafe(CORPUS_TYPE)),
        ("corpus_snapshot_date_mismatch", ~_text(corpus, "snapshot_date").eqNullSafe(expected_date)),
        ("corpus_destructive_filters_applied", F.size(_filters(corpus)) > 0),
        ("corpus_index_doc_count_mismatch", _count(corpus, "doc_count", -1) != _count(index, "doc_count", -2)),
        ("missing_corpus_dir_in_manifest", F.coalesce(said, F.lit("")) == ""),
        ("agent_corpus_dir_mismatch", (F.coalesce(said, F.lit("")) != "") & (plain_path(said) != plain_path(corpus_dir))),
        ("agent_corpus_dir_missing", ~there),
    ]
    path = F.coalesce(_text(index, "corpus_manifest_path"), F.lit(""))
    return (
        F.when(index.isNull(), F.array(F.lit("missing_index_manifest")))
        .when(path == "", F.array(F.lit("missing_corpus_manifest_path")))
        .otherwise(_reasons(corpus, "missing_or_invalid_corpus_manifest", rules))
    )


def drift(corpus: DataFrame, index: DataFrame, key: str, *by: str) -> DataFrame:
    """The columns ``by``, counts of both sides and ``reasons`` why their rows aren't the same documents."""
    a, b = contents(corpus, key, *by), contents(index, key, *by)
    if by:
        both = a.join(b.toDF(*by, "n", "d"), list(by), "full")
    else:
        both = a.crossJoin(b.toDF("n", "d"))  # one row each
    n, m = F.coalesce("doc_count", F.lit(0)), F.coalesce("n", F.lit(0))
    rules = [
        ("not_indexed", (n > 0) & (m == 0)),
        ("not_in_corpus", (n == 0) & (m > 0)),
        ("doc_count_mismatch", n != m),
        ("ids_digest_mismatch", ~F.col("ids_digest").eqNullSafe(F.col("d"))),
    ]
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return both.select(*by, n.alias("corpus_count"), m.alias("index_count"), reasons.alias("reasons"))


# --- policy ------------------------------------------------------------------------


def verdict(reasons: Column) -> Column:
    """The first reason, or ``ok``."""
    return F.coalesce(F.get(reasons, F.lit(0)), F.lit("ok"))


def enforce(reasons: list[str], policy: str, what: str, mode: str = "benchmark") -> str:
    """``disabled``, ``ok`` or the first reason; policy ``warn`` warns of it, ``require`` raises."""
    if policy not in ("off", "warn", "require"):
        raise ValueError("a policy is off, warn or require")
    if mode != "benchmark" or policy == "off":
        return "disabled"
    if not reasons:
        return "ok"
    message = f"{what}: {', '.join(reasons)}"
    if policy == "require":
        raise ValueError(message)
    warnings.warn(message, stacklevel=2)
    return reasons[0]


def check_index(spark: SparkSession, path: str, listed: list[str], expected_date: str = X.SNAPSHOT_DATE) -> list[str]:
    """Reasons against the index manifest at ``path``."""
    known = F.array(*map(F.lit, listed)).cast("array<string>")
    return load(spark, path).select(index_reasons(F.col("manifest"), known, expected_date)).first()[0]


def check_alignment(spark: SparkSession, index_path: str, corpus_dir: str, expected_date: str = X.SNAPSHOT_DATE) -> list[str]:
    """Reasons against the corpus in ``corpus_dir`` by the index manifest and the corpus manifest that it names."""
    index = load(spark, index_path).select(F.col("manifest").alias("index"))
    named = index.select(_text(F.col("index"), "corpus_manifest_path")).first()[0]
    corpus = load(spark, named or f"{index_path}/no manifest").select(F.col("manifest").alias("corpus"))
    pair = index.crossJoin(corpus)  # one row each
    there = F.lit(folders.exists(spark, corpus_dir))
    return pair.select(alignment_reasons(F.col("index"), F.col("corpus"), F.lit(corpus_dir), there, expected_date)).first()[0]
