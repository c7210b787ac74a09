"""Sinks: index tables, metadata lines, predictions and their manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators import lexical
from quillmatch.operators.retrieval import fields_of


def write_index(docs: DataFrame, path: str, fields: list[str]) -> None:
    """The line views ``fields`` of ``docs`` as a saved lexical index (`operators.lexical`), searched by terms."""
    views = fields_of(F.col("text"))
    lexical.add(docs, path, {f: views[f] for f in fields})


def write_metadata(trials: DataFrame, path: str) -> None:
    trials.select("nct_id", "title", "phase", "status", "last_update_date").write.mode("overwrite").json(path)


_NUMBERS = ("n_inclusion_met", "n_inclusion_total", "n_exclusion_met", "n_exclusion_total")


def predictions(ranked: DataFrame) -> DataFrame:
    """One row per topic with its ranked trials in order; scores to four places, shares of unknowns to three.

    ``ranked``: topic_id, nct_id, rank, score, label and, where it has them, rationale, the counts of criteria, fraction_nei
    and source (ranked, tail or excluded).
    """
    have = set(ranked.columns)
    grade = F.when(F.col("label") == "eligible", 2).when(F.col("label") == "excludes", 1).otherwise(0)
    parts = ["rank", "nct_id", F.round("score", 4).alias("score"), "label", grade.alias("predicted_trec_qrel"), grade.alias("trec_qrel")]
    parts += [c for c in ("rationale", *_NUMBERS) if c in have]
    if "fraction_nei" in have:
        parts.append(F.round("fraction_nei", 3).alias("fraction_nei"))
    if "source" in have:
        parts += [(F.col("source") == "excluded").alias("hard_excluded_fill"), (F.col("source") == "tail").alias("retrieval_tail_fill")]
    return ranked.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("ranked_trials"))


def write_predictions(ranked: DataFrame, path: str, metadata: dict) -> None:
    """One JSON object with the run's metadata and its topics in order, in the folder ``path``.

    A topic's list is as long as its output; the file is one row, so this is for runs of topics, not for corpora.
    """
    topics = predictions(ranked).agg(F.sort_array(F.collect_list(F.struct("topic_id", "ranked_trials"))).alias("topics"))
    known = F.from_json(F.lit(json.dumps({k: str(v) for k, v in metadata.items()})), "map<string,string>")
    topics.select(F.to_json(F.struct(known.alias("metadata"), "topics")).alias("value")).write.mode("overwrite").text(path)


def manifest(docs: DataFrame, key: str, version: int = 1) -> DataFrame:
    """Counts and an order-free checksum that tell whether two tables hold the same rows."""
    return docs.agg(
        F.count("*").alias("doc_count"),
        F.countDistinct(key).alias("distinct_ids"),
        F.sum(F.xxhash64(key) % 1_000_000_007).alias("checksum"),
    ).withColumn("version", F.lit(version))
