"""How far retrieval gets, stage by stage: all topics and stages from one pass over the corpus.

The runs of all stages are rows of one table (stage, topic_id, doc_id, rank).
The lexical stages come from one search of all fields, so the corpus is read
and tokenised once; every report below is an aggregate of that table.

Defined cases: a stage without hits for a topic has zeros; unjudged documents
have no grade; topics without judgements have recall 0; a document counts once
per stage, at its best rank; empty tables give empty reports.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.operators.evaluation import missing, overlap
from quillmatch.operators.lineage import cut
from quillmatch.operators.retrieval import bm25, fuse

RUN = ["stage", "topic_id", "doc_id", "rank"]


class Audit(NamedTuple):
    #: topic_id, stage, cutoff, hits by grade, recalls, judged share
    stages: DataFrame
    #: stage, cutoff, means over topics, topics without a relevant or eligible hit
    aggregate: DataFrame
    #: topic_id, stage, reason, n
    missing: DataFrame
    #: topic_id, common, together, jaccard
    overlap: DataFrame
    #: side, label, total, covered, missing, coverage
    coverage: DataFrame


def runs_of(
    docs: DataFrame, topics: DataFrame, k: int, dense: DataFrame | None = None, fused_k: int = 200,
    field_k: int = 1000, weights: dict | None = None, mix: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """(stage, topic_id, doc_id, rank): ``bm25_field_*``, ``bm25``, ``dense`` and ``fused``; the corpus is searched once.

    ``dense``: topic_id, doc_id, rank, if there is such a run; ``mix`` weighs the lexical and it.
    """
    weights = weights or X.FIELD_WEIGHTS
    fields = cut(bm25(docs, topics, field_k, list(weights)))
    lexical = fuse(fields.withColumnRenamed("field", "source"), k, weights).select("topic_id", "doc_id", "rank")
    out = fields.select(F.concat(F.lit("bm25_field_"), "field").alias("stage"), "topic_id", "doc_id", "rank")
    both = lexical.withColumn("source", F.lit("bm25"))
    out = out.unionByName(lexical.withColumn("stage", F.lit("bm25")))
    if dense is not None:
        dense = dense.select("topic_id", "doc_id", "rank")
        out = out.unionByName(dense.withColumn("stage", F.lit("dense")))
        both = both.unionByName(dense.withColumn("source", F.lit("dense")))
    fused = fuse(both, fused_k, {"bm25": mix[0], "dense": mix[1]}).select("topic_id", "doc_id", "rank")
    return cut(out.unionByName(fused.withColumn("stage", F.lit("fused"))))


def _hits(at: Column) -> list[Column]:
    g = F.col("grade")
    kinds = {"shown": at, "judged": at & g.isNotNull(), "relevant": at & (g > 0), "eligible": at & (g == 2), "excludes": at & (g == 1), "irrelevant": at & (g == 0)}
    return [F.count_if(cond).alias(name) for name, cond in kinds.items()]


def stage_table(runs: DataFrame, topics: DataFrame, qrels: DataFrame, cutoffs: tuple = X.CUTOFFS) -> DataFrame:
    """topic_id, stage, cutoff and the hits of every topic at every stage that any topic reached."""
    names = [r.stage for r in runs.select("stage").distinct().collect()]  # as many as there are stages
    first = runs.groupBy("stage", "topic_id", "doc_id").agg(F.min("rank").alias("rank"))
    judged = first.join(qrels, ["topic_id", "doc_id"], "left")
    cells = [F.struct(F.lit(c).alias("cutoff"), *_hits(F.col("rank") <= c)) for c in cutoffs]
    got = judged.groupBy("topic_id", "stage").agg(F.array(*cells).alias("x")).select("topic_id", "stage", F.inline("x"))
    every = topics.select("topic_id").distinct().select("topic_id", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("stage"))
    every = every.select("*", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))
    totals = qrels.groupBy("topic_id").agg(F.count_if(F.col("grade") > 0).alias("all_rel"), F.count_if(F.col("grade") == 2).alias("all_eli"))
    rows = every.join(got, ["topic_id", "stage", "cutoff"], "left").join(totals, "topic_id", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0)), 6)
    return rows.select(
        "topic_id", "stage", "cutoff",
        *[n(x).alias(x) for x in ("judged", "relevant", "eligible", "excludes", "irrelevant")],
        (n("shown") - n("judged")).alias("unjudged"),
        share("relevant", "all_rel").alias("recall_relevant"),
        share("eligible", "all_eli").alias("recall_eligible"),
        share("judged", "shown").alias("judged_fraction"),
    )


def stage_means(stages: DataFrame) -> DataFrame:
    """stage, cutoff, the means over topics, and how many and which topics have no relevant or no eligible hit."""
    # shares have six places, so their mean may lie halfway between two roundings: a nudge keeps it on one side
    means = [F.round(F.avg(c) + 1e-9, 6).alias(f"mean_{c}") for c in ("judged", "relevant", "eligible", "unjudged", "recall_relevant", "recall_eligible", "judged_fraction")]
    without = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) == 0, F.col("topic_id"))))
    rows = stages.groupBy("stage", "cutoff").agg(*means, without("relevant").alias("zero_relevant"), without("eligible").alias("zero_eligible"))
    return rows.select("*", F.size("zero_relevant").alias("n_zero_relevant"), F.size("zero_eligible").alias("n_zero_eligible"))


def coverage(qrels: DataFrame, corpus: DataFrame, index: DataFrame) -> DataFrame:
    """side, label, total, covered, missing, coverage: different judged documents that the corpus and the index hold.

    ``label``: all_judged, relevant_1or2 and eligible_2 by any topic's judgement.
    """
    there = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    docs = qrels.groupBy("doc_id").agg(F.max(F.col("grade") > 0).alias("relevant"), F.max(F.col("grade") == 2).alias("eligible"))
    rows = docs.join(there(corpus, "corpus"), "doc_id", "left").join(there(index, "index"), "doc_id", "left")
    labels = {"all_judged": F.lit(True), "relevant_1or2": F.col("relevant"), "eligible_2": F.col("eligible")}
    cells = [
        F.struct(F.lit(side).alias("side"), F.lit(label).alias("label"), F.count_if(kind).alias("total"), F.count_if(kind & F.col(side)).alias("covered"))
        for side in ("corpus", "index")
        for label, kind in labels.items()
    ]
    got = rows.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    share = F.round(F.coalesce(F.try_divide("covered", "total"), F.lit(0.0)), 6)
    return got.select("*", (F.col("total") - F.col("covered")).alias("missing"), share.alias("coverage"))


def audit(
    runs: DataFrame, topics: DataFrame, qrels: DataFrame, corpus: DataFrame, index: DataFrame,
    cutoffs: tuple = X.CUTOFFS, overlap_at: int = 100, explained: tuple = ("bm25", "fused"),
) -> Audit:
    """All reports on ``runs`` (`runs_of`); ``qrels``: topic_id, doc_id, grade; ``corpus``, ``index``: doc_id."""
    stages = stage_table(runs, topics, qrels, cutoffs)
    lost = None
    for name in explained:
        rows = missing(qrels, corpus, index, runs.where(F.col("stage") == name)).withColumn("stage", F.lit(name))
        lost = rows if lost is None else lost.unionByName(rows)
    lost = lost.groupBy("topic_id", "stage", "reason").agg(F.count("*").alias("n"))
    one = lambda name: runs.where((F.col("stage") == name) & (F.col("rank") <= overlap_at))
    return Audit(stages, stage_means(stages), lost, overlap(one("bm25"), one("dense")), coverage(qrels, corpus, index))
