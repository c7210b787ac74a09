"""Stage audits, error reports, ablations and calibration over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.operators.eligibility import KEY
from quillmatch.operators.evaluation import class_scores, gain, summary, topic_metrics
from quillmatch.operators.retrieval import top


def stage_traces(runs: DataFrame) -> DataFrame:
    """(topic_id, stage, ids): distinct ids in order under each stage's long and short name.

    ``runs``: topic_id, stage, place, doc_id.
    """
    firsts = runs.groupBy("topic_id", "stage", "doc_id").agg(F.min("place").alias("place"))
    lists = firsts.groupBy("topic_id", "stage").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("x"))
    ids = lists.select("topic_id", "stage", F.transform("x", lambda r: r["doc_id"]).alias("ids"))
    short = F
    for name, alias in X.STAGES.items():
        short = short.when(F.col("stage") == name, F.lit(alias))
    names = F.array_compact(F.array(F.col("stage"), short.otherwise(F.lit(None).cast("string"))))
    return ids.select("topic_id", F.explode(names).alias("stage"), "ids")


def stage_audit(runs: DataFrame, qrels: DataFrame, stages: list[str], cutoffs: tuple = X.STAGE_CUTOFFS) -> DataFrame:
    """Hits and recalls of each topic, stage and cutoff; a stage missing under its long name is read under its short one.

    ``runs``: topic_id, stage, place, doc_id; ``qrels``: topic_id, doc_id, grade.
    """
    wanted = None
    for name in stages:
        kind = F.when(F.col("stage") == name, 0).when(F.col("stage") == X.STAGES[name], 1)
        part = runs.withColumn("kind", kind).where("kind is not null").withColumn("stage", F.lit(name))
        wanted = part if wanted is None else wanted.unionAll(part)
    wanted = wanted.withColumn("least", F.min("kind").over(W.partitionBy("topic_id", "stage"))).where("kind = least")
    firsts = wanted.groupBy("topic_id", "stage", "doc_id").agg(F.min("place").alias("place"))
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("topic_id", "stage").orderBy("place")))
    judged = ranked.join(qrels, ["topic_id", "doc_id"], "left")
    cells = []
    for c in cutoffs:
        at = F.col("rank") <= c
        cells.append(
            F.struct(
                F.lit(c).alias("cutoff"),
                F.count_if(at).alias("shown"),
                F.count_if(at & F.col("grade").isNotNull()).alias("judged"),
                F.count_if(at & (F.col("grade") > 0)).alias("relevant"),
                F.count_if(at & (F.col("grade") == 2)).alias("eligible"),
            )
        )
    rows = judged.groupBy("topic_id", "stage").agg(F.array(*cells).alias("x")).select("topic_id", "stage", F.inline("x"))
    totals = qrels.groupBy("topic_id").agg(F.count_if(F.col("grade") > 0).alias("all_rel"), F.count_if(F.col("grade") == 2).alias("all_eli"))
    rows = rows.join(totals, "topic_id", "left")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return rows.select(
        "topic_id", "stage", "cutoff", "judged", "relevant", "eligible",
        share("relevant", "all_rel").alias("recall_relevant"),
        share("eligible", "all_eli").alias("recall_eligible"),
        share("judged", "shown").alias("judged_fraction"),
    )


def missing_traces(topics: DataFrame, runs: DataFrame, stage: str) -> DataFrame:
    """Topics that recorded ``stage`` under neither of its names."""
    seen = runs.where(F.col("stage").isin(stage, X.STAGES[stage])).select("topic_id").distinct()
    return topics.select("topic_id").join(seen, "topic_id", "left_anti")


def error_topics(rows: DataFrame) -> DataFrame:
    """Per topic: ranked, relevant and eligible, their first ranks, disagreements, false positives among the first ten.

    ``rows``: topic_id, rank, gold (0 if unjudged), predicted.
    """
    c = F.col
    return rows.groupBy("topic_id").agg(
        F.count("*").alias("ranked"),
        F.count_if(c("gold") > 0).alias("relevant"),
        F.count_if(c("gold") == 2).alias("eligible"),
        F.min(F.when(c("gold") > 0, c("rank"))).alias("first_relevant_rank"),
        F.min(F.when(c("gold") == 2, c("rank"))).alias("first_eligible_rank"),
        F.count_if(c("gold") != c("predicted")).alias("disagreements"),
        F.count_if((c("rank") <= 10) & (c("gold") == 0) & (c("predicted") > 0)).alias("top10_false_positives"),
    )


def representatives(rows: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` worst disagreements: widest gap of grades, then lowest rank, then highest score."""
    gap = F.abs(F.col("gold") - F.col("predicted"))
    wrong = rows.where("gold <> predicted").withColumn("gap", gap)
    return wrong.orderBy(F.desc("gap"), F.asc("rank"), F.desc_nulls_last("score"), F.asc("topic_id"), F.asc("doc_id")).limit(k)


def ablations(runs: dict[str, DataFrame], qrels: DataFrame) -> DataFrame:
    """The metric means of each named variant."""
    out = None
    for name, run in runs.items():
        row = summary(topic_metrics(run, qrels)).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def criterion_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Class scores of criterion labels over the rows both sides hold (topic_id, trial, criterion, label)."""
    code = lambda c: F.when(c == "met", 0).when(c == "not_met", 1).otherwise(2)
    both = predicted.select(*KEY, "criterion", code(F.col("label")).alias("predicted")).join(
        gold.select(*KEY, "criterion", code(F.col("label")).alias("gold")), [*KEY, "criterion"]
    )
    return class_scores(both)


def grid_search(rows: DataFrame, components: list[str], grid: list[tuple]) -> DataFrame:
    """Mean NDCG@10 of each weighting of ``components``, best first: what calibration maximises.

    ``rows``: topic_id, doc_id, grade and the components.  Scores of all weightings are made in one pass.
    """
    cells = []
    for place, weights in enumerate(grid):
        score = sum((F.lit(float(w)) * F.col(c) for c, w in zip(components, weights)), F.lit(0.0))
        cells.append(F.struct(F.lit(place).alias("place"), F.round(score, 9).alias("score")))
    scored = rows.select("topic_id", "doc_id", "grade", F.inline(F.array(*cells)))
    ranked = top(scored, ["place", "topic_id"], [F.desc("score"), F.asc("doc_id")], 10)
    got = ranked.groupBy("place", "topic_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    order = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = rows.withColumn("i", order).where("i <= 10").groupBy("topic_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("i") + 1.0)).alias("ideal"))
    share = F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))
    means = got.join(ideal, "topic_id").groupBy("place").agg(F.round(F.avg(share), 6).alias("ndcg10"))
    return means.withColumn("best", F.row_number().over(W.orderBy(F.desc("ndcg10"), "place")) == 1)


def parse_grid(text: str) -> list[float]:
    return [float(part) for part in text.split(",") if part.strip()]
