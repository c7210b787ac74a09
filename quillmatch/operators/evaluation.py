"""Ranking and classification metrics over runs, judgements and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X


def gain(grade: Column, linear: bool = False) -> Column:
    return grade.cast("double") if linear else F.pow(F.lit(2.0), grade) - 1


def topic_metrics(run: DataFrame, qrels: DataFrame, linear: bool = False) -> DataFrame:
    """NDCG@10, P@10, recall@20, reciprocal rank and average precision of each topic in ``run``.

    ``run``: topic_id, doc_id, rank.  ``qrels``: doc_id, grade for every topic,
    or topic_id, doc_id, grade.
    """
    shared = "topic_id" not in qrels.columns
    key = ["doc_id"] if shared else ["topic_id", "doc_id"]
    judged = run.join(qrels, key, "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    w = W.partitionBy("topic_id").orderBy("rank")
    judged = judged.withColumn("hits", F.sum(F.when(F.col("g") > 0, 1).otherwise(0)).over(w))
    by = [] if shared else ["topic_id"]
    best = qrels.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("grade"), "doc_id")))
    if shared:  # grades are few: their counts give the ideal order without sorting the judgements
        counts = qrels.groupBy("grade").agg(F.count("*").alias("n"))
        start = F.sum("n").over(W.orderBy(F.desc("grade"))) - F.col("n")
        best = counts.withColumn("s", start).select(
            "grade", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + F.col("n"), F.greatest(F.lit(10), F.col("s") + 1)))).alias("i")
        )
    dcg = F.sum(F.when(F.col("i") <= 10, gain(F.col("grade"), linear) / F.log2(F.col("i") + 1.0)).otherwise(0.0))
    totals = qrels.groupBy(*by).agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    best = best.groupBy(*by).agg(dcg.alias("ideal"))
    both = totals.crossJoin(best) if shared else totals.join(best, "topic_id")
    rank = F.col("rank")
    got = judged.groupBy("topic_id").agg(
        F.sum(F.when(rank <= 10, gain(F.col("g"), linear) / F.log2(rank + 1.0)).otherwise(0.0)).alias("dcg"),
        (F.count_if((rank <= 10) & (F.col("g") > 0)) / 10).alias("p10"),
        F.count_if((rank <= 20) & (F.col("g") > 0)).alias("hit20"),
        F.coalesce(F.max(F.when(F.col("g") > 0, 1 / rank)), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("g") > 0, F.col("hits") / rank).otherwise(0.0)).alias("ap"),
    )
    got = got.crossJoin(F.broadcast(both)) if shared else got.join(both, "topic_id", "left")
    safe = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return got.select(
        "topic_id",
        safe("dcg", "ideal").alias("ndcg10"),
        F.round("p10", 6).alias("p10"),
        safe("hit20", "relevant").alias("recall20"),
        F.round("rr", 6).alias("rr"),
        safe("ap", "relevant").alias("ap"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the topics of a run."""
    return metrics.agg(
        F.count("*").alias("n_topics"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg10", "p10", "recall20", "rr", "ap")]
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, predicted, n)."""
    return pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def class_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of classes 0, 1, 2, from one aggregate of the pairs."""
    by = by or []
    counts = [
        F.struct(
            F.lit(c).alias("class"),
            F.count_if((F.col("gold") == c) & (F.col("predicted") == c)).alias("tp"),
            F.count_if((F.col("gold") != c) & (F.col("predicted") == c)).alias("fp"),
            F.count_if((F.col("gold") == c) & (F.col("predicted") != c)).alias("fn"),
        )
        for c in (0, 1, 2)
    ]
    rows = pairs.groupBy(*by).agg(F.array(*counts).alias("x")).select(*by, F.inline("x"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(*by, "class", "tp", "fp", "fn", zero(p).alias("precision"), zero(r).alias("recall"), zero(f).alias("f1"))


def averages(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro F1 (equal to accuracy) and macro F1."""
    return scores.groupBy(*(by or [])).agg(
        F.round(F.try_divide(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), 6).alias("micro_f1"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
    )


def stage_hits(run: DataFrame, qrels: DataFrame, cutoffs: tuple = X.CUTOFFS) -> DataFrame:
    """Judged, relevant, eligible and unjudged hits of each topic at each cutoff, from one pass over the run."""
    judged = run.join(qrels, "doc_id", "left")
    cells = []
    for c in cutoffs:
        at = F.col("rank") <= c
        cells.append(
            F.struct(
                F.lit(c).alias("cutoff"),
                F.count_if(at & F.col("grade").isNotNull()).alias("judged"),
                F.count_if(at & (F.col("grade") > 0)).alias("relevant"),
                F.count_if(at & (F.col("grade") == 2)).alias("eligible"),
                F.count_if(at & F.col("grade").isNull()).alias("unjudged"),
            )
        )
    return judged.groupBy("topic_id").agg(F.array(*cells).alias("x")).select("topic_id", F.inline("x"))


def sweep(rows: DataFrame, fractions: list[float], nei: list[float]) -> DataFrame:
    """Labels under every policy (least share of inclusions met, most share unknown) against gold; a veto stays 1.

    ``rows``: gold, n_inc, inc_met, exc_met, fraction_nei, veto.  Equal rows are counted first, so that
    the grid meets the few distinct outcomes and not the rows.
    """
    c = F.col
    kinds = rows.groupBy("gold", "n_inc", "inc_met", (c("exc_met") > 0).alias("hit"), "fraction_nei", "veto").agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(x).alias("most_nei")) for f in fractions for x in nei])
    cells = kinds.select("*", F.posexplode(grid).alias("place", "g")).select("*", "g.fraction", "g.most_nei")
    enough = c("inc_met") >= F.greatest(F.lit(1), (c("fraction") * c("n_inc")).cast("int"))
    met = (c("n_inc") > 0) & ~c("hit") & ((c("inc_met") == c("n_inc")) | (enough & (c("fraction_nei") < c("most_nei"))))
    said = F.when(~c("veto") & met, 2).otherwise(1)
    cells = cells.withColumn("predicted", said)
    count = lambda cond: F.sum(F.when(cond, c("n")).otherwise(0))
    by = cells.groupBy("place", "fraction", "most_nei").agg(
        count((c("gold") == 2) & (c("predicted") == 2)).alias("tp"),
        count((c("gold") == 2) | (c("predicted") == 2)).alias("either"),
        count(c("gold") == c("predicted")).alias("right"),
        F.sum("n").alias("n"),
    )
    f1 = F.coalesce(F.try_divide(2 * c("tp"), c("tp") + c("either")), F.lit(0.0))
    out = by.select("place", "fraction", "most_nei", F.round(f1, 6).alias("class_2_f1"), F.round(c("right") / c("n"), 6).alias("micro_f1"))
    first = lambda *order: F.row_number().over(W.orderBy(*[F.desc(x) for x in order], "place")) == 1
    return out.select(
        "fraction", "most_nei", "class_2_f1", "micro_f1",
        first("class_2_f1", "micro_f1").alias("best_class_2"), first("micro_f1", "class_2_f1").alias("best_micro"),
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common and combined sizes and Jaccard similarity of two runs by topic."""
    both = a.select("topic_id", "doc_id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(
        b.select("topic_id", "doc_id", F.lit(0).alias("x"), F.lit(1).alias("y"))
    )
    docs = both.groupBy("topic_id", "doc_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    got = docs.groupBy("topic_id").agg(F.sum(F.col("x") * F.col("y")).alias("common"), F.count("*").alias("together"))
    return got.select("*", F.round(F.col("common") / F.col("together"), 6).alias("jaccard"))


def missing(qrels: DataFrame, corpus: DataFrame, index: DataFrame, run: DataFrame) -> DataFrame:
    """(topic_id, doc_id, reason) of each topic's relevant documents: retrieved, not_in_corpus, not_in_index, not_retrieved.

    ``qrels``: topic_id, doc_id, grade; topics without a run are left out.
    """
    want = qrels.where("grade > 0").select("topic_id", "doc_id").join(run.select("topic_id").distinct(), "topic_id", "left_semi")
    have = lambda df, name, key: df.select(*key).distinct().withColumn(name, F.lit(True))
    rows = (
        want.join(have(run, "r", ["topic_id", "doc_id"]), ["topic_id", "doc_id"], "left")
        .join(have(corpus, "c", ["doc_id"]), "doc_id", "left")
        .join(have(index, "i", ["doc_id"]), "doc_id", "left")
    )
    reason = (
        F.when(F.col("r"), "retrieved").when(F.col("c").isNull(), "not_in_corpus").when(F.col("i").isNull(), "not_in_index")
    )
    return rows.select("topic_id", "doc_id", reason.otherwise("not_retrieved").alias("reason"))
