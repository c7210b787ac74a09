"""Entity and negation evidence, and the order steps after retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions.text import clamp, entity_terms, negated_terms, overlap_cosine
from quillmatch.operators.lineage import cut
from quillmatch.operators.retrieval import fuse, min_max, small, top


def _all(*parts: Column) -> Column:
    return F.array_join(F.transform(F.array(*parts), lambda x: F.coalesce(x, F.lit(""))), " ")


def person_terms(people: DataFrame) -> DataFrame:
    """topic_id, own_sex and the term sets of each person.

    ``people``: topic_id, sex, diagnoses, biomarkers, treatments, comorbidities (arrays of strings), note.
    """
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), " ")
    rows = people.select(
        "topic_id",
        F.col("sex").alias("own_sex"),
        entity_terms(text("diagnoses"), True).alias("disease"),
        entity_terms(text("biomarkers")).alias("biomarker"),
        entity_terms(text("treatments"), True).alias("treatment"),
        entity_terms(text("comorbidities"), True).alias("comorbidity"),
        negated_terms(F.col("note")).alias("negated"),
        entity_terms(F.col("note"), True).alias("said"),
    )
    specific = F.array_distinct(F.concat("disease", "biomarker", "treatment", "comorbidity"))
    return rows.withColumn("specific", specific).withColumn(
        "positive", F.array_union("specific", F.array_except("said", "negated"))
    ).drop("said")


def trial_terms(trials: DataFrame) -> DataFrame:
    """doc_id, trial_sex and the term sets of each trial (columns of a trial, and sex)."""
    c = F.col
    words = lambda x: F.array_join(x, " ")
    includes = F.when(F.coalesce("inclusion_text", F.lit("")) != "", c("inclusion_text")).otherwise(c("raw_text"))
    told = [F.coalesce(c(x), F.lit("")) for x in ("title", "official_title", "brief_summary", "detailed_description", "raw_text")]
    rows = trials.select(
        "doc_id",
        c("sex").alias("trial_sex"),
        entity_terms(_all(c("title"), c("official_title"), words("conditions"), words("keywords")), True).alias("title_condition"),
        entity_terms(_all(words("interventions"), c("brief_summary"), c("detailed_description"))).alias("intervention"),
        entity_terms(includes, True).alias("inclusion"),
        entity_terms(c("exclusion_text"), True).alias("exclusion"),
        negated_terms(F.array_join(F.array(*told), "\n")).alias("trial_negated"),
    )
    return rows.withColumn("every", F.array_distinct(F.concat("title_condition", "intervention", "inclusion", "exclusion")))


def entity_components() -> list[Column]:
    """The components of a row of `person_terms` joined with `trial_terms`, rounded to four places."""
    c = F.col
    meet = lambda a, b: F.array_sort(F.array_intersect(a, b))
    disease = overlap_cosine(F.array_union("disease", "comorbidity"), c("title_condition"))
    biomarker = overlap_cosine(c("biomarker"), c("every"))
    intervention = overlap_cosine(c("treatment"), F.array_union("intervention", "inclusion"))
    inclusion, exclusion = overlap_cosine(c("positive"), c("inclusion")), overlap_cosine(c("positive"), c("exclusion"))
    theirs = meet(c("negated"), F.array_distinct(F.concat("title_condition", "intervention", "inclusion")))
    ours = meet(c("trial_negated"), c("positive"))
    penalty = F.least(F.lit(1.0), 0.25 * (F.size(theirs) + F.size(ours)))
    shared, own = meet(c("positive"), c("every")), meet(c("specific"), c("every"))
    generic = (F.size(shared) > 0) & (F.size(own) == 0)
    unsure = (c("own_sex") == "unknown") | (c("trial_sex") == "ALL")
    sex = F.when(unsure, 0.5).when(F.upper("own_sex") == c("trial_sex"), 1.0).otherwise(0.0)
    support = F.greatest(disease, biomarker, intervention, inclusion)
    score = clamp(
        0.4 * disease
        + 0.2 * inclusion
        + 0.18 * F.greatest(biomarker, intervention)
        + F.when(support >= 0.05, 0.08 * sex).otherwise(0.0)
        - 0.18 * exclusion
        - 0.24 * penalty
        - F.when(generic, 0.08).otherwise(0.0)
    )
    near = lambda x: F.round(x + 1e-9, 4)  # noqa: E731  a nudge keeps halves on one side
    first = lambda x: F.slice(x, 1, 12)
    return [
        near(score).alias("entity_score"),
        near(disease).alias("disease_support"),
        near(biomarker).alias("biomarker_support"),
        near(intervention).alias("intervention_support"),
        near(inclusion).alias("inclusion_support"),
        near(exclusion).alias("exclusion_overlap"),
        near(penalty).alias("negation_penalty"),
        sex.alias("sex_alignment"),
        generic.alias("generic_only_match"),
        first(shared).alias("positive_overlap_terms"),
        first(own).alias("specific_overlap_terms"),
        first(theirs).alias("patient_negated_trial_terms"),
        first(ours).alias("trial_negated_patient_terms"),
    ]


def entity_evidence(run: DataFrame, people: DataFrame, trials: DataFrame) -> DataFrame:
    """``run`` with the entity components; candidates without a trial keep nulls."""
    run = cut(run)  # counted before it is joined, and not made twice
    asked = trials.join(small(run.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = run.join(trial_terms(asked), "doc_id", "left").join(person_terms(people), "topic_id", "left")
    found = F.col("every").isNotNull() & F.col("positive").isNotNull()
    return rows.select(*[F.col(x) for x in run.columns], F.when(found, F.struct(*entity_components())).alias("entity"))


def entity_rerank(evidence: DataFrame, weight: float, protect: int, audit: bool = False) -> DataFrame:
    """topic_id, doc_id, score, old_rank, position: scores blended with the entity score and put back on their own scale.

    The first ``protect`` candidates never lose score; ``audit`` keeps scores and order.  ``rank`` is not renumbered.
    """
    w = W.partitionBy("topic_id")
    value = F.coalesce(F.col("score"), F.lit(0.0))
    rows = evidence.withColumn("norm", min_max(["topic_id"], "score")).withColumn("low", F.min(value).over(w))
    rows = rows.withColumn("spread", F.greatest(F.max(value).over(w) - F.col("low"), F.lit(1.0)))
    share = min(max(float(weight), 0.0), 1.0)
    new = F.col("low") + ((1 - share) * F.col("norm") + share * F.col("entity.entity_score")) * F.col("spread")
    new = F.when(F.col("rank") <= protect, F.greatest(new, value)).otherwise(new)
    new = F.when(F.col("entity").isNull() | F.lit(audit), F.col("score")).otherwise(F.round(new, 6))
    rows = rows.select("topic_id", "doc_id", new.alias("score"), F.col("rank").alias("old_rank"))
    order = [F.asc("old_rank")] if audit else [F.desc_nulls_last("score"), F.asc("old_rank"), F.asc("doc_id")]
    return rows.withColumn("position", F.row_number().over(W.partitionBy("topic_id").orderBy(*order)))


def demote_outside(scored: DataFrame) -> DataFrame:
    """``scored`` (topic_id, score, outside): what only diversity selected stays .001 below the rest of its topic.

    A topic without other candidates keeps its scores.
    """
    lowest = F.min(F.when(~F.col("outside"), F.col("score"))).over(W.partitionBy("topic_id"))
    return scored.withColumn("score", F.when(F.col("outside"), F.least(F.col("score"), lowest - 0.001)).otherwise(F.col("score")))


def fuse_node(runs: DataFrame, weights: dict[str, float], fused_k: int, rerank_k: int, fielded: bool) -> DataFrame:
    """Runs fused by reciprocal ranks; a topic with one fielded run keeps that run's scores and ranks.

    ``runs``: source, topic_id, doc_id, score, rank.
    """
    if not fielded:
        return fuse(runs, fused_k, weights).select("topic_id", "doc_id", "score", "rank")
    lone = runs.groupBy("topic_id").agg(F.min("source").alias("x"), F.max("source").alias("y")).where("x = y").select("topic_id")
    kept = runs.join(lone, "topic_id", "left_semi").where(F.col("rank") <= max(fused_k, rerank_k))
    fused = fuse(runs.join(lone, "topic_id", "left_anti"), fused_k, weights)
    return kept.select("topic_id", "doc_id", "score", "rank").unionAll(fused.select("topic_id", "doc_id", "score", "rank"))


def listwise_windows(run: DataFrame, score: Column, k: int = 100, window: int = 20, step: int = 10) -> DataFrame:
    """topic_id, doc_id, old_rank, rank: the first ``k`` of each topic after sliding windows from the back.

    The last ``window`` candidates are put in order of ``score`` (what a listwise model would say of them), then the
    window moves up by ``step`` and meets what it has carried there, until it reaches the head.  Candidates of one
    window with equal or no score keep their order, those without one last; those beyond ``k`` are left out.  A topic
    is an array of at most ``k`` in one row, and the windows are a fold over it.
    """
    if not 0 < step <= window:
        raise ValueError("a window moves by one at least and by its size at most")
    rows = run.select("topic_id", "doc_id", "rank", score.cast("double").alias("said"))
    place = F.row_number().over(W.partitionBy("topic_id").orderBy("rank", "doc_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= k)
    pools = rows.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "rank", "said"))).alias("pool"))
    n = F.size("pool")

    def ordered(part: Column) -> Column:
        keyed = F.transform(part, lambda c, i: F.struct(c["said"].isNull().alias("none"), (-c["said"]).alias("down"), i.alias("i"), c.alias("c")))
        return F.transform(F.array_sort(keyed), lambda x: x["c"])

    def moved(pool: Column, end: Column) -> Column:
        start = F.greatest(end - window, F.lit(0))
        return F.concat(F.slice(pool, F.lit(1), start), ordered(F.slice(pool, start + 1, end - start)), F.slice(pool, end + 1, n - end))

    last = F.greatest(F.ceil((n - window) / step), F.lit(0)).cast("int")
    ends = F.transform(F.sequence(F.lit(0), last), lambda j: n - j * step)
    out = pools.select("topic_id", F.posexplode(F.aggregate(ends, F.col("pool"), moved)).alias("at", "c"))
    return out.select("topic_id", F.col("c.doc_id").alias("doc_id"), F.col("c.rank").alias("old_rank"), (F.col("at") + 1).alias("rank"))


def listwise(run: DataFrame, k: int = 30) -> DataFrame:
    """Without a model the listwise step keeps the first ``k`` of each topic as they are."""
    return run.where(F.col("rank") <= k)


def judged(ranked: DataFrame, order: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The first ``k`` of ``ranked`` (topic_id, doc_id, rank, filled) in the judge's order, numbered from 1.

    ``order``: topic_id, doc_id, place.  Its first mention of an id counts, unknown ids are ignored, ids it leaves
    out follow in their prior order, fills come last.  Without an order the prior one stays.
    """
    said = ranked.withColumn("place", F.lit(None).cast("long"))
    if order is not None:
        places = order.groupBy("topic_id", "doc_id").agg(F.min("place").alias("place"))
        said = ranked.join(places, ["topic_id", "doc_id"], "left")
    keys = [F.asc("filled"), F.expr("if(filled, null, place)").asc_nulls_last(), F.asc("rank")]
    return top(said.withColumnRenamed("rank", "old_rank").withColumn("rank", F.col("old_rank")), ["topic_id"], keys, k, "judged").select(
        "topic_id", "doc_id", "old_rank", F.col("judged").alias("rank")
    )


def render_candidates(lines: DataFrame) -> DataFrame:
    """One block per topic from (topic_id, place, line)."""
    rows = lines.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("x"))
    return rows.select("topic_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("block"))
