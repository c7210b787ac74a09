"""The matching pipeline as one declarative plan over all topics.

retrieve (BM25, fielded) -> fuse -> rerank by entities -> hard filter -> select
-> label (with irrelevance) -> score -> adjust by evidence -> demote what only
diversity selected -> rank -> fill -> judge's order -> critique.  Every step is a DataFrame operator; labels
come from criterion evaluations where there are any.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.text import entity_terms, negated_terms, overlap_cosine
from quillmatch.operators import eligibility as E
from quillmatch.operators import ranking as G
from quillmatch.operators import report as P
from quillmatch.operators import retrieval as R
from quillmatch.operators import selection as S
from quillmatch.operators.steplog import StepLog


@dataclass(frozen=True)
class Config:
    """One run's settings; `benchmark` and `clinical` are the two presets."""

    mode: str = "benchmark"
    fielded: bool = True
    field_k: int = 1000
    fused_k: int = 1000
    entity_weight: float = 0.09
    protect_top: int = 3
    filter_status: bool = False
    evaluated: int = 10
    diverse: bool = False
    diverse_keep: int = 9
    irrelevance: bool = True
    evidence_weight: float = 0.50
    soft_veto: bool = False
    fill_excluded: bool = True
    fill_tail: bool = False
    output_k: int = 20
    as_of: str = "2001-08-01"


def benchmark(**changes) -> Config:
    return replace(Config(), **changes)


def clinical(**changes) -> Config:
    own = {"entity_weight": 0.0, "evidence_weight": 0.0, "irrelevance": False, "fill_excluded": False, "filter_status": True}
    return replace(Config(mode="clinical", fielded=False, output_k=10, **own), **changes)


def retrieve(docs: DataFrame, topics: DataFrame, config: Config) -> DataFrame:
    """topic_id, doc_id, score, rank."""
    if config.fielded:
        return R.fielded(docs, topics, config.fused_k, config.field_k).select("topic_id", "doc_id", "score", "rank")
    return R.bm25(docs, topics, config.fused_k).select("topic_id", "doc_id", "score", "rank")


def term_rerank(run: DataFrame, docs: DataFrame, topics: DataFrame, config: Config) -> DataFrame:
    """Without profiles: scores blended with term overlap less a penalty for negated terms; the first ranks never fall."""
    if not config.entity_weight:
        return run
    text = F.col("text")
    cands = docs.join(R.small(run.select("doc_id").distinct()), "doc_id").select(
        "doc_id", entity_terms(text, True).alias("d"), negated_terms(text).alias("dn")
    )
    asked = topics.select("topic_id", entity_terms(text, True).alias("q"), negated_terms(text).alias("qn"))
    rows = run.join(cands, "doc_id").join(R.small(asked), "topic_id")
    clash = F.size(F.array_intersect("qn", "d")) + F.size(F.array_intersect("dn", F.array_except("q", "qn")))
    entity = overlap_cosine(F.col("q"), F.col("d")) - 0.24 * F.least(F.lit(1.0), 0.25 * clash)
    entity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), entity))
    rows = rows.withColumn("norm", R.min_max(["topic_id"], "score"))
    w = config.entity_weight
    blended = (1 - w) * F.col("norm") + w * entity
    blended = F.when(F.col("rank") <= config.protect_top, F.greatest(blended, F.col("norm"))).otherwise(blended)
    rows = rows.select("topic_id", "doc_id", F.round(blended, 6).alias("score"), F.col("rank").alias("old_rank"))
    order = [F.desc_nulls_last("score"), F.asc("old_rank"), F.asc("doc_id")]
    return R.top(rows, ["topic_id"], order, config.fused_k).select("topic_id", "doc_id", "score", "rank")


def screen(run: DataFrame, people: DataFrame | None, studies: DataFrame | None, config: Config) -> DataFrame:
    """``run`` with hard_excluded and in_corpus; without profiles nothing is excluded."""
    if people is None or studies is None:
        return run.withColumn("hard_excluded", F.lit(False)).withColumn("in_corpus", F.lit(True))
    named = run.withColumnRenamed("doc_id", "trial")
    limits = studies.withColumnRenamed("doc_id", "trial").select("trial", "status", "sex", "min_days", "max_days", "raw_min", "raw_max")
    rows = S.hard_filter(named, limits, people.select("topic_id", "age_years", "sex"), filter_status=config.filter_status)
    known = F.coalesce(F.col("excluded_reason") != "trial not found in corpus", F.lit(True))
    return rows.withColumn("in_corpus", known).drop("excluded_reason").withColumnRenamed("trial", "doc_id")


def select(viable: DataFrame, docs: DataFrame, topics: DataFrame, config: Config) -> DataFrame:
    """The ``evaluated`` candidates of each topic; ``outside`` tells those that their score alone wouldn't select."""
    best = S.top_score(viable.withColumnRenamed("rank", "place"), config.evaluated)
    if not config.diverse:
        return best.select("topic_id", "doc_id", F.lit(False).alias("outside"))
    pool = S.top_score(viable, max(20, config.evaluated))
    chosen = S.diverse(pool, docs, topics, min(config.diverse_keep, config.evaluated - 1), config.evaluated).select("topic_id", "doc_id")
    inside = best.select("topic_id", "doc_id", F.lit(True).alias("inside"))
    return chosen.join(inside, ["topic_id", "doc_id"], "left").select("topic_id", "doc_id", F.col("inside").isNull().alias("outside"))


def match(
    docs: DataFrame,
    topics: DataFrame,
    evals: DataFrame,
    trials: DataFrame,
    config: Config,
    people: DataFrame | None = None,
    studies: DataFrame | None = None,
    order: DataFrame | None = None,
    flagged: DataFrame | None = None,
    log: StepLog | None = None,
) -> DataFrame:
    """topic_id, doc_id, label, score, source, rank: the first ``output_k`` of each topic.

    ``evals``: topic_id, trial, criterion, polarity, label, confidence, mandatory, type, each patient's own; ``trials``:
    trial, status, phase, updated.  ``trial`` is a document's id.  ``people``: topic_id, age_years, sex, home, note and the arrays
    diagnoses, biomarkers, treatments, comorbidities; ``studies``: doc_id, status, sex, min_days, max_days, raw_min,
    raw_max, locations (array of country, state, city) and the texts of `ranking.trial_terms`.  Without these two
    the steps that need them (hard filter, entity components, geography, signals of terms) don't act.

    Documents with no criteria evaluated count as evaluated with none.  ``source``: ranked, tail, excluded.

    ``order`` (topic_id, doc_id, place): a judge's order of the final list; fills stay behind it.  ``flagged`` (topic_id,
    doc_id): what a critique moves two places down after that.  ``log`` takes rows and seconds of each step.
    """
    log = log or StepLog()
    profiled = people is not None and studies is not None
    run = retrieve(docs, topics, config)
    if profiled and config.entity_weight:
        seen = G.entity_evidence(run, people, studies)
        run = G.entity_rerank(seen, config.entity_weight, config.protect_top)
        run = run.select("topic_id", "doc_id", "score", F.col("position").alias("rank"))
    elif config.entity_weight:
        run = term_rerank(run, docs, topics, config)
    # several steps read the screened run; it holds at most fused_k rows a topic
    run = log.step("screened", screen(run, people, studies, config))
    viable = run.where("not hard_excluded").select("topic_id", "doc_id", "score", "rank")
    chosen = log.step("selected", lambda: select(viable, docs, topics, config))
    rows = S.prior(viable).join(chosen, ["topic_id", "doc_id"]).select("topic_id", "doc_id", "prior", "outside")

    pairs = rows.select("topic_id", F.col("doc_id").alias("trial"))
    mine = evals.join(pairs, E.KEY, "left_semi")
    counts = pairs.join(E.trial_counts(mine), E.KEY, "left")
    none = [c for c in counts.columns if c not in (*E.KEY, "mandatory_failed", "avg_confidence")]
    counts = counts.fillna(0, none).fillna(False, ["mandatory_failed"]).withColumn("label", E.trial_label(config.mode))
    counts = log.step("labelled", counts)
    facts = counts.join(E.evidence(mine, counts).select(*E.KEY, "evidence"), E.KEY).join(trials, "trial", "left")
    rows = rows.join(facts.withColumnRenamed("trial", "doc_id"), ["topic_id", "doc_id"])
    if profiled:
        asked = people.select(
            "topic_id", F.array_join("diagnoses", " ").alias("conditions"), F.array_join(F.concat("biomarkers", "treatments"), " ").alias("treatments")
        )
        told = studies.select(
            "doc_id",
            F.concat_ws(" ", "title", "official_title", F.array_join("conditions", " "), F.array_join("keywords", " ")).alias("titles"),
            F.concat_ws(" ", "title", "brief_summary", "detailed_description", F.array_join("interventions", " "), "raw_text").alias("treatments"),
        )
        rows = rows.join(S.irrelevance_signals(rows, asked, told), ["topic_id", "doc_id"], "left")
        rows = rows.join(people.select("topic_id", "home"), "topic_id", "left").join(studies.select("doc_id", "locations"), "doc_id", "left")
        rows = rows.withColumn("geography", P.geography(F.col("locations"), F.col("home")))
    else:
        rows = rows.withColumns({"no_condition": F.lit(False), "no_intervention": F.lit(False), "geography": F.lit(0.0)})
    if config.irrelevance and config.mode == "benchmark":
        rows = rows.withColumn("label", F.when(P.irrelevance() == "irrelevant", "irrelevant").otherwise(F.col("label")))
    rows = rows.withColumns(
        {
            "elig": E.eligibility_score(),
            "status_bonus": E.table_value(F.col("status"), X.STATUS_BONUS[config.mode], 0.0),
            "phase_score": E.table_value(F.col("phase"), X.PHASE_PRIORITY, 0.5),
            "recency": E.recency(F.col("updated"), F.lit(config.as_of).cast("date")),
        }
    )
    base = E.trial_score(config.mode, config.soft_veto)
    veto = (F.col("exc_met") > 0) | F.col("mandatory_failed")
    weight = F.when(veto & (base <= -0.95), 0.25 * config.evidence_weight).otherwise(config.evidence_weight)
    scored = rows.select("topic_id", "doc_id", "label", "outside", (base + weight * (F.col("evidence") - 0.5)).alias("score"))
    scored = log.step("scored", G.demote_outside(scored))  # a few rows a topic, read by every step of the fill

    known = run.join(chosen.withColumn("evaluated", F.lit(True)).drop("outside"), ["topic_id", "doc_id"], "left")
    known = known.withColumn("evaluated", F.col("evaluated").isNotNull())
    ranked = scored.select("topic_id", "doc_id", "score")
    if config.fill_excluded or config.fill_tail:
        full = P.fill(ranked, known if config.fill_excluded else known.where("not hard_excluded"), config.output_k, config.fill_tail)
    else:
        full = ranked.withColumn("source", F.lit("ranked"))
    full = full.join(scored.select("topic_id", "doc_id", "label"), ["topic_id", "doc_id"], "left").withColumn(
        "label", F.coalesce("label", F.lit("excludes"))
    )
    full = full.select("topic_id", "doc_id", "label", F.round("score", 4).alias("score"), "source", F.col("score").alias("exact"))
    ranked = R.top(full, ["topic_id"], [F.desc("exact"), F.asc("doc_id")], config.output_k).drop("exact")
    if order is None and flagged is None:
        return ranked
    ranked = log.step("ranked", ranked)
    places = ranked.select("topic_id", "doc_id", "rank")
    if order is not None:
        filled = ranked.select("topic_id", "doc_id", "rank", (F.col("source") != "ranked").alias("filled"))
        places = G.judged(filled, order, config.output_k).select("topic_id", "doc_id", "rank")
    if flagged is not None:
        places = P.demote(places, flagged)
    return ranked.drop("rank").join(places, ["topic_id", "doc_id"])


def match_text(spark: SparkSession, docs: DataFrame, text: str, top_k: int = 10) -> DataFrame:
    """The best documents for one text: what a request handler would call."""
    topics = spark.createDataFrame([(0, text)], "topic_id long, text string")
    return retrieve(docs, topics, clinical(fused_k=top_k)).select("doc_id", "score", "rank")
