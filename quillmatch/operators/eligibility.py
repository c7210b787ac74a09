"""Criterion evaluations, trial labels, scores and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.text import clamp


def table_value(key: Column, values: dict, default) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


#: An evaluation belongs to a patient and a trial: one patient's exclusion says nothing of another's.
KEY = ["topic_id", "trial"]


def last_wins(evals: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """One evaluation per topic, trial and criterion (or ``key``), the last in ``order``; combines map-side."""
    key = key or [*KEY, "criterion"]
    values = [c for c in evals.columns if c not in (*key, *order)]
    picked = evals.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return picked.select(*key, *[F.col("v")[c].alias(c) for c in values])


def trial_counts(evals: DataFrame) -> DataFrame:
    """Counts by polarity and label, vetoes, unknown share and mean confidence of each topic and trial."""
    inc, met, no = F.col("polarity") == "inclusion", F.col("label") == "met", F.col("label") == "not_met"
    nei = ~met & ~no
    return (
        evals.groupBy(*KEY)
        .agg(
            F.count_if(inc).alias("n_inc"),
            F.count_if(~inc).alias("n_exc"),
            F.count_if(inc & met).alias("inc_met"),
            F.count_if(inc & no).alias("inc_not"),
            F.count_if(inc & nei).alias("inc_nei"),
            F.count_if(~inc & met).alias("exc_met"),
            F.count_if(~inc & no).alias("exc_not"),
            F.count_if(~inc & nei).alias("exc_nei"),
            F.max(inc & no & F.col("mandatory")).alias("mandatory_failed"),
            F.avg("confidence").alias("avg_confidence"),
        )
        .withColumn(
            "fraction_nei",
            F.coalesce(F.try_divide(F.col("inc_nei") + F.col("exc_nei"), F.col("n_inc") + F.col("n_exc")), F.lit(0.0)),
        )
    )


def trial_label(mode: str, irrelevance: bool = False, min_nei: float = 0.8, max_met: int = 0) -> Column:
    """eligible, excludes or irrelevant from `trial_counts`, first rule that holds."""
    share, most = X.LABEL_POLICY[mode]
    c = F.col
    veto = (c("exc_met") > 0) | c("mandatory_failed")
    enough = c("inc_met") >= F.greatest(F.lit(1), (share * c("n_inc")).cast("int"))
    out = F
    if irrelevance:
        out = out.when((c("n_inc") > 0) & (c("inc_met") <= max_met) & (c("fraction_nei") >= min_nei) & (c("exc_met") == 0), "irrelevant")
    return (
        out.when(veto, "excludes")
        .when((c("n_inc") > 0) & (c("inc_met") == c("n_inc")) & (c("exc_met") == 0), "eligible")
        .when(enough & (c("exc_met") == 0) & (c("fraction_nei") < most), "eligible")
        .otherwise("excludes")
    )


def grade(label: Column) -> Column:
    return F.when(label == "eligible", 2).when(label == "excludes", 1).otherwise(0)


def eligibility_score() -> Column:
    """Share of inclusions met plus exclusions clear less inclusions failed, halved, damped by unknowns."""
    c = F.col
    match = F.coalesce(F.try_divide(c("inc_met"), c("n_inc")), F.lit(0.0))
    failed = F.coalesce(F.try_divide(c("inc_not"), c("n_inc")), F.lit(0.0))
    clear = F.coalesce(F.try_divide(c("exc_not"), c("n_exc")), F.lit(1.0))
    score = clamp((match + clear - failed) / 2 * (1 - 0.5 * c("fraction_nei")))
    return F.when(c("n_inc") + c("n_exc") == 0, 0.0).otherwise(score)


def recency(updated: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, updated)
    return F.when(updated.isNull(), 0.0).when(days <= 0, 1.0).otherwise(1 / (1 + F.log1p(days / 365.0)))


def trial_score(mode: str, soft_veto: bool, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the components, blended with confidence; vetoes sink to -1."""
    w, c = weights or X.SCORE_WEIGHTS, F.col
    base = (
        w["eligibility"] * c("elig")
        + w["recruiting"] * c("status_bonus")
        + w["phase"] * c("phase_score")
        + w["recency"] * c("recency")
        + w["geography"] * c("geography")
        + w["retrieval"] * c("prior")
        - w["nei"] * c("fraction_nei")
    ) * (w["blend"] * F.coalesce("avg_confidence", F.lit(0.7)) + (1 - w["blend"]))
    veto = (c("exc_met") > 0) | c("mandatory_failed")
    sunk = base - w["soft_veto"] if soft_veto and mode == "benchmark" else -1 + w["veto_tie"] * c("prior")
    return F.when(veto, sunk).otherwise(base)


def evidence(evals: DataFrame, trials: DataFrame) -> DataFrame:
    """Weighted criterion evidence of each topic and trial; ``trials`` has `trial_counts` and label."""
    c = F.col
    rows = evals.where("type <> 'section_header'").select(
        "*",
        (table_value(c("type"), X.EVIDENCE_WEIGHTS, 0.80) * F.when(c("mandatory"), 1.0).otherwise(0.65)).alias("w"),
        clamp(c("confidence")).alias("sure"),
    )
    inc, met, no = c("polarity") == "inclusion", c("label") == "met", c("label") == "not_met"
    nei, sub, must = ~met & ~no, ~c("type").isin(list(X.NOT_SUBSTANTIVE)), c("mandatory")
    total = lambda cond, share=F.lit(1.0): F.sum(F.when(cond, c("w") * share).otherwise(0.0))
    sums = rows.groupBy(*KEY).agg(
        total(inc).alias("inc_total"),
        total(~inc).alias("exc_total"),
        total(inc & sub).alias("sub_total"),
        total(inc & met, c("sure")).alias("inc_met_w"),
        total(inc & sub & met, c("sure")).alias("sub_met_w"),
        total(inc & no, c("sure")).alias("inc_failed_w"),
        total(inc & nei & must, F.lit(0.75)).alias("required_w"),
        total(inc & nei, F.when(must, 0.75).otherwise(0.45)).alias("missing_w"),
        total(~inc & no, c("sure")).alias("exc_clear_w"),
        total(~inc & met, c("sure")).alias("exc_hit_w"),
        total(~inc & nei, F.when(must, 0.25).otherwise(0.15)).alias("exc_unknown_w"),
    )
    over = lambda a, b, empty=0.0: F.when(c(b) > 0, clamp(c(a) / c(b))).otherwise(empty)
    parts = sums.select(
        *KEY,
        over("inc_met_w", "inc_total").alias("inclusion_support"),
        over("sub_met_w", "sub_total").alias("substantive_support"),
        over("inc_failed_w", "inc_total").alias("inclusion_failure"),
        over("missing_w", "inc_total").alias("inclusion_missing"),
        over("exc_clear_w", "exc_total", 1.0).alias("exclusion_clear"),
        over("exc_hit_w", "exc_total").alias("exclusion_penalty"),
        over("exc_unknown_w", "exc_total").alias("exclusion_unknown"),
        clamp(c("required_w") / F.greatest(c("inc_total") + 0.45 * c("exc_total"), F.lit(1e-9))).alias("missing_required"),
    )
    few = (
        F.when((c("n_inc") == 0) | (c("inc_met") == 0), 0.12)
        .when((c("inc_met") <= 1) & (c("substantive_support") < 0.35), 0.10)
        .when(c("inc_met") <= 1, 0.04)
        .otherwise(0.0)
    )
    thin = F.when(c("label") == "eligible", few + F.when(c("fraction_nei") >= 0.65, 0.04).otherwise(0.0)).otherwise(0.0)
    known = trials.select(*KEY, "label", "n_inc", "inc_met", "fraction_nei")
    # a trial without criteria, or with headings only, has nothing for or against it
    parts = known.join(parts, KEY, "left").fillna(1.0, ["exclusion_clear"])
    parts = parts.fillna(0.0, [x for x in parts.columns if x not in (*KEY, "label", "exclusion_clear")]).withColumn("thin", thin)
    score = clamp(
        0.38 * c("inclusion_support")
        + 0.30 * c("substantive_support")
        + 0.12 * c("exclusion_clear")
        + 0.10 * (1 - c("fraction_nei"))
        - 0.45 * c("inclusion_failure")
        - 0.72 * c("exclusion_penalty")
        - 0.06 * c("exclusion_unknown")
        - 0.42 * c("missing_required")
        - c("thin")
    )
    return parts.withColumn("evidence", score).drop("n_inc", "inc_met", "label")


def compare(value: Column, op: Column, bound: Column) -> Column:
    """met, not_met or NEI of a numeric predicate; unknown operators fail, missing numbers are NEI."""
    truth = (
        F.when(op == ">=", value >= bound)
        .when(op == "<=", value <= bound)
        .when(op == ">", value > bound)
        .when(op == "<", value < bound)
        .when(op == "=", value == bound)
        .when(op == "!=", value != bound)
        .otherwise(False)
    )
    return F.when(value.isNull() | bound.isNull(), "NEI").when(truth, "met").otherwise("not_met")


def vote(votes: DataFrame) -> DataFrame:
    """Majority label of each criterion if more than half agree, else NEI at 0.4."""
    counted = votes.groupBy(*KEY, "criterion", "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"))
    best = counted.groupBy(*KEY, "criterion").agg(
        F.sum("n").alias("k"), F.max(F.struct("n", "label", "conf")).alias("top")
    )
    won = F.col("top.n") > F.floor(F.col("k") / 2)
    return best.select(
        *KEY,
        "criterion",
        F.when(won, F.col("top.label")).otherwise("NEI").alias("label"),
        F.round(F.when(won, F.col("top.conf")).otherwise(0.4), 6).alias("confidence"),
    )


def verified(label: Column, confidence: Column, strength: Column, revised: Column, threshold: float = 0.85) -> Column:
    """struct(label, confidence, flipped): a moderate or strong rebuttal with another label makes an unsure one NEI."""
    flip = (confidence < threshold) & strength.isin("moderate", "strong") & (revised != label)
    return F.struct(
        F.when(flip, "NEI").otherwise(label).alias("label"),
        F.when(flip, F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"),
        flip.alias("flipped"),
    )


def route(kind: Column, deterministic: Column) -> Column:
    """Which evaluator decides a criterion: header, deterministic, model or votes."""
    return (
        F.when(kind == "section_header", "header")
        .when(deterministic.isNotNull() & (deterministic != "NEI"), "deterministic")
        .when(deterministic.isNotNull() & kind.isin("age", "sex"), "deterministic")
        .when(kind.isin(*X.LLM_TYPES, "performance_status"), "model")
        .otherwise("votes")
    )


def adjust(score: Column, evidence_score: Column, veto: Column, weight: float) -> Column:
    """Score moved by evidence around one half; a quarter of it for trials sunk by a veto."""
    used = F.when(veto & (score <= -0.95), 0.25 * weight).otherwise(F.lit(weight))
    return score + used * (evidence_score - 0.5)


def deterministic(kind: Column, op: Column, feature: Column, value: Column) -> Column:
    """met, not_met or NEI where a typed predicate decides without a model, else null.

    Reads age_years, sex, ecog, karnofsky and labs (array of name, value) of the person.  A bound that is no number,
    a type without rule and a missing predicate (null ``op``) decide nothing; the label is not turned by polarity.
    """
    c, bound = F.col, value.try_cast("double")
    name, said = F.lower(feature), F.lower(F.coalesce(value, F.lit("")))

    def numeric(x: Column) -> Column:
        return F.when(bound.isNotNull(), compare(x.cast("double"), op, bound))

    age = F.when(c("age_years").isNull(), "NEI").otherwise(numeric(c("age_years")))
    sex = F.when(c("sex") == "unknown", "NEI").when(c("sex") == said, "met").otherwise("not_met")
    status = (
        F.when(name.isin("ecog", "performance_status") & c("ecog").isNotNull(), numeric(c("ecog")))
        .when((name == "karnofsky") & c("karnofsky").isNotNull(), numeric(c("karnofsky")))
        .otherwise("NEI")
    )
    lab = F.get(F.filter("labs", lambda x: F.lower(F.trim(x["name"])) == F.trim(name)), F.lit(0))["value"]
    lab = F.when(lab.isNull(), "NEI").otherwise(numeric(lab))
    rules = F.when(kind == "age", age).when(kind == "sex", sex).when(kind == "performance_status", status).when(kind == "lab", lab)
    return F.when(op.isNotNull(), rules)


def attach_criteria(evals: DataFrame, criteria: DataFrame) -> DataFrame:
    """Evaluations with their criteria (trial, criterion and whatever else they have); unmatched ones are left out.

    Criteria that have a topic_id are those extracted for this topic only.
    """
    return evals.join(criteria, [c for c in (*KEY, "criterion") if c in criteria.columns])
