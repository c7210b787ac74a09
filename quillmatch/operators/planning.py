"""Search plans and the decisions between stages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLINICAL = ("RECRUITING", "NOT_YET_RECRUITING")


def mode_of(asked: Column, default: Column) -> Column:
    """The asked mode, else the configured one, else clinical_active."""
    return F.coalesce(asked, default, F.lit("clinical_active"))


def fallback_plan(diagnosis: Column, note: Column, mode: Column, relax: Column) -> Column:
    """struct(query, mandatory_filters, relax_optional_filters, source) without a model."""
    listed = lambda names: F.array(*map(F.lit, names))
    statuses = F.when(relax, listed((*CLINICAL, "ENROLLING_BY_INVITATION"))).otherwise(listed(CLINICAL))
    none = F.create_map().cast("map<string,array<string>>")
    return F.struct(
        F.when(F.coalesce(diagnosis, F.lit("")) != "", diagnosis).otherwise(F.substring(F.coalesce(note, F.lit("")), 1, 120)).alias("query"),
        F.when(mode == "clinical_active", F.create_map(F.lit("status"), statuses)).otherwise(none).alias("mandatory_filters"),
        relax.alias("relax_optional_filters"),
        F.lit("fallback").alias("source"),
    )


def finished_filters(filters: Column, mode: Column) -> Column:
    """A plan's mandatory filters; benchmark runs never filter by status."""
    return F.when(mode == "benchmark", F.map_filter(filters, lambda k, _: k != "status")).otherwise(filters)


def allowed_statuses(filters: Column) -> Column:
    """The planned statuses, or null where none are planned."""
    return F.try_element_at(filters, F.lit("status"))


def retrieve_again(attempts: Column, cap: Column, n_final: Column, relaxed: Column, viable: Column, least: int = 10) -> Column:
    return (attempts < cap) & (n_final > 0) & ~relaxed & (viable < least)


def critique(enabled: Column, n_judged: Column, rounds: Column, cap: Column) -> Column:
    return enabled & (n_judged > 0) & (rounds < cap)


def no_rank_reason(errors: Column, bm25: Column, dense: Column, final: Column, viable: Column, evals: Column, ranked: Column, judged: Column) -> Column:
    """Why a topic has no judged trial, from the sizes of its stages; null if it has."""
    return (
        F.when(judged > 0, F.lit(None).cast("string"))
        .when(errors > 0, "state_errors")
        .when((bm25 == 0) & (dense == 0), "retrieval_empty")
        .when(final == 0, "no_final_candidates")
        .when(viable == 0, "all_candidates_hard_excluded")
        .when(evals == 0, "no_trial_evals")
        .when(ranked == 0, "no_ranked_trials")
        .otherwise("judge_or_dossier_empty")
    )
