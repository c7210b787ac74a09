"""Questions, dossiers, flags, error categories, geography and output filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.operators.retrieval import top


def rubric() -> Column:
    """struct of five dimensions of 0 to 2 and their share of 10, from question columns."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    text, why = c("question_text"), c("rationale")
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    parts = {
        "specific": F.when(F.length(c("data_point")) > 3, 2.0).when(c("data_point") != "", 1.0).otherwise(0.0),
        "temporal": F.when(c("time_window") != "", 2.0).when(F.contains(F.lower(text), F.lit("within")), 1.0).otherwise(0.0),
        "format": F.when((c("expected_data_type") != "") & (c("expected_data_type") != "text"), 2.0).otherwise(1.0),
        "rationale_score": F.when(F.contains(F.lower(why), F.lit("trial")) & (F.length(why) > 30), 2.0).when(why != "", 1.0).otherwise(0.0),
        "actionable": F.when(words.between(5, 60) & F.contains(text, F.lit("?")), 2.0).when(text != "", 1.0).otherwise(0.0),
    }
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in parts.items()], (total / 10).alias("normalized"))


def completeness(required: list[Column], optional: list[Column], url: Column) -> Column:
    """.7 of the required and .2 of the optional fields that are present, .1 for a url."""
    count = lambda xs: sum((F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0) for x in xs), F.lit(0.0))
    return 0.7 * count(required) / len(required) + 0.2 * count(optional) / len(optional) + F.when(url, 0.1).otherwise(0.0)


def error_categories() -> Column:
    """Names of all errors of a row with gold, predicted, judged, counts, score, veto and prior."""
    c = F.col
    lost = (c("gold") == 2) & (c("predicted") < 2)
    noise = (c("gold") == 0) & (c("predicted") > 0)
    share = F.coalesce(F.try_divide("inc_met", "n_inc"), F.lit(0.0))
    rules = (
        (noise, "retrieval_false_positive"),
        (noise & c("judged"), "retrieval_false_positive_judged"),
        (noise & ~c("judged"), "retrieval_false_positive_unjudged"),
        (lost, "missed_gold_eligible"),
        ((c("gold") < 2) & (c("predicted") == 2), "overcalled_eligible"),
        ((c("gold") == 1) & (c("predicted") != 1), "missed_excludes"),
        (lost & (c("veto") | (c("score") <= -0.99)), "hard_veto_gold_eligible"),
        (lost & (c("exc_met") > 0), "exclusion_met_gold_eligible"),
        (lost & (c("n_inc") > 0) & (share < 0.6), "low_inclusion_support_gold_eligible"),
        (lost & (c("fraction_nei") >= 0.6), "high_nei_gold_eligible"),
        (c("prior") < 0.25, "low_retrieval_prior"),
    )
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return F.when(F.size(found) == 0, F.array(F.lit("generic_disagreement"))).otherwise(found)


def attention_flags() -> Column:
    """severity:category of what a reader of a trial's dossier should look at."""
    c = F.col
    rules = (
        (c("fraction_nei") >= 0.4, "warning:data_quality"),
        (c("mandatory_failed"), "critical:eligibility_mandatory"),
        (c("exc_met") > 0, "critical:eligibility_exclusion"),
        (~c("in_country"), "warning:geographic"),
        (~c("status").isin("RECRUITING", "NOT_YET_RECRUITING"), "warning:trial_status"),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def geography(locations: Column, home: Column) -> Column:
    """Score of the first location that hits: same country (by alias) 1, state or city that holds ``home`` .7 or stands in it .5."""
    where, country = F.lower(F.trim(home)), T.country(home)

    def one(place: Column) -> Column:
        out = F.when(country == T.country(place["country"]), 1.0)
        for part in ("state", "city"):
            name = F.lower(place[part])
            out = out.when((name != "") & F.contains(name, where), 0.7).when((name != "") & F.contains(where, name), 0.5)
        return out.otherwise(0.0)

    hits = F.filter(F.transform(locations, one), lambda s: s > 0)
    return F.when(F.coalesce(where, F.lit("")) == "", 0.0).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(0.0)))


def fill(ranked: DataFrame, candidates: DataFrame, k: int, tail: bool = False) -> DataFrame:
    """``ranked`` (topic_id, doc_id, score) filled up to ``k`` per topic, below all that is there.

    ``candidates``: topic_id, doc_id, score, hard_excluded, evaluated, in_corpus.  Only those that are neither
    ranked nor evaluated and stand in the corpus fill: with ``tail`` first the viable ones, then the excluded.
    """
    free = candidates.where("not evaluated and in_corpus").join(ranked.select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_anti")
    order = [F.desc_nulls_last("score"), F.asc("doc_id")]
    parts = ranked.select("topic_id", "doc_id", "score", F.lit("ranked").alias("source"))
    for source, wanted, floor, gap in (("tail", "not hard_excluded", -1.5, 0.5), ("excluded", "hard_excluded", -2.0, 1.0)):
        if source == "tail" and not tail:
            continue
        have = parts.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        extra = top(free.where(wanted).select("topic_id", "doc_id", "score"), ["topic_id"], order, k, "i").join(have, "topic_id", "left")
        slots = k - F.coalesce("n", F.lit(0))
        base = F.least(F.lit(floor), F.coalesce("low", F.lit(-1.0)) - gap)
        prior = F.greatest(F.lit(0.0), 1 - (F.col("i") - 1) / F.greatest(slots, F.lit(1)))
        parts = parts.unionAll(
            extra.where(F.col("i") <= slots).select("topic_id", "doc_id", (base + 0.001 * prior).alias("score"), F.lit(source).alias("source"))
        )
    return parts


def irrelevance(policy_min_nei: float = 0.8, max_met: int = 0, max_prior: float = 0.5, least: int = 3) -> Column:
    """Why a trial keeps its label, or ``irrelevant`` when enough signals agree."""
    c = F.col
    signals = [c("fraction_nei") >= policy_min_nei, c("inc_met") <= max_met, c("prior") <= max_prior, c("no_condition"), c("no_intervention")]
    count = sum((s.cast("int") for s in signals), F.lit(0))
    return (
        F.when(c("label") == "eligible", "eligible_label")
        .when(c("exc_met") > 0, "explicit_exclusion_met")
        .when(c("mandatory_failed"), "mandatory_inclusion_failed")
        .when(~(signals[0] & signals[1] & signals[2]), "missing_core_irrelevance_signals")
        .when(count < least, "insufficient_signals")
        .otherwise("irrelevant")
    )


def demote(run: DataFrame, flagged: DataFrame, by: int = 2) -> DataFrame:
    """Each flagged id moves ``by`` places down, in id order, unless it is among the last ``by``.

    A topic's short list is one array, so the moves are a fold inside a row.
    """
    lists = run.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    bad = flagged.groupBy("topic_id").agg(F.array_sort(F.collect_set("doc_id")).alias("bad"))
    rows = lists.join(bad, "topic_id", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<bigint>")))

    def move(ids: Column, x: Column) -> Column:
        at = F.array_position(ids, x)
        moved = F.concat(
            F.filter(F.slice(ids, F.lit(1), F.least(at + by, F.size(ids))), lambda y: y != x),
            F.array(x),
            F.slice(ids, (at + by + 1).cast("int"), F.size(ids)),
        )
        return F.when((at > 0) & (at - 1 < F.size(ids) - by), moved).otherwise(ids)

    done = rows.select("topic_id", F.posexplode(F.aggregate("bad", F.col("ids"), move)).alias("i", "doc_id"))
    return done.select("topic_id", "doc_id", (F.col("i") + 1).alias("rank"))
