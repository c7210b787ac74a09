"""Hard filters, overlap features and candidate selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.text import entity_terms, irrelevance_terms, jaccard, once, overlap_cosine, selection_terms, support
from quillmatch.operators.lineage import cut
from quillmatch.operators.retrieval import small, top


def hard_filter(
    candidates: DataFrame, trials: DataFrame, people: DataFrame, statuses: tuple | None = None, filter_status: bool = True
) -> DataFrame:
    """``candidates`` (topic_id, trial) with hard_excluded and the first reason to exclude, or null; nothing is dropped.

    ``trials``: trial, status, sex (ALL, MALE, FEMALE), min_days, max_days, raw_min, raw_max.  ``people``: topic_id,
    age_years, sex (male, female, unknown).  Reasons in order: not in the corpus, age, sex, status; what is unknown passes.
    """
    allowed = sorted(X.ACTIVE_STATUSES if statuses is None else statuses)
    rows = candidates.join(people.withColumnRenamed("sex", "own_sex"), "topic_id", "left").join(
        trials.withColumn("known", F.lit(True)), "trial", "left"
    )
    days, text = F.col("age_years").cast("double") * 365, lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    young, old = F.coalesce(days < F.col("min_days"), F.lit(False)), F.coalesce(days > F.col("max_days"), F.lit(False))
    own = F.coalesce("own_sex", F.lit("unknown"))
    other_sex = (F.col("sex") != "ALL") & (own != "unknown") & (F.upper(own) != F.col("sex"))
    age = F.coalesce(F.col("age_years").cast("double").cast("string"), F.lit("None"))
    listed = "[" + ", ".join(f"'{s}'" for s in allowed) + "]"
    reason = F.when(F.col("known").isNull(), "trial not found in corpus").when(
        young | old, F.concat(F.lit("age "), age, F.lit(" outside ["), text("raw_min"), F.lit(", "), text("raw_max"), F.lit("]"))
    )
    reason = reason.when(other_sex, F.concat(F.lit("sex "), own, F.lit(" vs trial "), F.col("sex")))
    if filter_status:
        reason = reason.when(~F.col("status").isin(allowed), F.concat(F.lit("status "), F.col("status"), F.lit(f" not in {listed}")))
    rows = rows.select(*[rows[c] for c in candidates.columns], reason.alias("excluded_reason"))
    return rows.withColumn("hard_excluded", F.col("excluded_reason").isNotNull())


def corpus_filter(
    trials: DataFrame, interventional: bool = True, criteria: bool = True, updated_since: str | None = "2018-01-01"
) -> DataFrame:
    """Trials that enter the corpus: interventional, with criteria, updated since a day or at an unknown time."""
    if interventional:
        trials = trials.where("interventional")
    if criteria:
        trials = trials.where(F.trim(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"\s+", " ")) != "")
    if updated_since is not None:
        trials = trials.where(F.col("updated").isNull() | (F.col("updated") >= F.lit(updated_since).cast("date")))
    return trials


def payload_filter(rows: DataFrame, filters: dict) -> DataFrame:
    """Rows that equal every value of ``filters``, or one of its values where these are a list."""
    for name, wanted in filters.items():
        rows = rows.where(F.col(name).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    return rows


def features(run: DataFrame, docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Overlap cosine, Jaccard and support of each candidate's terms with its topic's."""
    run = cut(run)  # counted before it is joined
    cands = docs.join(small(run.select("doc_id").distinct()), "doc_id").select("doc_id", entity_terms(F.col("text")).alias("d"))
    asked = topics.select("topic_id", entity_terms(F.col("text")).alias("q"))
    rows = run.join(cands, "doc_id").join(small(asked), "topic_id")
    return rows.select(
        "topic_id",
        "doc_id",
        F.round(overlap_cosine(F.col("q"), F.col("d")), 6).alias("cosine"),
        F.round(jaccard(F.col("q"), F.col("d")), 6).alias("jaccard"),
        F.round(support(F.col("d"), F.col("q")), 6).alias("support"),
    )


def top_score(run: DataFrame, cap: int) -> DataFrame:
    return top(run.drop("rank"), ["topic_id"], [F.desc_nulls_last("score"), F.asc("doc_id")], cap).select("topic_id", "doc_id", "score", "rank")


def prior(run: DataFrame) -> DataFrame:
    """1 for the first rank down to 0 for the last; 1 for a single candidate."""
    last = F.max("rank").over(W.partitionBy("topic_id"))
    value = F.when(last <= 1, 1.0).otherwise(1 - (F.col("rank") - 1) / (last - 1))
    return run.withColumn("prior", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 6))


def diverse(run: DataFrame, docs: DataFrame, topics: DataFrame, keep: int, total: int) -> DataFrame:
    """Greedy selection of ``total`` from each topic's pool: the first ``keep`` stay, then the best of
    .70 retrieval + .20 support + .10 (1 - highest Jaccard with the selected); ties by score, rank, id.

    A pool is a bounded array of one row, so the greedy steps are a fold inside it.
    """
    run = cut(run)  # counted before it is joined
    cands = docs.join(small(run.select("doc_id").distinct()), "doc_id").select("doc_id", selection_terms(F.col("text")).alias("d"))
    asked = topics.select("topic_id", selection_terms(F.col("text")).alias("q"))
    rows = run.join(cands, "doc_id").join(small(asked), "topic_id")
    w = W.partitionBy("topic_id")
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    norm = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.when(n == 1, 1.0).otherwise(1 - (F.col("rank") - 1) / (n - 1)))
    rows = rows.withColumn("base", 0.70 * norm + 0.20 * support(F.col("d"), F.col("q")))
    pool = rows.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", "base", "d"))).alias("pool"))

    def value(c, chosen):
        near = F.array_max(F.transform(chosen, lambda s: jaccard(c["d"], s["d"])))
        return F.struct(
            F.round(c["base"] + 0.10 * (1 - F.coalesce(near, F.lit(0.0))), 9).alias("v"),
            c["score"].alias("score"),
            (-c["rank"]).alias("back"),
            c["doc_id"].alias("doc_id"),
        )

    def step(chosen, _):
        def pick(left):
            best = F.array_max(F.transform(left, lambda c: value(c, chosen)))
            more = once(best, lambda b: F.concat(chosen, F.filter(left, lambda c: c["doc_id"] == b["doc_id"])))
            return F.when(F.size(left) == 0, chosen).otherwise(more)

        return once(F.filter("pool", lambda c: ~F.exists(chosen, lambda s: s["doc_id"] == c["doc_id"])), pick)

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(total - keep)), F.slice("pool", 1, keep), step)
    out = pool.select("topic_id", F.posexplode(picked).alias("i", "c"))
    return out.select("topic_id", F.col("c.doc_id").alias("doc_id"), (F.col("i") + 1).alias("place"))


def irrelevance_signals(run: DataFrame, people: DataFrame, trials: DataFrame) -> DataFrame:
    """topic_id, doc_id, no_condition, no_intervention: whether a person's terms miss a trial's.

    ``people``: topic_id, conditions, treatments (texts); ``trials``: doc_id, titles, treatments (texts).
    """
    run = cut(run)  # counted before it is joined, and not made twice
    asked = people.select("topic_id", irrelevance_terms(F.col("conditions")).alias("pc"), irrelevance_terms(F.col("treatments")).alias("pt"))
    told = trials.join(small(run.select("doc_id").distinct()), "doc_id", "left_semi").select(
        "doc_id", irrelevance_terms(F.col("titles")).alias("tc"), irrelevance_terms(F.col("treatments")).alias("tt")
    )
    apart = lambda a, b: F.size(F.array_intersect(a, b)) == 0
    rows = run.select("topic_id", "doc_id").join(told, "doc_id").join(asked, "topic_id")
    return rows.select("topic_id", "doc_id", apart("pc", "tc").alias("no_condition"), apart("pt", "tt").alias("no_intervention"))
