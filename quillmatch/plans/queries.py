"""The registered queries over the driver tables, and what the tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import criteria as C
from quillmatch.functions import fixed as X
from quillmatch.functions import text as T
from quillmatch.operators import eligibility as E
from quillmatch.operators import evaluation as V
from quillmatch.operators import report as P
from quillmatch.operators import retrieval as R
from quillmatch.operators import selection as S

AS_OF = "2001-08-01"
TYPES = ("other", "age", "sex", "biomarker", "lab", "diagnosis", "comorbidity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def topics(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_id"), "text")


def qrels(spark, sf_dir):
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    grade = F.when(quality & ~toxic, 2).when(quality | toxic, 1).otherwise(0)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def _evaluated(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 2).alias("topic_id"),
        F.col("l_orderkey").alias("trial"),
        F.col("l_linenumber").alias("criterion"),
        F.when(F.col("l_linestatus") == "O", "inclusion").otherwise("exclusion").alias("polarity"),
        F.when(F.col("l_returnflag") == "A", "met").when(F.col("l_returnflag") == "N", "NEI").otherwise("not_met").alias("label"),
        (F.col("l_discount") * 10).alias("confidence"),
        (F.col("l_quantity") >= 10).alias("mandatory"),
        F.get(F.array(*map(F.lit, TYPES)), F.col("l_linenumber") % 7).alias("type"),
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


LAST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def evaluations(spark, sf_dir):
    """Criterion evaluations, the last of each topic, trial and criterion."""
    return E.last_wins(_evaluated(spark, sf_dir), LAST)


def trial_criteria(spark, sf_dir, *unused, by_trial=False):
    """The criteria of each trial, whoever they were evaluated for.

    ``unused``: columns that need not be carried along; ``by_trial``: evaluations are dealt by trial before the last is
    picked, so that what follows by trial moves nothing again.
    """
    rows = _evaluated(spark, sf_dir).drop("topic_id", *unused)
    return E.last_wins(rows.repartition("trial") if by_trial else rows, LAST, ["trial", "criterion"])


def trials(spark, sf_dir):
    """Trial metadata from orders."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RECRUITING").otherwise("ACTIVE_NOT_RECRUITING")
    phases = ("NA", "PHASE1", "PHASE2", "PHASE3", "PHASE4", "NA", "NA", "NA", "NA", "NA")
    return o.select(
        F.col("o_orderkey").alias("trial"),
        status.alias("status"),
        F.get(F.array(*map(F.lit, phases)), F.substring("o_orderpriority", 1, 1).try_cast("int")).alias("phase"),
        F.to_date("o_orderdate").alias("updated"),
    )


def labelled(spark, sf_dir, mode="benchmark", irrelevance=False):
    counts = E.trial_counts(evaluations(spark, sf_dir))
    return counts.withColumn("label", E.trial_label(mode, irrelevance))


# --- text -----------------------------------------------------------------


def tok_bm25(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.index_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def tok_entity_stem(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.entity_terms(F.col("text"), drop_generic=True).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("terms"))


def tok_selection(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.selection_terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("terms"))


#: English notes with cues, derived from conversations so that rules fire.
NOTES = ("No evidence of ", "within the past 6 months ", "history of ", "at least 3 weeks since ", "currently ", "without ")


def notes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    cue = F.get(F.array(*map(F.lit, NOTES)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(NOTES))).cast("int"))
    return c.select("conv_id", "turn", F.concat(cue, F.coalesce("text", F.lit(""))).alias("note"))


def negation_cue(spark, sf_dir):
    return notes(spark, sf_dir).select(
        "conv_id", "turn", T.has_negation(F.col("note")).alias("negated"), F.length(T.annotate_negation(F.col("note"))).cast("long").alias("n_annotated")
    )


def negation_window(spark, sf_dir):
    rows = notes(spark, sf_dir).select("conv_id", "turn", T.negated_terms(F.col("note")).alias("t"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort("t"), " ").alias("terms"))


def temporal_extract(spark, sf_dir):
    return notes(spark, sf_dir).select("conv_id", "turn", T.temporal(F.col("note")).alias("x")).select("conv_id", "turn", "x.relation", "x.days")


def temporal_annotate(spark, sf_dir):
    return notes(spark, sf_dir).select("conv_id", "turn", F.md5(T.annotate_temporal(F.col("note")).cast("binary")).alias("digest"))


def age_to_days(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, ("Years", "months", "Weeks", "day", "Hours", "minutes", "N/A"))), (F.col("p_size") % 7).cast("int"))
    age = F.concat(F.col("p_size").cast("string"), F.lit(" "), unit)
    return table(spark, sf_dir, "part").select("p_partkey", age.alias("age"), T.age_days(age).alias("days"))


PHASE_TEXTS = ("Phase 1", "phase 2/phase 3", "PHASE3", "Early Phase 1", "Phase 1/Phase 2", "N/A", "", "Phase 4")


def phase_norm(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, PHASE_TEXTS)), (F.col("p_size") % len(PHASE_TEXTS)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", T.phase_json(F.col("t")).alias("json_phase"), T.phase_xml(F.col("t")).alias("xml_phase"))


def status_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.lit("Not yet"), F.when(F.col("c_custkey") % 2 == 0, "recruiting").otherwise("sure")).alias("t"))
    return rows.select("c_custkey", T.status(F.col("t")).alias("status"))


def date_multi(spark, sf_dir):
    d = F.to_date("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy"))
        .otherwise("unknown")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.any_date(text).cast("string").alias("day"))


def split_eligibility(spark, sf_dir):
    head = F.lit("Inclusion Criteria: ")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    t = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(head, F.get(lines, F.lit(0)), F.lit(" EXCLUSION criteria "), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")))
        .when(F.col("doc_id") % 4 == 1, F.concat(head, F.col("text")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.col("text"), F.lit(" exclusion criteria: x y")))
        .otherwise(F.col("text"))
    )
    rows = documents(spark, sf_dir).select("doc_id", T.split_eligibility(t).alias("x"))
    return rows.select("doc_id", F.md5(F.col("x.inclusion").cast("binary")).alias("inclusion"), F.md5(F.col("x.exclusion").cast("binary")).alias("exclusion"))


def clean_truncate(spark, sf_dir):
    t = F.concat(F.lit("[**name**] "), F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).select("doc_id", T.clean(t, 260).alias("cleaned"))


def html_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title, lang = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return p.select("page_id", title.alias("title"), lang.alias("lang"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


def sha_key(spark, sf_dir):
    key = F.to_json(F.struct("c_custkey", "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(key.cast("binary"), 256).alias("key"))


def corpus_filter(spark, sf_dir):
    t = trials(spark, sf_dir)
    return t.where("status <> 'COMPLETED' and (updated is null or updated >= date'1997-01-01')").select("trial", "status")


# --- retrieval --------------------------------------------------------------


def bm25_topk(spark, sf_dir):
    return R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 20).select("topic_id", "doc_id", "score", "rank")


def bm25_fielded_runs(spark, sf_dir):
    return R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 10, list(X.FIELD_WEIGHTS))


def bm25_fielded_rrf(spark, sf_dir):
    return R.fielded(documents(spark, sf_dir), topics(spark, sf_dir), 20)


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def dense_cosine_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.dense(v, q, 20)


def dense_filtered_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.dense(v.where("label in (1, 2)"), q, 10)


def hyde_mean_vector(spark, sf_dir):
    v, _ = _vectors(spark, sf_dir)
    # each vector with the three that follow it stands for a query and its three hypothetical answers
    parts = v.select(F.floor(F.col("vec_id") / 4).alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("query_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def rrf_hybrid(spark, sf_dir):
    """Lexical and dense runs of all topics, fused; vectors whose id is divisible by 20 are searched for beside the topics' own."""
    lexical = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 50)
    v, q = _vectors(spark, sf_dir)
    ids = topics(spark, sf_dir).select(F.col("topic_id").alias("vec_id"))
    own = v.where("vec_id % 20 <> 0").join(R.small(ids), "vec_id", "left_semi")
    near = R.dense(v, q.unionByName(own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))), 50)
    runs = lexical.select(F.lit("bm25").alias("source"), "topic_id", "doc_id", "rank").unionAll(
        near.select(F.lit("dense").alias("source"), F.col("query_id").alias("topic_id"), F.col("vec_id").alias("doc_id"), "rank")
    )
    return R.fuse(runs, 30, {"bm25": 1.0, "dense": 1.0})


def rerank_blend(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 50)
    run = run.withColumn("rerank", F.pmod(F.col("doc_id") * 7919 + F.col("topic_id") * 31, F.lit(1000)).cast("double"))
    return R.blend(run, 0.3, 20)


def run_overlap(spark, sf_dir):
    a = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 100)
    b = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 100, ["summary_description"])
    return V.overlap(a, b)


# --- filters, selection -------------------------------------------------------


def studies(spark, sf_dir):
    """Trials with age limits and sex."""
    low, high = F.col("trial") % 40, F.col("trial") % 40 + 15
    return trials(spark, sf_dir).select(
        "trial",
        "status",
        F.when(F.col("trial") % 4 == 0, "MALE").when(F.col("trial") % 4 == 1, "FEMALE").otherwise("ALL").alias("sex"),
        F.when(F.col("trial") % 7 > 0, low * 365).alias("min_days"),
        F.when(F.col("trial") % 5 > 0, high * 365).alias("max_days"),
        F.when(F.col("trial") % 7 > 0, F.concat(low.cast("string"), F.lit(" Years"))).alias("raw_min"),
        F.when(F.col("trial") % 5 > 0, F.concat(high.cast("string"), F.lit(" Years"))).alias("raw_max"),
    )


def people(spark, sf_dir):
    sex = F.get(F.array(F.lit("male"), F.lit("female"), F.lit("unknown")), (F.col("p_partkey") % 3).cast("int"))
    age = F.when(F.col("p_partkey") % 9 > 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), age.alias("age_years"), sex.alias("sex"))


def hard_filter_reasons(spark, sf_dir):
    cands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), F.col("p_partkey").alias("trial"))
    return S.hard_filter(cands, studies(spark, sf_dir), people(spark, sf_dir))


def viable_counts(spark, sf_dir):
    return hard_filter_reasons(spark, sf_dir).groupBy("excluded_reason").agg(F.count("*").alias("n"))


def overlap_features(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 20)
    return S.features(run, documents(spark, sf_dir), topics(spark, sf_dir))


def top_score_select(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 50)
    return S.top_score(run, 5)


def retrieval_prior(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 50)
    return S.prior(run).select("topic_id", "doc_id", "prior")


def mmr_select(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 20)
    return S.diverse(run, documents(spark, sf_dir), topics(spark, sf_dir), keep=3, total=10)


# --- criteria, labels, scores ---------------------------------------------------


def trial_label_benchmark(spark, sf_dir):
    rows = labelled(spark, sf_dir, "benchmark")
    return rows.select(*E.KEY, "label", E.grade(F.col("label")).alias("qrel"), "n_inc", "n_exc", F.round("fraction_nei", 6).alias("fraction_nei"))


def trial_label_clinical(spark, sf_dir):
    return labelled(spark, sf_dir, "clinical", irrelevance=True).select(*E.KEY, "label")


def predicate_eval(spark, sf_dir):
    op = F.get(F.array(*map(F.lit, (">=", "<=", ">", "<", "=", "!=", "in"))), (F.col("p_partkey") % 7).cast("int"))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", E.compare(F.when(F.col("p_size") > 3, F.col("p_size")), op, F.lit(25)).alias("label"))


def sc_vote(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    votes = li.select(
        (F.col("l_suppkey") % 2).alias("topic_id"),
        (F.col("l_orderkey") % 500).alias("trial"),
        F.col("l_linenumber").alias("criterion"),
        F.col("l_returnflag").alias("label"),
        F.col("l_discount").alias("confidence"),
    )
    return E.vote(votes)


def eligibility_score(spark, sf_dir):
    return labelled(spark, sf_dir).select(*E.KEY, F.round(E.eligibility_score(), 6).alias("score"))


def _scored(spark, sf_dir, mode):
    rows = labelled(spark, sf_dir, mode).join(trials(spark, sf_dir), "trial")
    return rows.select(
        "*",
        E.eligibility_score().alias("elig"),
        E.table_value(F.col("status"), X.STATUS_BONUS[mode], 0.0).alias("status_bonus"),
        E.table_value(F.col("phase"), X.PHASE_PRIORITY, 0.5).alias("phase_score"),
        E.recency(F.col("updated"), F.lit(AS_OF).cast("date")).alias("recency"),
        F.lit(0.0).alias("geography"),
        (F.col("trial") % 100 / 100).alias("prior"),
    )


def trial_score_hard(spark, sf_dir):
    return _scored(spark, sf_dir, "clinical").select(*E.KEY, F.round(E.trial_score("clinical", False), 6).alias("score"))


def trial_score_soft(spark, sf_dir):
    return _scored(spark, sf_dir, "benchmark").select(*E.KEY, F.round(E.trial_score("benchmark", True), 6).alias("score"))


def criterion_evidence(spark, sf_dir):
    evals = evaluations(spark, sf_dir)
    counts = E.trial_counts(evals).withColumn("label", E.trial_label("benchmark"))
    rows = E.evidence(evals, counts)
    # sums may differ in their last bit by order: a nudge keeps values halfway between two roundings on one side
    return rows.select(*E.KEY, *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in rows.columns if c not in (*E.KEY, "fraction_nei")])


def label_histogram(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy("type", "polarity", "label").agg(F.count("*").alias("n"))


# --- evaluation -------------------------------------------------------------------


def trec_metrics(spark, sf_dir):
    return V.topic_metrics(bm25_topk(spark, sf_dir), qrels(spark, sf_dir))


def trec_metrics_linear(spark, sf_dir):
    return V.topic_metrics(bm25_topk(spark, sf_dir), qrels(spark, sf_dir), linear=True)


def trec_summary(spark, sf_dir):
    return V.summary(trec_metrics(spark, sf_dir))


def _pairs(spark, sf_dir):
    """Gold from the benchmark policy, predictions from the clinical one."""
    rows = E.trial_counts(evaluations(spark, sf_dir))
    return rows.select(
        *E.KEY,
        E.grade(E.trial_label("benchmark", True)).alias("gold"),
        E.grade(E.trial_label("clinical", True)).alias("predicted"),
        E.eligibility_score().alias("score"),
        ((F.col("exc_met") > 0) | F.col("mandatory_failed")).alias("veto"),
    )


def f1_trial(spark, sf_dir):
    return V.class_scores(_pairs(spark, sf_dir))


def f1_average(spark, sf_dir):
    return V.averages(f1_trial(spark, sf_dir))


def confusion(spark, sf_dir):
    return V.confusion(_pairs(spark, sf_dir))


def threshold_sweep(spark, sf_dir):
    """Label policies on the criterion counts against grades that only depend on the trial."""
    rows = labelled(spark, sf_dir).select(
        (F.col("trial") % 3).alias("gold"), "n_inc", "inc_met", "exc_met", "fraction_nei", ((F.col("exc_met") > 1) | F.col("mandatory_failed")).alias("veto")
    )
    return V.sweep(rows, [round(0.05 * i, 2) for i in range(1, 15)], [round(0.1 * i, 2) for i in range(1, 11)])


def stage_metrics(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 200)
    return V.stage_hits(run, qrels(spark, sf_dir))


def missing_reasons(spark, sf_dir):
    docs, run = documents(spark, sf_dir), bm25_topk(spark, sf_dir)
    index = docs.where("doc_id % 10 <> 3")
    judged = qrels(spark, sf_dir).withColumn("topic_id", F.pmod("doc_id", F.lit(40)).cast("long"))
    rows = V.missing(judged, docs.where("doc_id % 10 <> 7"), index, run)
    return rows.groupBy("topic_id", "reason").agg(F.count("*").alias("n"))


# --- criteria and reports -----------------------------------------------------------

CRITERIA = (
    "Age 18 years or older", "Male or female", "ECOG performance status 0-1", "HER2 positive by IHC", "Prior chemotherapy within 4 weeks",
    "Adequate organ function", "Pregnant or breast-feeding women", "Active HIV infection", "Histologically confirmed melanoma",
    "Able to give informed consent", "Radiotherapy:", "See Disease Characteristics", "Inclusion Criteria:", "Creatinine < 1.5 mg/dL:",
    "Likes long walks", "- Platelets >= 100,000", "For control participants", "EGFR mutation or normal eGFR", "", "Arm 1:",
)


def _criteria(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, CRITERIA)), F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), F.lit(len(CRITERIA))).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("criterion"))


def infer_type(spark, sf_dir):
    return _criteria(spark, sf_dir).select("p_partkey", C.criterion_type(F.col("criterion")).alias("type"))


def section_header(spark, sf_dir):
    t = F.col("criterion")
    return _criteria(spark, sf_dir).select("p_partkey", C.is_header(t).alias("header"), C.header_action(t).alias("action"))


def question_type(spark, sf_dir):
    return _criteria(spark, sf_dir).select("p_partkey", C.question_type(F.col("criterion")).alias("type"))


def segment_lines(spark, sf_dir):
    """Documents whose lines become bullets, blanks, headings and continuations in turn."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marked = F.transform(
        lines,
        lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("- "), x)).when(i % 5 == 2, F.lit(" ")).when(i % 5 == 3, F.lit("Organ function:")).otherwise(x),
    )
    texts = documents(spark, sf_dir).select("doc_id", F.array_join(marked, "\n").alias("text"))
    return C.line_chunks(texts, "doc_id").select("doc_id", "n", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def cap_legacy(spark, sf_dir):
    rows = trial_criteria(spark, sf_dir).select("trial", F.col("criterion").alias("pos"), "polarity")
    return C.cap_balanced(rows, "trial", 4)


def _questions(spark, sf_dir):
    c = _criteria(spark, sf_dir)
    text = F.concat(F.lit("Can you confirm the status of: "), F.col("criterion"), F.when(F.col("p_partkey") % 3 == 0, "?").otherwise(""))
    return c.select(
        "p_partkey",
        text.alias("question_text"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("criterion")).alias("data_point"),
        F.when(F.col("p_partkey") % 5 == 0, "30 days").alias("time_window"),
        C.question_type(F.col("criterion")).alias("expected_data_type"),
        F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("The trial needs it: "), F.col("criterion"))).alias("rationale"),
    )


def question_rubric(spark, sf_dir):
    return _questions(spark, sf_dir).select("p_partkey", P.rubric().alias("x")).select("p_partkey", "x.*")


def question_summary(spark, sf_dir):
    rows = question_rubric(spark, sf_dir)
    half = [F.round(F.avg(c) / 2, 6).alias(c) for c in ("specific", "temporal", "format", "rationale_score", "actionable")]
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("normalized"), 6).alias("mean_score"), *half)


def dossier_completeness(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    yes = lambda n: F.col("c_custkey") % n > 0
    need, may = [yes(n) for n in (2, 3, 5, 7, 11, 13, 17, 19)], [yes(n) for n in (2, 3, 4, 5)]
    return c.select("c_custkey", F.round(P.completeness(need, may, F.col("c_acctbal") > 0), 6).alias("completeness"))


def error_categories(spark, sf_dir):
    rows = E.trial_counts(evaluations(spark, sf_dir)).select(
        "*",
        (F.col("trial") % 3).alias("gold"),
        E.grade(E.trial_label("benchmark")).alias("predicted"),
        (F.col("trial") % 2 == 0).alias("judged"),
        E.eligibility_score().alias("score"),
        ((F.col("exc_met") > 0) | F.col("mandatory_failed")).alias("veto"),
        (F.col("trial") % 10 / 10).alias("prior"),
    )
    rows = rows.where("gold <> predicted").select(F.explode(P.error_categories()).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def attention_flags(spark, sf_dir):
    rows = labelled(spark, sf_dir).join(trials(spark, sf_dir), "trial").withColumn("in_country", F.col("trial") % 4 > 0)
    return rows.select(*E.KEY, F.array_join(P.attention_flags(), ",").alias("flags"))


def geography(spark, sf_dir):
    """Customers against the nations of their region's suppliers, as sites in key order."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sites = nations.groupBy(F.col("n_regionkey").alias("site_region")).agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("state"), F.lit("").alias("city")))).alias("sites")
    )
    home = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    home = home.join(F.broadcast(sites), F.col("c_custkey") % 5 == F.col("site_region")).select("c_custkey", "r_name", "n_name", "sites")
    place = F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).when(F.col("c_custkey") % 3 == 1, F.concat("r_name", F.lit(" city"))).otherwise(F.col("n_name"))
    return home.select("c_custkey", P.geography(F.col("sites"), place).alias("score"))


def fill_excluded(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 30)
    marks = run.select("*", (F.col("doc_id") % 2 == 0).alias("hard_excluded"), (F.col("rank") == 7).alias("evaluated"), (F.col("doc_id") % 11 > 0).alias("in_corpus"))
    rows = P.fill(run.where("rank <= 5"), marks.where("rank % 4 > 0"), 15, tail=True)
    return rows.select("topic_id", "doc_id", F.round("score", 6).alias("score"), "source")


def irrelevance_policy(spark, sf_dir):
    rows = labelled(spark, sf_dir, "benchmark").select(
        "*",
        (F.col("trial") % 10 / 10).alias("prior"),
        (F.col("trial") % 2 == 0).alias("no_condition"),
        (F.col("trial") % 3 == 0).alias("no_intervention"),
    )
    return rows.select(*E.KEY, P.irrelevance(least=4).alias("outcome"))


def index_coverage(spark, sf_dir):
    """Judged documents that are in the corpus and in the index, by grade."""
    docs = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 10 != 3).alias("indexed"))
    rows = qrels(spark, sf_dir).join(docs, "doc_id", "left")
    return rows.groupBy("grade").agg(F.count("*").alias("judged"), F.count("indexed").alias("in_corpus"), F.count_if("indexed").alias("in_index"))


def event_windows(spark, sf_dir):
    from quillmatch.streaming.ingest import timings

    return timings(table(spark, sf_dir, "events"), width="1 day").select("start", "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def triage_score(spark, sf_dir):
    c = _criteria(spark, sf_dir).withColumn("kind", C.criterion_type(F.col("criterion")))
    polarity = F.when(F.col("p_partkey") % 2 == 0, "exclusion").otherwise("inclusion")
    terms = F.array(*map(F.lit, ("melanoma", "her2", "chemotherapy", "hiv", "infection")))
    return c.select("p_partkey", F.round(C.triage_score(C.triage_facts(F.col("criterion")), F.col("kind"), polarity, F.col("p_partkey") % 3 == 0, terms), 6).alias("score"))


def alias_norm(spark, sf_dir):
    names = ("Number", "yes-no", "Free text", "lab value", "DATETIME", "category", "other kind")
    t = F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.data_type(t).alias("type"))


TERMS = ("Metastatic (Melanoma)", "advanced  breast cancer", "stage IV sarcoma", "asthma", "weird melanoma thing", "nothing here")


def thesaurus_lookup(spark, sf_dir):
    """Concepts of terms by the first key that a small synonym table has."""
    book = spark.createDataFrame([("melanoma", "D1"), ("breast cancer", "D2"), ("sarcoma", "D3"), ("asthma", "D4"), ("cancer", "D5")], "key string, concept string")
    t = F.get(F.array(*map(F.lit, TERMS)), (F.col("p_partkey") % len(TERMS)).cast("int"))
    keys = table(spark, sf_dir, "part").select("p_partkey", t.alias("term")).select("p_partkey", F.posexplode(C.lookup_keys(F.col("term"))).alias("i", "key"))
    hits = keys.join(F.broadcast(book), "key")
    return hits.groupBy("p_partkey").agg(F.min_by("concept", "i").alias("concept"))


def verifier_rule(spark, sf_dir):
    strength = F.get(F.array(*map(F.lit, ("none", "weak", "moderate", "strong"))), (F.col("trial") % 4).cast("int"))
    revised = F.get(F.array(*map(F.lit, ("met", "not_met", "NEI"))), (F.col("trial") % 3).cast("int"))
    x = E.verified(F.col("label"), F.col("confidence"), strength, revised)
    return evaluations(spark, sf_dir).select(*E.KEY, "criterion", x.alias("x")).select(*E.KEY, "criterion", "x.label", F.round("x.confidence", 6).alias("confidence"), "x.flipped")


def cascade_route(spark, sf_dir):
    known = F.when(F.col("trial") % 2 == 0, F.col("label"))
    rows = evaluations(spark, sf_dir).select(E.route(F.col("type"), known).alias("route"))
    return rows.groupBy("route").agg(F.count("*").alias("n"))


def evidence_adjust(spark, sf_dir):
    scored = _scored(spark, sf_dir, "benchmark").withColumn("score", E.trial_score("benchmark", False))
    evals = evaluations(spark, sf_dir)
    facts = E.evidence(evals, E.trial_counts(evals).withColumn("label", E.trial_label("benchmark"))).select(*E.KEY, "evidence")
    veto = (F.col("exc_met") > 0) | F.col("mandatory_failed")
    return scored.join(facts, E.KEY).select(*E.KEY, F.round(E.adjust(F.col("score"), F.col("evidence"), veto, 0.5) + 1e-9, 6).alias("score"))


def critique_demote(spark, sf_dir):
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 10)
    return P.demote(run, run.where("doc_id % 3 = 0").select("topic_id", "doc_id"))


def final_ranked_gap(spark, sf_dir):
    """Relevant documents of the first twenty that the selection of ten lost, by topic."""
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 20)
    lost = run.where("rank <= 20").join(run.where("rank <= 10").select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_anti")
    rows = lost.join(qrels(spark, sf_dir), "doc_id", "left")
    return rows.groupBy("topic_id").agg(
        F.count("*").alias("missing"), F.count_if(F.col("grade") > 0).alias("relevant_lost"), F.count_if(F.col("grade") == 2).alias("eligible_lost")
    )


def stage_aggregate(spark, sf_dir):
    rows = stage_metrics(spark, sf_dir)
    return rows.groupBy("cutoff").agg(
        F.round(F.avg("relevant"), 6).alias("mean_relevant"), F.round(F.avg("eligible"), 6).alias("mean_eligible"), F.count_if(F.col("relevant") == 0).alias("zero_topics")
    )


def run_compare(spark, sf_dir):
    """Metrics of the lexical run and of its blend, side by side."""
    judged, run = qrels(spark, sf_dir), bm25_topk(spark, sf_dir)
    a = V.summary(V.topic_metrics(run, judged)).select(F.lit("bm25").alias("run"), "*")
    b = V.summary(V.topic_metrics(rerank_blend(spark, sf_dir).select("topic_id", "doc_id", "rank"), judged)).select(F.lit("blend").alias("run"), "*")
    return a.unionAll(b)


def reretrieval_flag(spark, sf_dir):
    """Topics with under ten viable candidates are searched again."""
    run = R.bm25(documents(spark, sf_dir), topics(spark, sf_dir), 20)
    got = run.groupBy("topic_id").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("viable"))
    return got.select("topic_id", "viable", (F.col("viable") < 10).alias("again"))


def fewshot_knn(spark, sf_dir):
    """The three nearest examples of each query vector; ties go to the later example."""
    v, q = _vectors(spark, sf_dir)
    return R.dense(v.where("vec_id % 20 <> 0"), q, 3, last=True)


QUERIES = {
    f.__name__: f
    for f in (
        tok_bm25, tok_entity_stem, tok_selection, negation_cue, negation_window, temporal_extract, temporal_annotate,
        age_to_days, phase_norm, status_norm, date_multi, split_eligibility, clean_truncate, html_fields, sha_key,
        corpus_filter, bm25_topk, bm25_fielded_runs, bm25_fielded_rrf, dense_cosine_topk, dense_filtered_topk,
        hyde_mean_vector, rrf_hybrid, rerank_blend, run_overlap, hard_filter_reasons, viable_counts, overlap_features,
        top_score_select, retrieval_prior, mmr_select, trial_label_benchmark, trial_label_clinical, predicate_eval,
        sc_vote, eligibility_score, trial_score_hard, trial_score_soft, criterion_evidence, label_histogram,
        trec_metrics, trec_metrics_linear, trec_summary, f1_trial, f1_average, confusion, threshold_sweep,
        stage_metrics, missing_reasons, infer_type, section_header, question_type, segment_lines, cap_legacy, question_rubric,
        question_summary, dossier_completeness, error_categories, attention_flags, geography, fill_excluded,
        irrelevance_policy, index_coverage, event_windows, triage_score, alias_norm, thesaurus_lookup, verifier_rule,
        cascade_route, evidence_adjust, critique_demote, final_ranked_gap, stage_aggregate, run_compare,
        reretrieval_flag, fewshot_knn,
    )
}
