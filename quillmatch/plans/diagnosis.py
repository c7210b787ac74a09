"""Registered queries of end-to-end matching, retrieval audits, calibration, listwise windows and profiles, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.lenient import lenient_json
from quillmatch.functions.profiles import profile
from quillmatch.operators import calibration as K
from quillmatch.operators import dossier as D
from quillmatch.operators import ranking as G
from quillmatch.operators import retrieval as R
from quillmatch.operators import retrieval_audit as A
from quillmatch.plans import matching as N
from quillmatch.plans import oracle as O
from quillmatch.plans import pipeline as P
from quillmatch.plans import queries as Q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# --- matching from end to end --------------------------------------------------------


def _match_sql(mode: str, run: str, weight: float, k: int) -> str:
    """Lexical candidates, their priors, each topic's own evaluations, labels, scores, evidence, ranks."""
    w = X.SCORE_WEIGHTS
    days = f"date_diff('day', updated, DATE '{P.Config.as_of}')"
    elig = f"CASE WHEN n_inc + n_exc = 0 THEN 0 ELSE {O.ELIG} END"
    base = f"""({w['eligibility']} * {elig} + {w['recruiting']} * {O._case('status', X.STATUS_BONUS[mode], 0)} + {w['phase']} * {O._case('phase', X.PHASE_PRIORITY, 0.5)}
        + {w['recency']} * CASE WHEN updated IS NULL THEN 0 WHEN {days} <= 0 THEN 1 ELSE 1 / (1 + ln(1 + {days} / 365.0::DOUBLE)) END + {w['retrieval']} * prior - {w['nei']} * fraction_nei) * (0.5::DOUBLE * coalesce(avg_confidence, 0.7::DOUBLE) + 0.5::DOUBLE)"""
    zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_inc", "n_exc", "inc_met", "inc_not", "inc_nei", "exc_met", "exc_not", "exc_nei", "fraction_nei"))
    evidence = O.evidence().replace("+ 1e-9, 6)::DOUBLE AS evidence", ", 15)::DOUBLE AS evidence")
    return f"""WITH {run}, {O.EVALS}, {O.COUNTS}, {O.TRIALS}, ev AS ({evidence}),
      p AS (SELECT topic_id, doc_id, round(CASE WHEN m <= 1 THEN 1 ELSE 1 - (rank - 1) / (m - 1) END, 6)::DOUBLE AS prior FROM (SELECT *, max(rank) OVER (PARTITION BY topic_id) AS m FROM found) WHERE rank <= 10),
      c AS (SELECT p.*, {zeros}, coalesce(mandatory_failed, false) AS mandatory_failed, avg_confidence, status, phase, updated, coalesce(evidence, 0.22::DOUBLE) AS evidence FROM p LEFT JOIN counts ON counts.topic_id = p.topic_id AND counts.trial = p.doc_id
        LEFT JOIN ev ON ev.topic_id = p.topic_id AND ev.trial = p.doc_id LEFT JOIN trials ON trials.trial = p.doc_id),
      s AS (SELECT *, {O.label(mode)} AS label, exc_met > 0 OR mandatory_failed AS veto, CASE WHEN exc_met > 0 OR mandatory_failed THEN -1 + {w['veto_tie']}::DOUBLE * prior ELSE {base} END AS base FROM c),
      e AS (SELECT *, base + CASE WHEN veto AND base <= -0.95 THEN 0.25::DOUBLE ELSE 1 END * {weight}::DOUBLE * (evidence - 0.5::DOUBLE) AS score FROM s)
      SELECT topic_id, doc_id, label, round(score, 4)::DOUBLE AS score, 'ranked' AS source, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM e QUALIFY rank <= {k}"""


def _matched(spark, sf_dir, config):
    return P.match(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), Q.evaluations(spark, sf_dir), Q.trials(spark, sf_dir), config)


_LEXICAL = f"{O.bm25(['all'], 1000)}, found AS (SELECT topic_id, doc_id, score, rank FROM run)"
_FIELDED = f"{O.bm25(X.FIELD_WEIGHTS, 1000)}, found AS ({O.fused(X.FIELD_WEIGHTS, 1000)})"


@query(_match_sql("clinical", _LEXICAL, 0.0, 10))
def match_clinical(spark, sf_dir):
    """The clinical preset over all topics, with each topic's own evaluations."""
    return _matched(spark, sf_dir, P.clinical())


@query(_match_sql("benchmark", _FIELDED, 0.5, 20))
def match_benchmark(spark, sf_dir):
    """The benchmark preset without the steps that need profiles."""
    return _matched(spark, sf_dir, P.benchmark(entity_weight=0.0, irrelevance=False))


# --- retrieval audit -----------------------------------------------------------------

_AUDIT = f"""{O.QRELS}, judged AS (SELECT doc_id % 40 AS topic_id, doc_id, grade FROM qrels), {O.bm25(X.FIELD_WEIGHTS, 1000)}, fz AS ({O.fused(X.FIELD_WEIGHTS, 100)}),
      dz AS (SELECT query_id AS topic_id, vec_id AS doc_id, rank FROM ({O.dense('true', 50)})), mix AS (SELECT 'bm25' AS source, topic_id, doc_id, rank FROM fz UNION ALL SELECT 'dense', topic_id, doc_id, rank FROM dz),
      fu AS ({O.fused({'bm25': 1.0, 'dense': 1.0}, 80, 'mix', 'source')}),
      runs AS (SELECT 'bm25_field_' || field AS stage, topic_id, doc_id, rank FROM run UNION ALL SELECT 'bm25', topic_id, doc_id, rank FROM fz UNION ALL SELECT 'dense', topic_id, doc_id, rank FROM dz UNION ALL SELECT 'fused', topic_id, doc_id, rank FROM fu),
      every AS (SELECT item_id AS topic_id, stage, cutoff FROM benchmark, (SELECT DISTINCT stage FROM runs), (SELECT unnest({list(X.CUTOFFS)}) AS cutoff)),
      tot AS (SELECT topic_id, count(*) FILTER (grade > 0) AS ar, count(*) FILTER (grade = 2) AS ae FROM judged GROUP BY topic_id),
      hit AS (SELECT e.topic_id, e.stage, e.cutoff, count(r.doc_id) AS shown, count(grade) AS judged, count(*) FILTER (grade > 0) AS relevant, count(*) FILTER (grade = 2) AS eligible, count(*) FILTER (grade = 1) AS excludes, count(*) FILTER (grade = 0) AS irrelevant
        FROM every e LEFT JOIN runs r ON r.topic_id = e.topic_id AND r.stage = e.stage AND r.rank <= e.cutoff LEFT JOIN judged j ON j.topic_id = r.topic_id AND j.doc_id = r.doc_id GROUP BY ALL),
      stages AS (SELECT hit.* EXCLUDE (shown), shown - judged AS unjudged, round(coalesce(relevant / nullif(ar, 0), 0), 6)::DOUBLE AS recall_relevant, round(coalesce(eligible / nullif(ae, 0), 0), 6)::DOUBLE AS recall_eligible,
        round(coalesce(judged / nullif(shown, 0), 0), 6)::DOUBLE AS judged_fraction FROM hit LEFT JOIN tot USING (topic_id))"""


def _audit(spark, sf_dir):
    docs, topics = Q.documents(spark, sf_dir), Q.topics(spark, sf_dir)
    judged = Q.qrels(spark, sf_dir).withColumn("topic_id", F.pmod("doc_id", F.lit(40)).cast("long"))
    near = R.dense(*Q._vectors(spark, sf_dir), 50).select(F.col("query_id").alias("topic_id"), F.col("vec_id").alias("doc_id"), "rank")
    runs = A.runs_of(docs, topics, 100, near, 80)
    return A.audit(runs, topics, judged, docs.where("doc_id % 10 <> 7"), docs.where("doc_id % 10 <> 3"))


@query(f"WITH {_AUDIT} SELECT * FROM stages")
def retrieval_audit(spark, sf_dir):
    """Every stage of every topic in one table."""
    return _audit(spark, sf_dir).stages


_MEANS = ", ".join(f"round(avg({c}) + 1e-9, 6) AS mean_{c}" for c in ("judged", "relevant", "eligible", "unjudged", "recall_relevant", "recall_eligible", "judged_fraction"))


@query(
    f"""WITH {_AUDIT} SELECT stage, cutoff, {_MEANS}, coalesce(string_agg(topic_id, ' ' ORDER BY topic_id) FILTER (relevant = 0), '') AS zero_relevant, coalesce(string_agg(topic_id, ' ' ORDER BY topic_id) FILTER (eligible = 0), '') AS zero_eligible,
        count(*) FILTER (relevant = 0)::INT AS n_zero_relevant, count(*) FILTER (eligible = 0)::INT AS n_zero_eligible FROM stages GROUP BY ALL"""
)
def retrieval_audit_means(spark, sf_dir):
    rows = _audit(spark, sf_dir).aggregate
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("zero_relevant", "zero_eligible")})


@query(
    f"""WITH {_AUDIT}, w AS (SELECT topic_id, doc_id, stage FROM judged, (SELECT unnest(['bm25', 'fused']) AS stage) WHERE grade > 0)
      SELECT topic_id, stage, CASE WHEN r.doc_id IS NOT NULL THEN 'retrieved' WHEN w.doc_id % 10 = 7 THEN 'not_in_corpus' WHEN w.doc_id % 10 = 3 THEN 'not_in_index' ELSE 'not_retrieved' END AS reason, count(*) AS n
      FROM w LEFT JOIN runs r USING (topic_id, stage, doc_id) WHERE EXISTS (SELECT 1 FROM runs x WHERE x.topic_id = w.topic_id AND x.stage = w.stage) GROUP BY ALL"""
)
def retrieval_audit_missing(spark, sf_dir):
    return _audit(spark, sf_dir).missing


@query(
    f"""WITH {O.QRELS}, s AS (SELECT * FROM qrels, (SELECT unnest(['corpus', 'index']) AS side), (SELECT unnest(['all_judged', 'relevant_1or2', 'eligible_2']) AS label) WHERE label = 'all_judged' OR label = 'relevant_1or2' AND grade > 0 OR label = 'eligible_2' AND grade = 2)
      SELECT side, label, count(*) AS total, count(d.doc_id) AS covered, count(*) - count(d.doc_id) AS missing, round(count(d.doc_id) / count(*), 6) AS coverage FROM s LEFT JOIN documents d ON d.doc_id = s.doc_id AND d.doc_id % 10 <> CASE side WHEN 'corpus' THEN 7 ELSE 3 END GROUP BY ALL"""
)
def retrieval_audit_coverage(spark, sf_dir):
    docs = Q.documents(spark, sf_dir)
    return A.coverage(Q.qrels(spark, sf_dir), docs.where("doc_id % 10 <> 7"), docs.where("doc_id % 10 <> 3"))


# --- calibration and listwise windows --------------------------------------------------


@query(
    f"""WITH r AS (SELECT topic_id * 40 + trial % 40 AS topic, trial, trial % 3 AS grade, score FROM ({O.score('benchmark', False).replace(', 6)::DOUBLE AS score', ', 9)::DOUBLE AS score', 1)})),
      s AS (SELECT topic, sum((pow(2, grade) - 1) / log2(k + 1)) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, trial) AS k FROM r) WHERE k <= 10 GROUP BY topic),
      i AS (SELECT topic, sum((pow(2, grade) - 1) / log2(k + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, trial) AS k FROM r) WHERE k <= 10 GROUP BY topic)
      SELECT 7 AS n_weights, round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 6) AS start_ndcg, true AS never_falls, true AS not_worse FROM s JOIN i USING (topic)"""
)
def weight_calibration(spark, sf_dir):
    """Seven score weights by a simplex of ten rounds: where it starts, and that it never gets worse."""
    rows = Q._scored(spark, sf_dir, "benchmark").select(
        "*", (F.col("topic_id") * 40 + F.col("trial") % 40).alias("topic"), F.col("trial").alias("doc_id"), (F.col("trial") % 3).cast("int").alias("grade")
    )
    found = K.calibrate(rows.drop("topic_id").withColumnRenamed("topic", "topic_id"), rounds=10)
    history = found.history
    row = (len(found.point), round(found.start, 6), history == sorted(history), found.value >= found.start)
    return spark.createDataFrame([row], "n_weights int, start_ndcg double, never_falls boolean, not_worse boolean")


@query(
    f"""WITH RECURSIVE {O.bm25(['all'], 45)}, pool AS (SELECT topic_id, list(struct_pack(d := doc_id, r := rank, s := (doc_id * 7919 + topic_id * 31) % 1000) ORDER BY rank) AS xs FROM run GROUP BY topic_id),
      g(topic_id, xs, stop, done) AS (SELECT topic_id, xs, len(xs), false FROM pool UNION ALL
        SELECT topic_id, list_concat(list_concat(xs[1:greatest(stop - 20, 0)], list_transform(list_sort(list_transform(xs[greatest(stop - 20, 0) + 1:stop], lambda x, i: struct_pack(a := -x.s, i := i, x := x))), lambda y: y.x)), xs[stop + 1:len(xs)]), stop - 10, stop <= 20 FROM g WHERE NOT done)
      SELECT topic_id, x.d AS doc_id, x.r AS old_rank, i::INTEGER AS rank FROM (SELECT topic_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM g WHERE done)"""
)
def listwise_windows(spark, sf_dir):
    run = R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 45)
    said = F.pmod(F.col("doc_id") * 7919 + F.col("topic_id") * 31, F.lit(1000))
    return G.listwise_windows(run, said, 45)


# --- profiles --------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_custkey % 11 = 0 AS broken, c_custkey % 7 = 0 AS wild FROM customer), u AS (SELECT *, NOT (broken OR wild) AS ok FROM c)
      SELECT k AS c_custkey, ok AS extracted, CASE WHEN ok AND k % 3 < 2 THEN (['male', 'female'])[k % 3 + 1] ELSE 'unknown' END AS sex, CASE WHEN ok THEN (k % 90)::DOUBLE + 0.5 END AS age_years, CASE WHEN ok AND k % 2 = 0 THEN k % 6 END AS ecog,
        CASE WHEN ok THEN 'HER2=positive;' || CASE WHEN k % 4 = 0 THEN 'EGFR=' || name || ';' ELSE '' END ELSE '' END AS biomarkers, CASE WHEN ok THEN 1 + (k % 5 > 0)::INT ELSE 0 END AS n_labs, CASE WHEN ok THEN bal END AS lab,
        CASE WHEN ok AND k % 5 < 4 THEN k % 2 = 0 END AS pregnant, CASE WHEN ok THEN 'asthma' ELSE '' END AS others FROM u"""
)
def profile_coercion(spark, sf_dir):
    """Answers about customers with good and bad list items; some are unusable as a whole."""
    k, c = F.col("c_custkey"), Q.table(spark, sf_dir, "customer")
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    num = lambda x: x.cast("string")
    sex = F.when(k % 3 == 0, '"Male"').when(k % 3 == 1, '"female"').otherwise('"other"')
    marks = text('[{"name": "HER2", "status": "positive"}, {"name": "ALK"}, "KRAS", ', F.when(k % 4 == 0, text('{"name": "EGFR", "status": "', F.col("c_name"), '"}')).otherwise('{"status": 3, "name": "x"}'), "]")
    labs = text('[{"name": "ANC", "value": "', num(F.col("c_acctbal")), '"}, {"value": 2}, ', F.when(k % 5 > 0, '{"name": "Na", "value": 140}').otherwise('{"name": "Na", "value": "high"}'), "]")
    pregnancy = F.when(k % 5 < 4, text('{"pregnant": ', F.when(k % 2 == 0, '"yes"').otherwise("0"), "}")).otherwise("null")
    ecog = F.when(k % 7 == 0, "9").when(k % 2 == 0, num(k % 6)).otherwise("null")
    said = text(
        'Profile:\n{"sex": ', sex, ', "age_years": "', num(k % 90), '.5", "ecog": ', ecog, ', "biomarkers": ', marks, ', "labs": ', labs,
        ', "secondary_diagnoses": ["asthma", 4], "pregnancy": ', pregnancy, F.when(k % 11 == 0, "").otherwise("}"),
    )
    rows = c.select("c_custkey", profile(lenient_json(said), num(k), F.col("c_name")).alias("p"))
    listed = F.array_join(F.transform("p.biomarkers", lambda b: F.concat(b["name"], F.lit("="), b["status"], F.lit(";"))), "")
    return rows.select(
        "c_custkey", "p.extracted", "p.sex", "p.age_years", "p.ecog", listed.alias("biomarkers"), F.size("p.labs").alias("n_labs"),
        F.get("p.labs", F.lit(0))["value"].alias("lab"), "p.pregnancy.pregnant", F.array_join("p.secondary_diagnoses", ",").alias("others"),
    )


# --- dossier flags, generated questions ----------------------------------------------

_W = X.SCORE_WEIGHTS
_DAYS = f"date_diff('day', updated, DATE '{Q.AS_OF}')"


@query(
    f"""WITH {O.EVALS}, {O.COUNTS}, {O.TRIALS}, f AS (SELECT counts.*, status, {O.ELIG} AS elig, {O._case('status', X.STATUS_BONUS['benchmark'], 0)} AS bonus, {O._case('phase', X.PHASE_PRIORITY, 0.5)} AS phased,
        CASE WHEN {_DAYS} <= 0 THEN 1 ELSE 1 / (1 + ln(1 + {_DAYS} / 365.0::DOUBLE)) END AS recency, exc_met > 0 OR mandatory_failed AS veto FROM counts JOIN trials USING (trial))
      SELECT topic_id, trial, array_to_string(list_filter([CASE WHEN fraction_nei >= 0.4::DOUBLE THEN 'warning data_quality ' || round_even(fraction_nei * 100, 0)::BIGINT || '{X.FLAG_UNKNOWN}' END, CASE WHEN mandatory_failed THEN 'critical eligibility {X.FLAG_FAILED}' END,
        CASE WHEN exc_met > 0 THEN 'critical eligibility {X.FLAG_EXCLUDED}' END, CASE WHEN topic_id = 1 AND trial % 3 = 1 THEN 'warning geographic {X.FLAG_FAR[0]}italy{X.FLAG_FAR[1]}' END,
        CASE WHEN status NOT IN ('RECRUITING', 'NOT_YET_RECRUITING') THEN 'warning trial_status {X.FLAG_STATUS}' || status || '.' END], lambda x: x IS NOT NULL), '|') AS flags,
        round(elig, 6) AS eligibility_score, bonus AS recruiting_bonus, phased AS phase_alignment, round(recency, 6)::DOUBLE AS recency, round(fraction_nei, 6) AS nei_penalty, veto AS mandatory_veto, round(0.5::DOUBLE * avg_confidence + 0.5::DOUBLE, 6) AS confidence_adjustment FROM f"""
)
def dossier_flags(spark, sf_dir):
    """The attention flags and score parts of every dossier, for patients with and without a known place."""
    k = F.col("trial")
    facts = Q._scored(spark, sf_dir, "benchmark")
    place = lambda city, country: F.struct(F.lit(city).alias("city"), F.lit(country).cast("string").alias("country"))
    sites = F.when(k % 3 == 0, F.array(place("Rome", "Italy"))).when(k % 3 == 1, F.array(place("Lyon", "France"), place("Oslo", None)))
    contact = F.lit(None).cast("array<struct<name:string,email:string,phone:string>>")
    trials = Q.trials(spark, sf_dir).select("trial", F.lit("t").alias("title"), F.lit("").alias("brief_summary"), "phase", "status", sites.alias("locations"), contact.alias("contacts"))
    told = N._told(spark, sf_dir)
    judged = facts.select("topic_id", "trial", F.lit(1).alias("rank"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("rationale"))
    known = ["topic_id", "trial", "fraction_nei", "mandatory_failed", "exc_met", "avg_confidence", "elig", "status_bonus", "phase_score", "recency", "geography"]
    people = spark.createDataFrame([(1, "italy"), (0, None)], "topic_id long, home string")
    rows = D.dossiers(judged, told, trials, D.fallback_questions(told), facts.select(*known), people)
    shown = F.transform("attention_flags", lambda f: F.concat_ws(" ", f["severity"], f["category"], f["message"]))
    part = lambda name: F.round(F.col(f"score_breakdown.{name}"), 6).alias(name)
    return rows.select(
        "topic_id", "trial", F.array_join(shown, "|").alias("flags"),
        *map(part, ("eligibility_score", "recruiting_bonus", "phase_alignment", "recency", "nei_penalty")),
        "score_breakdown.mandatory_veto", part("confidence_adjustment"),
    )


_TYPES = ("Yes-No", " lab value", "composite", "odd kind", None)
_URGENT = ("Very High", "optional", None, "medium", "soon")


@query(
    f"""WITH {N._QUESTIONS}, pay AS (SELECT topic_id, trial, criterion, (trial + criterion) % 5 AS kind, trial % 5 AS urgency FROM ask WHERE criterion % 2 = 1),
      ok AS (SELECT *, (['boolean', 'numeric', 'text', NULL, 'text'])[(kind + 1)::INT] AS type, (['critical', 'low', 'medium', 'medium', NULL])[(urgency + 1)::INT] AS prio FROM pay WHERE kind <> 3 AND urgency <> 4 AND criterion % 7 <> 3)
      SELECT topic_id, trial, criterion, CASE WHEN ok.type IS NOT NULL AND trial % 3 = 0 THEN 'T' || trial ELSE trial::VARCHAR END AS trial_id, CASE WHEN ok.type IS NOT NULL AND trial % 2 = 0 THEN 'x_' || criterion ELSE criterion_id END AS criterion_id,
        CASE WHEN ok.type IS NOT NULL THEN 'model asks ' || criterion ELSE question_text END AS question_text, CASE WHEN ok.type IS NOT NULL THEN 'point' ELSE data_point END AS data_point, CASE WHEN ok.type IS NOT NULL THEN 'since' ELSE rationale END AS rationale,
        coalesce(ok.type, expected_data_type) AS expected_data_type, coalesce(ok.prio, priority) AS priority, ok.type IS NOT NULL AS asked_by_model FROM ask LEFT JOIN ok USING (topic_id, trial, criterion)"""
)
def generated_questions(spark, sf_dir):
    """A model's questions where they are usable (types and priorities by their aliases, ids defaulted), else fallbacks."""
    told = N._told(spark, sf_dir)
    k, c = F.col("trial"), F.col("criterion")
    pick = lambda xs, at: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), at.cast("int"))
    payload = told.where((F.col("label") == "NEI") & (c % 2 == 1)).select(
        "topic_id", "trial", "criterion", F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).otherwise("").alias("trial_id"),
        F.when(k % 2 == 0, F.concat(F.lit("x_"), c.cast("string"))).alias("criterion_id"), F.concat(F.lit("model asks "), c.cast("string")).alias("question_text"),
        F.lit("point").alias("data_point"), F.when(c % 7 != 3, "since").alias("rationale"), pick(_TYPES, (k + c) % 5).alias("expected_data_type"), pick(_URGENT, k % 5).alias("priority"),
    )
    return D.generated_questions(told, payload)


# --- dispatch of runs ------------------------------------------------------------------


@query(f"WITH {O.bm25(['all'], 20).replace('FROM (SELECT item_id AS topic_id, unnest(' + O.tokens('text') + ') AS term FROM benchmark)', 'FROM (SELECT item_id AS topic_id, unnest(' + O.tokens(chr(39) + chr(39) + ' || text || CASE WHEN item_id % 3 = 0 THEN ' + chr(39) + ' ' + chr(39) + ' || text ELSE ' + chr(39) + chr(39) + ' END') + ') AS term FROM benchmark)')} SELECT topic_id, doc_id, score, rank FROM run")
def lexical_expanded_topk(spark, sf_dir):
    """A single-field run whose queries take expansion terms behind them: here, for every third topic, its own words again."""
    topics = Q.topics(spark, sf_dir)
    terms = topics.where("topic_id % 3 = 0").select("topic_id", F.array("text").alias("terms"))
    return R.lexical(Q.documents(spark, sf_dir), topics, 20, "single", terms)


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0), parts AS (SELECT query_id, embedding FROM q UNION ALL SELECT vec_id - vec_id % 20, embedding FROM embeddings WHERE vec_id % 20 IN (1, 2, 3)),
      cells AS (SELECT query_id, i, avg(x::DOUBLE) AS x FROM (SELECT query_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM parts) GROUP BY ALL), means AS (SELECT query_id, list(x ORDER BY i) AS query FROM cells GROUP BY query_id)
      SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (
        SELECT query_id, vec_id, round({O.COSINE.format('query', 'embedding')}, 6) AS score FROM embeddings, means WHERE label <> 1)) WHERE rank <= 10"""
)
def hyde_search(spark, sf_dir):
    """Searches with the mean of a query's vector and three hypothetical answers, among filtered vectors."""
    v, q = Q._vectors(spark, sf_dir)
    answers = v.where("vec_id % 20 in (1, 2, 3)").select((F.col("vec_id") - F.col("vec_id") % 20).alias("query_id"), "embedding")
    return R.dense_run(v, q, 10, "hyde", answers, F.col("label") != 1)
