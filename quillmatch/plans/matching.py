"""Registered queries of profiles, plans, criteria, ranking steps, dossiers and audits, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmatch.functions import criteria as C
from quillmatch.functions import fixed as X
from quillmatch.functions import text as T
from quillmatch.functions import views as V
from quillmatch.operators import audit as A
from quillmatch.operators import concepts as N
from quillmatch.operators import criteria_table as K
from quillmatch.operators import dossier as D
from quillmatch.operators import eligibility as E
from quillmatch.operators import lexical as L
from quillmatch.operators import planning as P
from quillmatch.operators import ranking as G
from quillmatch.operators import retrieval as R
from quillmatch.operators import selection as S
from quillmatch.operators.evaluation import averages, class_scores
from quillmatch.operators.lineage import cut, shared_folder
from quillmatch.plans import oracle as O
from quillmatch.plans import queries as Q
from quillmatch.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _pick(values, at):
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _sql_pick(values, at: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({at}) + 1]"


def _md5(column):
    return F.md5(column.cast("binary"))


def _kept(parts: list[str], by: str) -> str:
    """SQL of the parts that are neither null nor empty, joined."""
    return f"array_to_string(list_filter([{', '.join(f'coalesce({p}, {chr(39) * 2})' for p in parts)}], lambda x: x <> ''), {by})"


# --- saved index -----------------------------------------------------------------


@query(O.ORACLES["bm25_topk"])
def bm25_saved_topk(spark, sf_dir):
    """The index is written to the shared folder and searched there."""
    path = f"{shared_folder(spark)}/index/{uuid.uuid4().hex}"
    sinks.write_index(Q.documents(spark, sf_dir), path, ["all"])
    queries = Q.topics(spark, sf_dir).select("topic_id", F.lit("all").alias("field"), "text")
    return L.search(spark, path, queries, 20).select("topic_id", "doc_id", "score", "rank")


# --- text views ------------------------------------------------------------------

TEXTS = """texts AS (SELECT doc_id, l[1] AS title, CASE WHEN doc_id % 3 > 0 THEN l[2] END AS official, coalesce(l[3], '') AS summary, CASE WHEN doc_id % 2 = 0 THEN l[4] END AS detail,
        split(l[1], ' ')[1:3] AS conditions, [source, lang] AS keywords, CASE WHEN len(l) > 4 THEN [l[5]] ELSE []::VARCHAR[] END AS interventions, l[-1] AS inclusion, coalesce(l[6], '') AS exclusion,
        coalesce(text, '') AS raw, CASE doc_id % 3 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' ELSE 'ALL' END AS sex, CASE WHEN doc_id % 2 = 0 THEN 'PHASE2' END AS phase, CASE WHEN doc_id % 5 > 0 THEN 'RECRUITING' END AS status
        FROM (SELECT *, split(coalesce(text, ''), chr(10)) AS l FROM documents))"""


def texts(spark, sf_dir):
    """Documents as trials: their lines stand for titles, summaries and criteria."""
    d = Q.table(spark, sf_dir, "documents")
    lines, k = F.split(F.coalesce("text", F.lit("")), "\n"), F.col("doc_id")
    d = d.withColumn("l", lines)
    line = lambda i: F.get("l", F.lit(i))
    return d.select(
        "doc_id",
        line(0).alias("title"),
        F.when(k % 3 > 0, line(1)).alias("official_title"),
        F.coalesce(line(2), F.lit("")).alias("brief_summary"),
        F.when(k % 2 == 0, line(3)).alias("detailed_description"),
        F.slice(F.split(line(0), " "), 1, 3).alias("conditions"),
        F.array("source", "lang").alias("keywords"),
        F.when(F.size("l") > 4, F.array(line(4))).otherwise(F.array().cast("array<string>")).alias("interventions"),
        F.element_at("l", -1).alias("inclusion_text"),
        F.coalesce(line(5), F.lit("")).alias("exclusion_text"),
        F.coalesce("text", F.lit("")).alias("raw_text"),
        F.when(k % 3 == 0, "MALE").when(k % 3 == 1, "FEMALE").otherwise("ALL").alias("sex"),
        F.when(k % 2 == 0, "PHASE2").alias("phase"),
        F.when(k % 5 > 0, "RECRUITING").alias("status"),
    )


_SQL_PARTS = {
    "title": "title", "official": "official", "summary": "summary", "detail": "detail", "conditions": "array_to_string(conditions, ' ')",
    "keywords": "array_to_string(keywords, ' ')", "interventions": "array_to_string(interventions, ' ')", "inclusion": "inclusion",
    "exclusion": "exclusion", "eligibility": "raw",
}


def _sql_view(names: str) -> str:
    return _kept([_SQL_PARTS[n] for n in names.split()], "chr(10)")


_SELECTION = _kept(["title", "summary", *[_SQL_PARTS[n] for n in "title official conditions keywords interventions".split()], "phase", "status", "substr(raw, 1, 4000)"], "chr(10)")


@query(
    f"WITH {TEXTS} SELECT doc_id, "
    + ", ".join(f"md5({'substr(' + _sql_view(v) + ', 1, 4000)' if n == 'dense' else _sql_view(v)}) AS {n}_view" for n, v in V.VIEWS.items())
    + f", md5({_SELECTION}) AS selection_view FROM texts"
)
def text_views(spark, sf_dir):
    views = [_md5(V.trial_view(n)).alias(f"{n}_view") for n in V.VIEWS]
    chosen = V.selection_view(F.col("title"), F.col("brief_summary"))
    return texts(spark, sf_dir).select("doc_id", *views, _md5(chosen).alias("selection_view"))


_IRRELEVANT = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '{X.SELECTION_TOKEN}'), lambda x: x NOT IN {O._in(X.IRRELEVANCE_STOPWORDS + X.IRRELEVANCE_GENERIC)}))"


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id, {_IRRELEVANT('text')} AS t FROM documents)")
def tok_irrelevance(spark, sf_dir):
    rows = Q.documents(spark, sf_dir).select("doc_id", T.irrelevance_terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), _md5(F.array_join(F.array_sort("t"), " ")).alias("terms"))


# --- scalars ---------------------------------------------------------------------

_ODD = ("  male ", "Female", "BOTH", "Yes", "false", "0", "n/a", " 12 of  30 ", "")


@query(
    f"""SELECT p_partkey, CASE WHEN upper(trim(t)) IN ('MALE', 'FEMALE') THEN upper(trim(t)) ELSE 'ALL' END AS sex, CASE WHEN lower(trim(t)) IN ('yes', 'true', '1') THEN true WHEN lower(trim(t)) IN ('no', 'false', '0') THEN false END AS yes,
        try_cast(regexp_extract(t, '(\\d+)', 1) AS BIGINT) AS first_integer, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS collapsed FROM (SELECT p_partkey, {_sql_pick(_ODD, 'p_partkey % 9')} AS t FROM part)"""
)
def scalar_norms(spark, sf_dir):
    t = _pick(_ODD, F.col("p_partkey") % 9)
    return Q.table(spark, sf_dir, "part").select(
        "p_partkey", T.sex(t).alias("sex"), T.yes_no(t).alias("yes"), T.first_integer(t).alias("first_integer"), T.collapse(t).alias("collapsed")
    )


_NAMES = ("USA", "U.K.", " Holland ", "Türkiye", "New Spain", "Korea, Republic of", "españa")


@query(
    f"""WITH names AS (SELECT n_nationkey AS id, '' || n_name AS name FROM nation UNION ALL SELECT 100 + i, {_sql_pick(_NAMES, 'i')} FROM range({len(_NAMES)}) r(i))
        SELECT id::BIGINT AS id, known.country FROM names LEFT JOIN {O.ALIASES} ON alias = lower(trim(name))"""
)
def country_canonical(spark, sf_dir):
    odd = spark.range(len(_NAMES)).select((F.col("id") + 100).alias("id"), _pick(_NAMES, F.col("id")).alias("name"))
    rows = Q.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionAll(odd)
    return rows.select("id", T.country(F.col("name")).alias("country"))


@query(
    """SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS i, round(unnest(embedding)::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9), 6) AS value FROM embeddings"""
)
def l2_normalised(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(T.l2_normalised(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 6).alias("value"))


@query(
    f"""WITH {O.TRIALS} SELECT trial FROM trials WHERE trial % 3 > 0 AND trim(CASE WHEN trial % 4 = 0 THEN ' ' ELSE 'x' END) <> '' AND (CASE WHEN trial % 5 > 0 THEN updated END IS NULL OR updated >= DATE '1997-01-01')"""
)
def corpus_filter_full(spark, sf_dir):
    rows = Q.trials(spark, sf_dir).select(
        "trial",
        (F.col("trial") % 3 > 0).alias("interventional"),
        F.when(F.col("trial") % 4 == 0, " \n ").otherwise("x").alias("raw_text"),
        F.when(F.col("trial") % 5 > 0, F.col("updated")).alias("updated"),
    )
    return S.corpus_filter(rows, updated_since="1997-01-01").select("trial")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3")
def payload_filter(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "customer")
    return S.payload_filter(rows, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3}).select("c_custkey")


# --- profiles, concepts and plans ---------------------------------------------------

_DIAGNOSES = ("melanoma", "breast cancer", None, "asthma", "")
_SEXES = ("unknown", "female", "male")


def profiles(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col
    text, none = lambda x: F.lit(x).cast("string"), lambda t: F.array().cast(f"array<{t}>")
    mark = lambda name, status, value, method: F.struct(name.alias("name"), F.lit(status).alias("status"), value.alias("value"), method.alias("method"))
    marks = F.array(
        mark(F.lit("HER2"), "positive", F.when(k % 4 == 1, "3+"), F.when(k % 3 == 0, "IHC")), mark(c("p_brand"), "negative", text(None), text(None))
    )
    given = F.struct(
        c("p_type").alias("name"), F.when(k % 4 == 0, "chemo").alias("category"), F.when(k % 5 == 0, "PR").alias("response"), F.when(k % 7 > 3, k % 3).alias("line")
    )
    lab = lambda name, value, units: F.struct(F.lit(name).alias("name"), value.alias("value"), units.alias("units"))
    labs = F.array(lab(" Creatinine", F.when(k % 6 > 0, c("p_size") / 10.0), F.when(k % 4 > 0, "mg/dL")), lab("creatinine", F.lit(99.5), text(None)))
    return Q.table(spark, sf_dir, "part").select(
        k.alias("topic_id"),
        F.when(k % 9 > 0, c("p_size").cast("double")).alias("age_years"),
        _pick(_SEXES, k % 3).alias("sex"),
        F.get(F.array(*map(text, _DIAGNOSES)), (k % 5).cast("int")).alias("primary_diagnosis"),
        F.when(k % 3 == 0, "stage IV").alias("primary_diagnosis_stage"),
        F.when(k % 2 == 0, F.array("p_name", "p_type")).otherwise(none("string")).alias("secondary_diagnoses"),
        F.when(k % 2 == 1, marks).otherwise(none("struct<name:string,status:string,value:string,method:string>")).alias("biomarkers"),
        F.when(k % 3 > 0, F.array(given)).otherwise(none("struct<name:string,category:string,response:string,line:bigint>")).alias("prior_treatments"),
        F.when(k % 4 > 0, F.array(F.struct(c("p_name").alias("name"), (k % 2 == 0).alias("active")))).otherwise(none("struct<name:string,active:boolean>")).alias("comorbidities"),
        F.when(k % 3 != 1, labs).otherwise(none("struct<name:string,value:double,units:string>")).alias("labs"),
        F.when((k % 6 < 5) & (k % 9 > 0), k % 6).alias("ecog"),
        F.when(k % 4 == 1, c("p_size") * 2).alias("karnofsky"),
        F.concat("p_name", F.lit(" note. No evidence of "), "p_type").alias("raw_text"),
    )


PROFILES = f"""profiles AS (SELECT p_partkey AS topic_id, CASE WHEN p_partkey % 9 > 0 THEN p_size::DOUBLE END AS age, {_sql_pick(_SEXES, 'p_partkey % 3')} AS sex, {_sql_pick(_DIAGNOSES, 'p_partkey % 5')} AS dx,
        CASE WHEN p_partkey % 3 = 0 THEN 'stage IV' END AS stage, CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_type] ELSE [] END AS secondary,
        CASE WHEN p_partkey % 2 = 1 THEN [{{'name': 'HER2', 'status': 'positive', 'value': CASE WHEN p_partkey % 4 = 1 THEN '3+' END, 'method': CASE WHEN p_partkey % 3 = 0 THEN 'IHC' END}}, {{'name': p_brand, 'status': 'negative', 'value': NULL, 'method': NULL}}] ELSE [] END AS marks,
        CASE WHEN p_partkey % 3 > 0 THEN [{{'name': p_type, 'line': CASE WHEN p_partkey % 7 > 3 THEN p_partkey % 3 END}}] ELSE [] END AS given,
        CASE WHEN p_partkey % 4 > 0 THEN [p_name] ELSE [] END AS ills,
        CASE WHEN p_partkey % 3 <> 1 THEN [{{'name': ' Creatinine', 'value': CASE WHEN p_partkey % 6 > 0 THEN p_size::DOUBLE / 10 END, 'units': CASE WHEN p_partkey % 4 > 0 THEN 'mg/dL' END}}, {{'name': 'creatinine', 'value': 99.5::DOUBLE, 'units': NULL}}] ELSE [] END AS labs,
        CASE WHEN p_partkey % 6 < 5 AND p_partkey % 9 > 0 THEN p_partkey % 6 END AS ecog, CASE WHEN p_partkey % 4 = 1 THEN p_size * 2 END AS karnofsky, p_name || ' note. No evidence of ' || p_type AS raw FROM part)"""
_MARKED = "array_to_string(list_transform(marks[1:3], lambda b: b.name || ' ' || b.status), ', ')"
_SUMMARY = _kept(["age::BIGINT || '-year-old'", "CASE WHEN sex <> 'unknown' THEN sex END", "CASE WHEN dx <> '' THEN 'with ' || dx END", "CASE WHEN dx <> '' THEN '(' || stage || ')' END", "'ECOG ' || ecog", f"CASE WHEN len(marks) > 0 THEN 'biomarkers: ' || {_MARKED} END"], "' '")
_SUMMARY = f"coalesce(nullif({_SUMMARY}, ''), substr(raw, 1, 200))"
_EXCERPT = f"""substr(array_to_string(['Summary: ' || {_SUMMARY},
        CASE WHEN len(marks) > 0 THEN 'Biomarkers: ' || array_to_string(list_transform(marks, lambda b: b.name || '=' || b.status || CASE WHEN b.method IS NOT NULL THEN ' (' || b.method || ')' ELSE '' END), ', ') END,
        CASE WHEN len(given) > 0 THEN 'Prior treatments: ' || array_to_string(list_transform(given, lambda g: g.name || CASE WHEN g.line > 0 THEN ' line ' || g.line ELSE '' END), ', ') END,
        CASE WHEN len(ills) > 0 THEN 'Comorbidities: ' || array_to_string(ills, ', ') END,
        CASE WHEN len(labs) > 0 THEN 'Labs: ' || array_to_string(list_transform(list_filter(labs, lambda x: x.value IS NOT NULL), lambda x: trim(x.name || '=' || x.value || ' ' || coalesce(x.units, ''))), '; ') END,
        'Patient note (verbatim): ' || raw], chr(10)), 1, 2200)"""


@query(f"WITH {PROFILES} SELECT topic_id, {_SUMMARY} AS summary, {_EXCERPT} AS excerpt FROM profiles")
def profile_texts(spark, sf_dir):
    return profiles(spark, sf_dir).select("topic_id", V.profile_summary().alias("summary"), V.profile_excerpt().alias("excerpt"))


def _sql_terms(*lists: str) -> str:
    flat = lists[0]
    for x in lists[1:]:
        flat = f"list_concat({flat}, {x})"
    return f"coalesce(nullif(array_to_string(list_filter(list_transform({flat}, lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), ' '), ''), query)"


_OWN = "list_concat(list_concat(list_concat([dx, stage], secondary[1:5]), list_concat(list_transform(marks[1:8], lambda b: b.name || ' ' || b.status || ' ' || coalesce(b.value, '')), list_transform(given[1:8], lambda g: g.name))), list_concat(ills[1:6], ['ECOG ' || ecog, 'Karnofsky ' || karnofsky]))"
_BROAD = _sql_terms("[query]", "concepts", "priorities", _OWN)


@query(
    f"""WITH {PROFILES}, p AS (SELECT *, coalesce(nullif(dx, ''), substr(raw, 1, 120)) AS query, CASE WHEN topic_id % 2 = 0 THEN ['skin cancer'] ELSE []::VARCHAR[] END AS concepts, CASE WHEN topic_id % 3 = 0 THEN ['HER2 blockade'] ELSE []::VARCHAR[] END AS priorities, ['anemia', ' '] AS risks FROM profiles)
      SELECT topic_id, {_BROAD} AS all_query, {_sql_terms('[query]', 'concepts')} AS condition_title_query, {_sql_terms('[query]', _OWN, 'risks', 'priorities')} AS eligibility_query,
        {_sql_terms('[query]', 'priorities', 'list_transform(given[1:8], lambda g: g.name)', 'list_transform(marks[1:8], lambda b: b.name)')} AS intervention_query, {_BROAD} AS summary_description_query FROM p"""
)
def fielded_queries(spark, sf_dir):
    rows, none = profiles(spark, sf_dir), F.array().cast("array<string>")
    diagnosis = F.col("primary_diagnosis")
    asked = F.when(F.coalesce(diagnosis, F.lit("")) != "", diagnosis).otherwise(F.substring("raw_text", 1, 120))
    concepts = F.when(F.col("topic_id") % 2 == 0, F.array(F.lit("skin cancer"))).otherwise(none)
    priorities = F.when(F.col("topic_id") % 3 == 0, F.array(F.lit("HER2 blockade"))).otherwise(none)
    found = V.fielded_queries(asked, concepts, priorities, F.array(F.lit("anemia"), F.lit(" ")))
    return rows.select("topic_id", *[v.alias(f"{k}_query") for k, v in found.items()])


_BOOK = "book AS (SELECT lower(n_name) AS alias, 'N' || n_nationkey AS concept_id, n_name AS name, [n_name, lower(n_name), r_name, 'land ' || n_nationkey, 'LAND ' || n_nationkey, 'a', 'b', 'c', 'd', 'e', 'f'] AS synonyms FROM nation JOIN region ON n_regionkey = r_regionkey)"
_TERM = "(CASE c_custkey % 4 WHEN 0 THEN 'Metastatic (' || n_name || ')' WHEN 1 THEN n_name WHEN 2 THEN 'weird ' || lower(n_name) || ' xx' ELSE 'nothing here' END)"
_KEYS = f"""terms AS (SELECT c_custkey AS key, pos, trim(regexp_replace(lower(regexp_replace(term, '[()]', ' ', 'g')), '\\s+', ' ', 'g')) AS whole FROM (SELECT c_custkey, 0 AS pos, {_TERM} AS term FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT c_custkey, 1, n_name FROM customer JOIN nation ON n_nationkey = (c_nationkey + 1) % 25)),
      words AS (SELECT key, pos, list(w ORDER BY length(w) DESC, i)[1:3] AS longest FROM (SELECT key, pos, unnest(split(whole, ' ')) AS w, generate_subscripts(split(whole, ' '), 1) AS i FROM terms) GROUP BY ALL),
      tried AS (SELECT key, pos, unnest(x) AS alias, generate_subscripts(x, 1) AS t FROM (SELECT key, pos, list_filter(list_concat([whole, {', '.join(f"CASE WHEN starts_with(whole, '{q}') THEN substr(whole, {len(q) + 1}) END" for q in X.QUALIFIERS)}], longest), lambda v: v IS NOT NULL) AS x FROM terms JOIN words USING (key, pos))),
      found AS (SELECT DISTINCT key, pos, concept_id, name, synonyms FROM tried JOIN book USING (alias) QUALIFY t = min(t) OVER (PARTITION BY key, pos))"""


def _concepts(spark, sf_dir):
    n = Q.table(spark, sf_dir, "nation").join(Q.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    land = F.col("n_nationkey").cast("string")
    names = ["n_name", F.lower("n_name"), "r_name", F.concat(F.lit("land "), land), F.concat(F.lit("LAND "), land), *map(F.lit, "abcdef")]
    book = n.select(F.lower("n_name").alias("alias"), F.concat(F.lit("N"), land).alias("concept_id"), F.col("n_name").alias("name"), F.array(*names).alias("synonyms"))
    c = Q.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    here, next_ = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")), c.join(n, F.col("n_nationkey") == (F.col("c_nationkey") + 1) % 25)
    k = F.col("key") % 4
    term = F.when(k == 0, F.concat(F.lit("Metastatic ("), "n_name", F.lit(")"))).when(k == 1, F.col("n_name")).when(k == 2, F.concat(F.lit("weird "), F.lower("n_name"), F.lit(" xx"))).otherwise("nothing here")
    return here.select("key", F.lit(0).alias("pos"), term.alias("term")).unionAll(next_.select("key", F.lit(1), "n_name")), book


@query(f"""WITH {_BOOK}, {_KEYS} SELECT key, count(*) AS n, string_agg(name || ' (' || concept_id || ')', ', ' ORDER BY pos, concept_id) AS summary FROM found GROUP BY key""")
def concept_annotation(spark, sf_dir):
    rows = N.annotated(*_concepts(spark, sf_dir))
    return rows.select("key", F.size("concepts").cast("long").alias("n"), V.concept_summary(F.col("concepts")).alias("summary"))


@query(
    f"""WITH {_BOOK}, s AS (SELECT concept_id, s, i, row_number() OVER (PARTITION BY concept_id, lower(s) ORDER BY i) AS k FROM (SELECT concept_id, unnest(synonyms) AS s, generate_subscripts(synonyms, 1) AS i FROM book))
      SELECT concept_id, array_to_string(list(s ORDER BY i)[1:8], '|') AS synonyms FROM s WHERE k = 1 GROUP BY concept_id"""
)
def synonym_expansion(spark, sf_dir):
    _, book = _concepts(spark, sf_dir)
    return book.select("concept_id", F.array_join(N.expanded(F.col("synonyms")), "|").alias("synonyms"))


@query(
    f"""WITH {PROFILES}, p AS (SELECT *, coalesce(CASE WHEN topic_id % 4 = 0 THEN NULL WHEN topic_id % 2 = 0 THEN 'benchmark' ELSE 'clinical_active' END, CASE WHEN topic_id % 8 = 0 THEN 'benchmark' END, 'clinical_active') AS mode FROM profiles)
      SELECT topic_id, mode, coalesce(nullif(dx, ''), substr(raw, 1, 120)) AS query, CASE WHEN mode = 'clinical_active' THEN 'RECRUITING,NOT_YET_RECRUITING' || CASE WHEN topic_id % 3 = 0 THEN ',ENROLLING_BY_INVITATION' ELSE '' END END AS statuses, 'fallback' AS source FROM p"""
)
def search_plan(spark, sf_dir):
    k = F.col("topic_id")
    asked = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 2 == 0, "benchmark").otherwise("clinical_active")
    rows = profiles(spark, sf_dir).withColumn("mode", P.mode_of(asked, F.when(k % 8 == 0, "benchmark")))
    rows = rows.withColumn("plan", P.fallback_plan(F.col("primary_diagnosis"), F.col("raw_text"), F.col("mode"), k % 3 == 0))
    allowed = P.allowed_statuses(P.finished_filters(F.col("plan.mandatory_filters"), F.col("mode")))
    return rows.select("topic_id", "mode", "plan.query", F.array_join(allowed, ",").alias("statuses"), "plan.source")


@query(
    """SELECT o_orderkey, k % 3 < 2 AND final > 0 AND k % 5 > 0 AND viable < 10 AS again, k % 7 > 0 AND k % 2 > 0 AND k % 4 < 1 + k % 2 AS critique,
        CASE WHEN k % 2 > 0 THEN NULL WHEN k % 17 = 0 THEN 'state_errors' WHEN k % 4 = 0 AND k % 3 = 0 THEN 'retrieval_empty' WHEN final = 0 THEN 'no_final_candidates' WHEN viable = 0 THEN 'all_candidates_hard_excluded'
          WHEN k % 6 = 0 THEN 'no_trial_evals' WHEN k % 5 = 0 THEN 'no_ranked_trials' ELSE 'judge_or_dossier_empty' END AS reason
        FROM (SELECT *, o_orderkey AS k, o_custkey % 15 AS final, least(o_custkey % 15, o_orderkey % 12) AS viable FROM orders)"""
)
def run_decisions(spark, sf_dir):
    k, final = F.col("o_orderkey"), F.col("o_custkey") % 15
    viable = F.least(final, k % 12)
    return Q.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        P.retrieve_again(k % 3, F.lit(2), final, k % 5 == 0, viable).alias("again"),
        P.critique(k % 7 > 0, k % 2, k % 4, 1 + k % 2).alias("critique"),
        P.no_rank_reason((k % 17 == 0).cast("int"), k % 4, k % 3, final, viable, k % 6, k % 5, k % 2).alias("reason"),
    )


# --- order steps -------------------------------------------------------------------


@query(
    f"""WITH {O.bm25(['all'], 30)}, places AS (SELECT topic_id, doc_id, min(place) AS place FROM (SELECT topic_id, doc_id, 31 - rank AS place FROM run WHERE rank % 3 = 0 UNION ALL SELECT topic_id, doc_id, rank + 100 FROM run WHERE rank % 6 = 0) GROUP BY ALL),
      r AS (SELECT run.topic_id, run.doc_id, run.rank AS old_rank, row_number() OVER (PARTITION BY run.topic_id ORDER BY run.doc_id % 5 = 0, CASE WHEN run.doc_id % 5 > 0 THEN place END NULLS LAST, run.rank)::INTEGER AS rank FROM run LEFT JOIN places USING (topic_id, doc_id) WHERE run.rank <= 14)
      SELECT * FROM r WHERE rank <= 10"""
)
def judge_apply_order(spark, sf_dir):
    run = R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 30)
    ranked = run.where("rank <= 14").select("topic_id", "doc_id", "rank", (F.col("doc_id") % 5 == 0).alias("filled"))
    order = run.where("rank % 3 = 0").select("topic_id", "doc_id", (31 - F.col("rank")).alias("place"))
    order = order.unionAll(run.where("rank % 6 = 0").select("topic_id", "doc_id", F.col("rank") + 100))
    order = order.unionAll(run.where("rank <= 2").select("topic_id", F.col("doc_id") + 10**9, F.lit(0)))
    return G.judged(ranked, order)


@query(
    f"""WITH {O.bm25(['all'], 20)}, runs AS (SELECT 'bm25' AS source, topic_id, doc_id, score, rank FROM run UNION ALL SELECT 'dense', query_id, vec_id, score, rank FROM ({O.dense('true', 20)})),
      lone AS (SELECT topic_id FROM runs GROUP BY topic_id HAVING min(source) = max(source)), two AS (SELECT * FROM runs WHERE topic_id NOT IN (SELECT topic_id FROM lone))
      SELECT topic_id, doc_id, score, rank FROM runs WHERE topic_id IN (SELECT topic_id FROM lone) AND rank <= 15 UNION ALL SELECT topic_id, doc_id, score, rank FROM ({O.fused({'bm25': 1.0, 'dense': 1.0}, 10, 'two', 'source')})"""
)
def fuse_node(spark, sf_dir):
    lexical = R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 20).select(F.lit("bm25").alias("source"), "topic_id", "doc_id", "score", "rank")
    v, q = Q._vectors(spark, sf_dir)
    near = R.dense(v, q, 20).select(F.lit("dense").alias("source"), F.col("query_id").alias("topic_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    return G.fuse_node(lexical.unionAll(near), {"bm25": 1.0, "dense": 1.0}, 10, 15, fielded=True)


@query(f"WITH {O.bm25(['all'], 50)} SELECT topic_id, doc_id, score, rank FROM run WHERE rank <= 30")
def listwise_head(spark, sf_dir):
    run = R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 50)
    return G.listwise(run).select("topic_id", "doc_id", "score", "rank")


def _negatives(name: str, source: str, key: str, text: str) -> str:
    parts = f"string_split_regex({text}, '{X.SENTENCE_END}')"
    cues = f"CASE WHEN t[k] || ' ' || coalesce(t[k + 1], '') IN {O._in(X.NEGATION_BIGRAMS)} THEN t[k + 2:k + 8] WHEN t[k] IN {O._in(X.NEGATION_CUES)} THEN t[k + 1:k + 7] END"
    return f"""{name}_s AS (SELECT {key}, i, {O.stems('sentence')} AS t FROM (SELECT {key}, unnest({parts}) AS sentence, generate_subscripts({parts}, 1) AS i FROM {source})),
      {name}_w AS (SELECT {key}, t, unnest(range(1, len(t) + 1)) AS k FROM {name}_s), {name}_f AS (SELECT DISTINCT {key}, unnest({cues}) AS term FROM {name}_w),
      {name} AS (SELECT {key}, list(term) AS terms FROM {name}_f WHERE term NOT IN {O._in(X.ENTITY_STOPWORDS + X.GENERIC_TERMS)} GROUP BY ALL)"""


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE least(1, len(list_intersect({a}, {b})) / sqrt(len({a})::DOUBLE * len({b}))) END::DOUBLE"


def _entity_sql() -> str:
    """CTEs up to comp: the components of the ten best candidates of each topic."""
    text = lambda *parts: "(" + " || ' ' || ".join(f"coalesce({p}, '')" for p in parts) + ")"
    words = lambda a, b: f"array_to_string(split(text, ' ')[{a}:{b}], ' ')"
    told = "array_to_string([coalesce(title, ''), coalesce(official, ''), summary, coalesce(detail, ''), raw], chr(10))"
    return f"""{O.bm25(['all'], 10)}, {TEXTS}, docs AS (SELECT * FROM texts WHERE doc_id IN (SELECT doc_id FROM run)), {_negatives('dn', 'docs', 'doc_id', told)},
      notes AS (SELECT item_id AS topic_id, text, CASE item_id % 2 WHEN 0 THEN 'No evidence of ' ELSE 'without ' END || text AS note FROM benchmark), {_negatives('pn', 'notes', 'topic_id', 'note')},
      d AS (SELECT doc_id, sex AS tsex, {O.terms(text('title', 'official', _SQL_PARTS['conditions'], _SQL_PARTS['keywords']), True)} AS tc, {O.terms(text(_SQL_PARTS['interventions'], 'summary', 'detail'), False)} AS iv,
        {O.terms("coalesce(nullif(inclusion, ''), raw)", True)} AS inc, {O.terms('exclusion', True)} AS exc, coalesce(dn.terms, []) AS tn FROM docs LEFT JOIN dn USING (doc_id)),
      p AS (SELECT topic_id, {_sql_pick(('male', 'female', 'unknown'), 'topic_id % 3')} AS psex, {O.terms(words(1, 4), True)} AS dis, {O.terms(words(5, 6), False)} AS bio, {O.terms(words(7, 8), True)} AS trt, {O.terms(words(9, 10), True)} AS com,
        coalesce(pn.terms, []) AS neg, {O.terms('note', True)} AS said FROM notes LEFT JOIN pn USING (topic_id)),
      q AS (SELECT *, list_distinct(list_concat(list_concat(dis, bio), list_concat(trt, com))) AS spec FROM p),
      j AS (SELECT *, list_distinct(list_concat(spec, list_filter(said, lambda x: NOT list_contains(neg, x)))) AS pos, list_distinct(list_concat(list_concat(tc, iv), list_concat(inc, exc))) AS every FROM run JOIN d USING (doc_id) JOIN q USING (topic_id)),
      c AS (SELECT *, {_cos('list_distinct(list_concat(dis, com))', 'tc')} AS ds, {_cos('bio', 'every')} AS bs, {_cos('trt', 'list_distinct(list_concat(iv, inc))')} AS ts, {_cos('pos', 'inc')} AS ins, {_cos('pos', 'exc')} AS exs,
        list_sort(list_intersect(neg, list_distinct(list_concat(list_concat(tc, iv), inc)))) AS theirs, list_sort(list_intersect(tn, pos)) AS ours, list_sort(list_intersect(pos, every)) AS shared, list_sort(list_intersect(spec, every)) AS own,
        CASE WHEN psex = 'unknown' OR tsex = 'ALL' THEN 0.5 WHEN upper(psex) = tsex THEN 1 ELSE 0 END::DOUBLE AS sx FROM j),
      e AS (SELECT *, least(1, 0.25::DOUBLE * (len(theirs) + len(ours)))::DOUBLE AS pen, len(shared) > 0 AND len(own) = 0 AS gen FROM c),
      comp AS (SELECT *, round(least(1, greatest(0, 0.4::DOUBLE * ds + 0.2::DOUBLE * ins + 0.18::DOUBLE * greatest(bs, ts) + CASE WHEN greatest(ds, bs, ts, ins) >= 0.05::DOUBLE THEN 0.08::DOUBLE * sx ELSE 0 END - 0.18::DOUBLE * exs - 0.24::DOUBLE * pen - CASE WHEN gen THEN 0.08::DOUBLE ELSE 0 END)) + 1e-9, 4)::DOUBLE AS es FROM e)"""


def _entity(spark, sf_dir):
    run = R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 10).select("topic_id", "doc_id", "score", "rank")
    words, k = F.split("text", " "), F.col("topic_id")
    people = Q.topics(spark, sf_dir).select(
        "topic_id",
        _pick(("male", "female", "unknown"), k % 3).alias("sex"),
        F.slice(words, 1, 4).alias("diagnoses"),
        F.slice(words, 5, 2).alias("biomarkers"),
        F.slice(words, 7, 2).alias("treatments"),
        F.slice(words, 9, 2).alias("comorbidities"),
        F.concat(F.when(k % 2 == 0, "No evidence of ").otherwise("without "), "text").alias("note"),
    )
    return G.entity_evidence(run, people, texts(spark, sf_dir))


_WORDS = ("positive_overlap_terms", "specific_overlap_terms", "patient_negated_trial_terms", "trial_negated_patient_terms")


@query(
    f"""WITH {_entity_sql()} SELECT topic_id, doc_id, es AS entity_score, round(ds + 1e-9, 4) AS disease_support, round(bs + 1e-9, 4) AS biomarker_support, round(ts + 1e-9, 4) AS intervention_support, round(ins + 1e-9, 4) AS inclusion_support,
        round(exs + 1e-9, 4) AS exclusion_overlap, round(pen + 1e-9, 4) AS negation_penalty, sx AS sex_alignment, gen AS generic_only_match, array_to_string(shared[1:12], ' ') AS positive_overlap_terms, array_to_string(own[1:12], ' ') AS specific_overlap_terms,
        array_to_string(theirs[1:12], ' ') AS patient_negated_trial_terms, array_to_string(ours[1:12], ' ') AS trial_negated_patient_terms FROM comp"""
)
def entity_components(spark, sf_dir):
    rows = _entity(spark, sf_dir).select("topic_id", "doc_id", "entity.*")
    return rows.select(*[F.array_join(c, " ").alias(c) if c in _WORDS else F.col(c) for c in rows.columns])


@query(
    f"""WITH {_entity_sql()}, n AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high, count(*) OVER w AS n FROM comp WINDOW w AS (PARTITION BY topic_id)),
      b AS (SELECT topic_id, doc_id, score, rank, low + ((1 - 0.09::DOUBLE) * CASE WHEN high > low THEN (score - low) / (high - low) WHEN n = 1 THEN 1 ELSE 1 - (rank - 1) / (n - 1) END + 0.09::DOUBLE * es) * greatest(high - low, 1) AS new FROM n),
      s AS (SELECT topic_id, doc_id, round(CASE WHEN rank <= 3 THEN greatest(new, score) ELSE new END, 6)::DOUBLE AS score, rank AS old_rank FROM b)
      SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, old_rank, doc_id)::INTEGER AS position FROM s"""
)
def entity_rerank(spark, sf_dir):
    return G.entity_rerank(_entity(spark, sf_dir), weight=0.09, protect=3)


@query(
    f"""WITH {O.bm25(['all'], 10)}, {TEXTS} SELECT topic_id, doc_id, len(list_intersect({_IRRELEVANT("array_to_string(split(text, ' ')[1:4], ' ')")}, {_IRRELEVANT("title")})) = 0 AS no_condition,
        len(list_intersect({_IRRELEVANT("array_to_string(split(text, ' ')[5:8], ' ')")}, {_IRRELEVANT("raw")})) = 0 AS no_intervention FROM run JOIN texts USING (doc_id) JOIN benchmark ON item_id = topic_id"""
)
def irrelevance_signals(spark, sf_dir):
    run = R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 10)
    words = F.split("text", " ")
    people = Q.topics(spark, sf_dir).select("topic_id", F.array_join(F.slice(words, 1, 4), " ").alias("conditions"), F.array_join(F.slice(words, 5, 4), " ").alias("treatments"))
    told = texts(spark, sf_dir).select("doc_id", F.col("title").alias("titles"), F.col("raw_text").alias("treatments"))
    return S.irrelevance_signals(run, people, told)


# --- criteria ----------------------------------------------------------------------

_MARKED_TEXT = "array_to_string(list_transform(split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '- ' || x WHEN (i - 1) % 5 = 2 THEN ' ' WHEN (i - 1) % 10 = 3 THEN 'Organ function:' WHEN (i - 1) % 10 = 8 THEN 'Inclusion Criteria:' ELSE x END), chr(10))"


def _sides(spark, sf_dir):
    marked = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("- "), x)).when(i % 5 == 2, " ").when(i % 10 == 3, "Organ function:").when(i % 10 == 8, "Inclusion Criteria:").otherwise(x),
    )
    return Q.documents(spark, sf_dir).select(
        F.col("doc_id").alias("trial"),
        F.array_join(marked, "\n").alias("inclusion_text"),
        F.when(F.col("doc_id") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise("").alias("exclusion_text"),
    )


def _sql_type(t: str) -> str:
    low = f"(' ' || regexp_replace(lower({t}), '[^\\x00-\\x7F]', 'x', 'g') || ' ')"
    return f"CASE WHEN {O.header(t)} THEN 'section_header' " + " ".join(f"WHEN {O._hit(low, p)} THEN '{name}'" for name, p in X.CRITERION_TYPES) + " ELSE 'other' END"


_SENTENCES = r"split(regexp_replace(text, '([.;])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_LINES = r"string_split_regex(text, '\r\n|\r|\n')"
_MERGED = f"""sides AS (SELECT * FROM (SELECT doc_id AS trial, 'inclusion' AS polarity, {_MARKED_TEXT} AS text FROM documents UNION ALL SELECT doc_id, 'exclusion', coalesce(text, '') FROM documents WHERE doc_id % 2 = 0) WHERE text <> ''),
      k AS (SELECT trial, polarity, i, {O._STRIP.format('raw')} AS line FROM (SELECT trial, polarity, unnest({_LINES}) AS raw, generate_subscripts({_LINES}, 1) AS i FROM sides)),
      j AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{X.BULLET}') THEN 'bullet' WHEN {O.header('line')} THEN 'header' ELSE 'more' END AS kind FROM k),
      b AS (SELECT *, lag(kind) OVER (PARTITION BY trial, polarity ORDER BY i) AS before FROM j),
      c AS (SELECT *, sum(CASE WHEN kind IN ('bullet', 'header') OR before IS NULL OR before IN ('blank', 'header') THEN 1 ELSE 0 END) OVER (PARTITION BY trial, polarity ORDER BY i) AS n FROM b WHERE kind <> 'blank'),
      h AS (SELECT trial, polarity, n AS pos, string_agg(CASE kind WHEN 'bullet' THEN {O._STRIP.format(f"regexp_extract(line, '{X.BULLET}', 1)")} ELSE line END, ' ' ORDER BY i) AS chunk FROM c GROUP BY ALL),
      several AS (SELECT trial, polarity FROM h GROUP BY ALL HAVING count(*) > 1),
      spoken AS (SELECT trial, polarity, generate_subscripts({_SENTENCES}, 1) AS pos, unnest({_SENTENCES}) AS chunk FROM sides ANTI JOIN several USING (trial, polarity)),
      u AS (SELECT trial, polarity, pos, {O._STRIP.format('chunk')} AS chunk FROM (SELECT * FROM h SEMI JOIN several USING (trial, polarity) UNION ALL SELECT * FROM spoken)),
      v AS (SELECT *, CASE WHEN {O.header('chunk')} THEN CASE WHEN {O._hit(O._low('chunk'), X.HEADER_DROP)} THEN 'drop' ELSE 'merge' END END AS action FROM u WHERE chunk <> ''),
      w AS (SELECT *, coalesce(sum(CASE WHEN action IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trial, polarity ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS n FROM v),
      m AS (SELECT trial, polarity, n, string_agg({O._STRIP.format("regexp_replace(chunk, ':+$', '')")}, ' / ' ORDER BY pos) FILTER (action = 'merge') AS heads, count(*) FILTER (action = 'merge') AS k, max(chunk) FILTER (action IS NULL) AS body, count(*) FILTER (action = 'drop') AS gone FROM w GROUP BY ALL),
      z AS (SELECT *, coalesce(heads || ': ', '') || body AS chunk FROM m)"""


@query(f"""WITH {_MERGED}, t AS (SELECT trial, polarity, n, chunk, {_sql_type('chunk')} AS type FROM z WHERE body IS NOT NULL)
      SELECT trial, CASE polarity WHEN 'inclusion' THEN 'i_' ELSE 'e_' END || n AS id, type, md5(chunk) AS digest FROM t WHERE type <> 'section_header'""")
def segment_criteria(spark, sf_dir):
    return K.segment(_sides(spark, sf_dir)).select("trial", "id", "type", _md5(F.col("text")).alias("digest"))


@query(f"""WITH {_MERGED} SELECT trial, sum(CASE WHEN body IS NULL THEN 0 ELSE k END)::BIGINT AS section_headers_merged, sum(gone + CASE WHEN body IS NULL THEN k WHEN {O.header('chunk')} THEN 1 ELSE 0 END)::BIGINT AS section_headers_dropped FROM z GROUP BY trial""")
def merge_headers(spark, sf_dir):
    return K.segment_counts(_sides(spark, sf_dir))


_LEGACY = K.LEGACY.replace("'", "''")


@query(
    f"""WITH s AS (SELECT doc_id, {_MARKED_TEXT} AS text FROM documents), p AS (SELECT doc_id, CASE WHEN len(string_split_regex(text, '{_LEGACY}')) <= 1 THEN {_SENTENCES} ELSE string_split_regex(text, '{_LEGACY}') END AS parts FROM s),
      k AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: {O._STRIP.format('x')}), lambda x: x <> '') AS parts FROM p)
      SELECT doc_id, generate_subscripts(parts, 1)::INTEGER AS n, md5(unnest(parts)) AS digest FROM k"""
)
def legacy_chunks(spark, sf_dir):
    rows = _sides(spark, sf_dir).select(F.col("trial").alias("doc_id"), F.col("inclusion_text").alias("text"))
    return K.legacy_chunks(rows, ["doc_id"]).select("doc_id", "n", _md5(F.col("chunk")).alias("digest"))


CRITERION = f"(['" + "', '".join(Q.CRITERIA) + f"'])[((trial * 7 + criterion * 3) % {len(Q.CRITERIA)} + 1)::INT]"
CRITERIA = f"{O.PLAIN}, crit AS (SELECT *, {CRITERION} AS t FROM evals)"
EVALUATED = f"{O.EVALS}, crit AS (SELECT *, {CRITERION} AS t FROM evals)"


def criteria(spark, sf_dir, evaluated=False):
    """The criteria of each trial with their texts; ``evaluated``: as each topic's evaluations."""
    return _texts((Q.evaluations if evaluated else Q.trial_criteria)(spark, sf_dir))


def _texts(rows):
    return rows.withColumn("text", _pick(Q.CRITERIA, (F.col("trial") * 7 + F.col("criterion") * 3) % len(Q.CRITERIA)))


_TERMS = ("melanoma", "her2", "chemotherapy", "hiv", "infection")


def _triage_sql() -> str:
    words = f"list_distinct(list_filter(regexp_extract_all(lower(t), '{X.HEADER_WORD}'), lambda x: length(x) >= 3 AND x NOT IN {O._in(X.TRIAGE_STOPWORDS)}))"
    matched = f"list_sort(list_intersect([{', '.join(repr(x) for x in _TERMS)}], {words}))"
    hits = [f"regexp_matches(lower(t), '{O._re(p)}')" for p, _ in X.TRIAGE_WORDS]
    signals = " + ".join(f"CASE WHEN {h} THEN {v}::DOUBLE ELSE 0 END" for h, (_, v) in zip(hits, X.TRIAGE_WORDS))
    strong, admin, broad = f"polarity = 'exclusion' AND type IN {O._in(X.TRIAGE_STRONG_EXCLUSIONS)}", O._hit("lower(t)", X.TRIAGE_ADMIN), f"regexp_matches(lower(t), '{X.TRIAGE_BROAD}')"
    named = "".join(f", CASE WHEN {h} THEN '{n}' END" for h, n in zip(hits, ("disease_severity", "molecular_status", "functional_status")))
    return f"""{CRITERIA}, y AS (SELECT trial, criterion AS pos, polarity, mandatory, criterion % 3 = 0 AS typed, t, CASE WHEN trial % 2 = 1 OR type = 'other' THEN {_sql_type('t')} ELSE type END AS type FROM crit),
      m AS (SELECT *, {matched} AS matched FROM y),
      sc AS (SELECT *, round(greatest(0, {O._case('type', X.TRIAGE_BASE, 2)} + CASE WHEN polarity = 'exclusion' THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {strong} THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN mandatory THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN typed THEN 0.4::DOUBLE ELSE 0 END
        + least(3, 0.7::DOUBLE * len(matched)) + {signals} - CASE WHEN {admin} THEN 3.5::DOUBLE ELSE 0 END - CASE WHEN {broad} THEN 0.6::DOUBLE ELSE 0 END), 6)::DOUBLE AS score,
        array_to_string(list_filter(['type:' || type, CASE WHEN polarity = 'exclusion' THEN 'exclusion' END, CASE WHEN {strong} THEN 'high_signal_exclusion' END, CASE WHEN mandatory THEN 'mandatory' END, CASE WHEN typed THEN 'typed_predicate' END,
          CASE WHEN len(matched) > 0 THEN 'patient_match:' || array_to_string(matched[1:4], ',') END{named}, CASE WHEN {admin} THEN 'administrative_penalty' END, CASE WHEN {broad} THEN 'broad_organ_function' END], lambda x: x IS NOT NULL), '|') AS reasons FROM m),
      nt AS (SELECT *, row_number() OVER (PARTITION BY trial, polarity ORDER BY score DESC, pos) AS nth, count(*) FILTER (polarity = 'exclusion') OVER (PARTITION BY trial) AS ne, count(*) OVER (PARTITION BY trial) AS na FROM sc),
      f AS (SELECT *, CASE WHEN polarity = 'inclusion' THEN nth <= CASE WHEN ne > 0 THEN 2 ELSE 3 END ELSE nth <= 1 END AS first FROM nt),
      tr AS (SELECT *, na <= 3 OR row_number() OVER (PARTITION BY trial ORDER BY first DESC, score DESC, pos) <= 3 AS selected FROM f),
      triaged AS (SELECT *, CASE WHEN NOT selected THEN row_number() OVER (PARTITION BY trial, selected ORDER BY score DESC, pos) END AS place FROM tr)"""


def _triaged(spark, sf_dir):
    rows = _texts(Q.trial_criteria(spark, sf_dir, "label", "confidence", by_trial=True)).select(
        "trial", F.col("criterion").alias("pos"), "polarity",
        F.when(F.col("trial") % 2 == 1, "other").otherwise(F.col("type")).alias("type"),
        "text", "mandatory", (F.col("criterion") % 3 == 0).alias("typed"),
    )
    # the evaluations before the last is picked hold the same texts
    return K.triaged(rows, F.array(*map(F.lit, _TERMS)), 3, _texts(Q._evaluated(spark, sf_dir)))


@query(f"WITH {_triage_sql()} SELECT trial, pos, score, reasons, selected, CASE WHEN place <= 5 THEN place END::INTEGER AS dropped_place FROM triaged")
def cap_triage(spark, sf_dir):
    return _triaged(spark, sf_dir).select("trial", "pos", "score", F.array_join("reasons", "|").alias("reasons"), "selected", "dropped_place")


@query(
    f"""WITH {_triage_sql()}, t AS (SELECT trial, count(*) AS seen, count(*) FILTER (selected) AS selected, round(avg(score) FILTER (selected), 3) AS mean FROM triaged GROUP BY trial)
      SELECT count(*) AS trials_with_triage, sum(seen)::BIGINT AS total_seen, sum(selected)::BIGINT AS selected, sum(seen - selected)::BIGINT AS dropped, round(sum(mean * selected) / sum(selected), 3) AS mean_selected_score FROM t"""
)
def triage_diagnostics(spark, sf_dir):
    return K.triage_summary(_triaged(spark, sf_dir))


@query(f"WITH {_triage_sql()} SELECT trial, pos, type, polarity, round(score, 3) AS score FROM triaged WHERE place <= 5 ORDER BY round(score, 3) DESC, trial, pos LIMIT 10")
def triage_top_dropped(spark, sf_dir):
    return K.dropped_first(_triaged(spark, sf_dir))


_SAID = ("lab", "", "unknown kind", None)


@query(
    f"""WITH {CRITERIA}, pay AS (SELECT trial, criterion, 1 AS place, {_sql_pick(_SAID, 'trial % 4')} AS type, CASE WHEN criterion % 2 = 0 THEN 'said: ' || t END AS said FROM crit WHERE (trial + criterion) % 3 = 0
        UNION ALL SELECT trial, criterion, 2, 'age', 'late' FROM crit WHERE (trial + criterion) % 5 = 0),
      one AS (SELECT trial, criterion, min_by(struct_pack(t := type, s := said), place) AS x FROM pay WHERE type IS NULL OR type <> 'unknown kind' GROUP BY ALL)
      SELECT trial, 'i_' || criterion AS id, coalesce(nullif(x.t, ''), type) AS type, coalesce(nullif(x.s, ''), t) AS text FROM crit LEFT JOIN one USING (trial, criterion)"""
)
def classify_merge(spark, sf_dir):
    rows = criteria(spark, sf_dir)
    ident = F.concat(F.lit("i_"), F.col("criterion").cast("string"))
    seg = rows.select("trial", ident.alias("id"), "type", "text")
    both = F.col("trial") + F.col("criterion")
    said = F.get(F.array(*[F.lit(x).cast("string") for x in _SAID]), (F.col("trial") % 4).cast("int"))
    early = rows.where(both % 3 == 0).select(
        "trial", ident.alias("id"), F.lit(1).alias("place"), said.alias("type"), F.when(F.col("criterion") % 2 == 0, F.concat(F.lit("said: "), "text")).alias("text")
    )
    late = rows.where(both % 5 == 0).select("trial", ident.alias("id"), F.lit(2), F.lit("age"), F.lit("late"))
    return K.classified(seg, early.unionAll(late))


_JSON = """('{"id": ' || CASE WHEN p_partkey % 7 > 0 THEN '"i_' || p_partkey || '"' ELSE 'null' END || ', "type": "' || (['lab', '', 'odd kind', 'age'])[p_partkey % 4 + 1] || '", "raw_text": " No ' || p_type || ' "' || CASE WHEN p_partkey % 3 = 0 THEN ', "polarity": "exclusion", "is_mandatory": false' ELSE '' END
        || CASE WHEN p_partkey % 2 = 0 THEN ', "predicate": {"op": "' || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '>=' END || '", "feature": "x", "value": "1"}, "extraction_confidence": 0.5' ELSE '' END || '}')"""


@query(
    f"""WITH j AS (SELECT p_partkey, {_JSON} AS j FROM part), c AS (SELECT p_partkey, coalesce(nullif(json_extract_string(j, '$.id'), ''), 'x_0') AS id, coalesce(json_extract_string(j, '$.polarity'), 'inclusion') AS polarity, coalesce(nullif(json_extract_string(j, '$.type'), ''), 'other') AS type,
        trim(json_extract_string(j, '$.raw_text')) AS raw_text, coalesce(json_extract_string(j, '$.is_mandatory')::BOOLEAN, true) AS is_mandatory, coalesce(json_extract_string(j, '$.extraction_confidence')::DOUBLE, 1) AS confidence, nullif(json_extract_string(j, '$.predicate.op'), '') AS op FROM j)
      SELECT *, regexp_matches(raw_text, '(?i){O._re(X.NEGATION_CUE)}') AS has_negation FROM c WHERE type <> 'odd kind'"""
)
def coerce_criteria(spark, sf_dir):
    k = F.col("p_partkey")
    json = F.concat(
        F.lit('{"id": '), F.when(k % 7 > 0, F.concat(F.lit('"i_'), k.cast("string"), F.lit('"'))).otherwise("null"),
        F.lit(', "type": "'), _pick(("lab", "", "odd kind", "age"), k % 4), F.lit('", "raw_text": " No '), "p_type", F.lit(' "'),
        F.when(k % 3 == 0, ', "polarity": "exclusion", "is_mandatory": false').otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit(', "predicate": {"op": "'), F.when(k % 6 == 0, "").otherwise(">="), F.lit('", "feature": "x", "value": "1"}, "extraction_confidence": 0.5'))).otherwise(""),
        F.lit("}"),
    )
    rows = Q.table(spark, sf_dir, "part").select("p_partkey", K.coerced(json).alias("c")).where("c is not null")
    return rows.select(
        "p_partkey", "c.id", "c.polarity", "c.type", "c.raw_text", "c.is_mandatory", F.col("c.extraction_confidence").alias("confidence"),
        F.col("c.predicate.op").alias("op"), "c.has_negation",
    )


_KINDS, _OPS = ("age", "sex", "performance_status", "lab", "biomarker"), (">=", "<=", "=", "!=", "~", None)
_FEATURES, _VALUES = ("ECOG", "karnofsky", "Creatinine ", "weight"), ("18", "female", "1", "abc", "2.4", None, "60")
_NUMERIC = lambda v: f"CASE WHEN bound IS NOT NULL THEN CASE WHEN CASE op WHEN '>=' THEN {v} >= bound WHEN '<=' THEN {v} <= bound WHEN '=' THEN {v} = bound WHEN '!=' THEN {v} <> bound ELSE false END THEN 'met' ELSE 'not_met' END END"


@query(
    f"""WITH {PROFILES}, d AS (SELECT *, {_sql_pick(_KINDS, 'topic_id % 5')} AS kind, {_sql_pick(_OPS, 'topic_id % 6')} AS op, lower({_sql_pick(_FEATURES, 'topic_id % 4')}) AS feature, {_sql_pick(_VALUES, 'topic_id % 7')} AS value,
        try_cast({_sql_pick(_VALUES, 'topic_id % 7')} AS DOUBLE) AS bound FROM profiles), l AS (SELECT *, list_filter(labs, lambda x: lower(trim(x.name)) = trim(feature))[1].value AS lab FROM d)
      SELECT topic_id, CASE WHEN op IS NOT NULL THEN CASE kind WHEN 'age' THEN CASE WHEN age IS NULL THEN 'NEI' ELSE {_NUMERIC('age')} END WHEN 'sex' THEN CASE WHEN sex = 'unknown' THEN 'NEI' WHEN sex = lower(coalesce(value, '')) THEN 'met' ELSE 'not_met' END
        WHEN 'performance_status' THEN CASE WHEN feature = 'ecog' AND ecog IS NOT NULL THEN {_NUMERIC('ecog')} WHEN feature = 'karnofsky' AND karnofsky IS NOT NULL THEN {_NUMERIC('karnofsky')} ELSE 'NEI' END
        WHEN 'lab' THEN CASE WHEN lab IS NULL THEN 'NEI' ELSE {_NUMERIC('lab')} END END END AS label FROM l"""
)
def deterministic_eval(spark, sf_dir):
    k = F.col("topic_id")
    null = lambda xs, n: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (k % n).cast("int"))
    made = E.deterministic(null(_KINDS, 5), null(_OPS, 6), null(_FEATURES, 4), null(_VALUES, 7))
    return profiles(spark, sf_dir).select("topic_id", made.alias("label"))


@query(f"WITH {O.EVALS} SELECT topic_id, trial, criterion, label, 'k' || criterion AS name FROM evals WHERE (trial + criterion) % 3 > 0")
def evaluation_criteria(spark, sf_dir):
    evals = Q.evaluations(spark, sf_dir)
    known = Q.trial_criteria(spark, sf_dir).where((F.col("trial") + F.col("criterion")) % 3 > 0).select("trial", "criterion", F.concat(F.lit("k"), F.col("criterion").cast("string")).alias("name"))
    return E.attach_criteria(evals.select(*E.KEY, "criterion", "label"), known)


# --- questions and dossiers -----------------------------------------------------------

_UNSAID = "The available patient note does not contain enough information to determine this criterion confidently."
_QUESTIONS = f"""{EVALUATED}, ask AS (SELECT topic_id, trial, criterion, 'c_' || criterion AS criterion_id, 'For trial ' || trial || ', what patient information confirms this criterion: ' || t AS question_text, t AS data_point, {O.asked('t')} AS expected_data_type,
        CASE WHEN mandatory THEN 'high' ELSE 'medium' END AS priority, CASE WHEN criterion % 4 = 0 THEN 'why ' || criterion ELSE '{_UNSAID}' END AS rationale FROM crit WHERE label = 'NEI')"""


def _told(spark, sf_dir):
    return criteria(spark, sf_dir, True).select(
        "*",
        F.concat(F.lit("c_"), F.col("criterion").cast("string")).alias("id"),
        F.when(F.col("criterion") % 4 == 0, F.concat(F.lit("why "), F.col("criterion").cast("string"))).alias("reasoning"),
        F.when(F.col("criterion") % 2 == 0, F.concat(F.lit("seen "), F.col("criterion").cast("string"))).alias("evidence"),
    )


@query(f"WITH {_QUESTIONS} SELECT topic_id, trial, criterion_id, CASE WHEN criterion = 3 THEN 'asked by a model' ELSE question_text END AS question_text, data_point, expected_data_type, CASE WHEN criterion = 3 THEN 'critical' ELSE priority END AS priority, rationale FROM ask")
def fallback_questions(spark, sf_dir):
    rows = D.fallback_questions(_told(spark, sf_dir))
    payload = rows.where("criterion = 3").select(*E.KEY, "criterion_id", F.lit("asked by a model").alias("question_text"), F.lit("critical").alias("priority"))
    return D.with_payload(rows, payload).select(*E.KEY, "criterion_id", "question_text", "data_point", "expected_data_type", "priority", "rationale")


_COUNT = ", ".join(f"count(*) FILTER (polarity = '{p}'{c}) AS {p}_{n}" for p in ("inclusion", "exclusion") for n, c in (("total", ""), ("met", " AND label = 'met'"), ("not_met", " AND label = 'not_met'"), ("nei", " AND label = 'NEI'")))


@query(
    f"""WITH {_QUESTIONS}, {O.TRIALS}, n AS (SELECT topic_id, trial, {_COUNT}, coalesce(min_by('seen ' || criterion, criterion) FILTER (label = 'met' AND criterion % 2 = 0), '') AS top_evidence FROM crit GROUP BY topic_id, trial),
      a AS (SELECT topic_id, trial, string_agg(criterion_id || ':' || priority, ' ' ORDER BY priority = 'medium', criterion) AS questions FROM ask GROUP BY topic_id, trial)
      SELECT topic_id, trial, n.* EXCLUDE (topic_id, trial), CASE WHEN trial % 3 = 0 THEN 'because' ELSE 'About ' || status END AS executive_summary, coalesce(questions, '') AS questions,
        CASE trial % 3 WHEN 0 THEN 'Rome, Italy; Spain' WHEN 1 THEN 'Lyon' ELSE '(no locations listed)' END AS locations_summary, CASE WHEN trial % 2 = 0 THEN 'A. B. | a@b.c' END AS contact_summary, 'https://clinicaltrials.gov/study/' || trial AS url
        FROM n JOIN trials USING (trial) LEFT JOIN a USING (topic_id, trial)"""
)
def dossier_rows(spark, sf_dir):
    evals = _told(spark, sf_dir)
    k = F.col("trial")
    place = lambda city, country: F.struct(F.lit(city).cast("string").alias("city"), F.lit(country).cast("string").alias("country"))
    sites = F.when(k % 3 == 0, F.array(place("Rome", "Italy"), place("", "Spain"), place(None, None))).when(k % 3 == 1, F.array(place("Lyon", None)))
    contact = F.struct(F.lit("A. B.").alias("name"), F.lit("a@b.c").alias("email"), F.lit(None).cast("string").alias("phone"))
    trials = Q.trials(spark, sf_dir).select(
        "trial", F.concat(F.lit("Trial "), k.cast("string")).alias("title"), F.concat(F.lit("About "), "status").alias("brief_summary"), "phase", "status",
        sites.alias("locations"), F.when(k % 2 == 0, F.array(contact)).alias("contacts"),
    )
    judged = evals.select(*E.KEY).distinct().join(trials.select("trial"), "trial").select(
        *E.KEY, F.lit(1).alias("rank"), F.lit(0.5).alias("score"), F.when(k % 3 == 0, "because").alias("rationale")
    )
    rows = D.dossiers(judged, evals, trials, D.fallback_questions(evals))
    asked = F.array_join(F.transform("missing_information", lambda q: F.concat(q["criterion_id"], F.lit(":"), q["priority"])), " ")
    counts = [f"{p}_{x}" for p in ("inclusion", "exclusion") for x in ("total", "met", "not_met", "nei")]
    return rows.select(*E.KEY, *counts, "top_evidence", "executive_summary", asked.alias("questions"), "locations_summary", "contact_summary", "url")


@query(
    f"""WITH {O.EVALS}, {O.COUNTS}, {O.TRIALS}, l AS (SELECT topic_id * 50 + trial % 50 AS topic_id, trial, trial || '. ' || trial || ' — ' || 'Trial ' || trial || ' | phase=' || phase || ' | status=' || status || ' | incl met/total=' || inc_met || '/' || n_inc || ', excl clear/total=' || exc_not || '/' || n_exc
        || ', NEI=' || round_even(fraction_nei * 100, 0)::BIGINT || '%' AS line FROM counts JOIN trials USING (trial)) SELECT topic_id, md5(string_agg(line, chr(10) ORDER BY trial)) AS digest FROM l GROUP BY topic_id"""
)
def judge_block(spark, sf_dir):
    k = F.col("trial")
    rows = E.trial_counts(Q.evaluations(spark, sf_dir)).join(Q.trials(spark, sf_dir), "trial")
    line = V.candidate_line(k, k, F.concat(F.lit("Trial "), k.cast("string")))
    blocks = G.render_candidates(rows.select((F.col("topic_id") * 50 + k % 50).alias("topic_id"), k.alias("place"), line.alias("line")))
    return blocks.select("topic_id", _md5(F.col("block")).alias("digest"))


@query(
    f"""WITH {CRITERIA}, e AS (SELECT trial, string_agg('### Example (' || type || ')' || chr(10) || 'Criterion: ' || t || chr(10) || 'Patient excerpt: ' || polarity || chr(10) || 'Reasoning: ' || chr(10) || 'Decision: ' || label || chr(10), chr(10) ORDER BY criterion) AS block,
        string_agg('[c_' || criterion || CASE polarity WHEN 'inclusion' THEN ' INCL ' ELSE ' EXCL ' END || type || '] ' || t, chr(10) ORDER BY criterion) AS shorts FROM crit GROUP BY trial) SELECT trial, md5(block) AS block, md5(shorts) AS shorts FROM e"""
)
def example_blocks(spark, sf_dir):
    made = F.struct(
        "criterion", F.col("type").alias("category"), F.col("text").alias("criterion_text"), F.col("polarity").alias("patient_excerpt"), F.lit("").alias("reasoning"),
        F.col("label").alias("decision"), V.criterion_short(F.concat(F.lit("c_"), F.col("criterion").cast("string")), F.col("polarity"), F.col("type"), F.col("text")).alias("short"),
    )
    rows = criteria(spark, sf_dir).groupBy("trial").agg(F.sort_array(F.collect_list(made)).alias("x"))
    return rows.select("trial", _md5(V.examples_block(F.col("x"))).alias("block"), _md5(F.array_join(F.transform("x", lambda e: e["short"]), "\n")).alias("shorts"))


# --- audits ----------------------------------------------------------------------------

_TRACES = f"""{O.QRELS}, {O.bm25(['all'], 50)}, judged AS (SELECT doc_id % 40 AS topic_id, doc_id, grade FROM qrels),
      traces AS (SELECT topic_id, 'bm25' AS stage, rank AS place, doc_id FROM run UNION ALL SELECT topic_id, 'reranked_candidates', (doc_id % 97) * 100 + rank, doc_id FROM run WHERE rank <= 30
        UNION ALL SELECT topic_id, 'reranked', rank, doc_id FROM run WHERE rank <= 5 UNION ALL SELECT topic_id, 'ranked_trials', rank, doc_id FROM run WHERE rank <= 20 AND doc_id % 2 = 0 UNION ALL SELECT topic_id, 'ranked_trials', rank + 50, doc_id FROM run WHERE rank <= 9 AND doc_id % 2 = 0)"""


def _traces(spark, sf_dir):
    run = cut(R.bm25(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 50))
    part = lambda where, stage, place: run.where(where).select("topic_id", F.lit(stage).alias("stage"), place.cast("long").alias("place"), "doc_id")
    rank = F.col("rank")
    rows = part("true", "bm25", rank).unionAll(part("rank <= 30", "reranked_candidates", (F.col("doc_id") % 97) * 100 + rank))
    rows = rows.unionAll(part("rank <= 5", "reranked", rank)).unionAll(part("rank <= 20 and doc_id % 2 = 0", "ranked_trials", rank))
    return rows.unionAll(part("rank <= 9 and doc_id % 2 = 0", "ranked_trials", rank + 50))


_AUDITED = ("bm25_candidates", "reranked_candidates", "final_candidates", "ranked_trials")


@query(
    f"""WITH {_TRACES}, named AS (SELECT t.topic_id, s.stage, place, doc_id, t.stage <> s.stage AS short FROM traces t JOIN (SELECT unnest(['{"', '".join(_AUDITED)}']) AS stage, unnest(['{"', '".join(X.STAGES[s] for s in _AUDITED)}']) AS alias) s ON t.stage IN (s.stage, s.alias)),
      long AS (SELECT * FROM named QUALIFY short = min(short) OVER (PARTITION BY topic_id, stage)), one AS (SELECT topic_id, stage, doc_id, min(place) AS place FROM long GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, stage ORDER BY place) AS rank FROM one), tot AS (SELECT topic_id, count(*) FILTER (grade > 0) AS ar, count(*) FILTER (grade = 2) AS ae FROM judged GROUP BY topic_id),
      c AS (SELECT topic_id, stage, cutoff, count(*) FILTER (rank <= cutoff) AS shown, count(grade) FILTER (rank <= cutoff) AS judged, count(*) FILTER (rank <= cutoff AND grade > 0) AS relevant, count(*) FILTER (rank <= cutoff AND grade = 2) AS eligible
        FROM r LEFT JOIN judged USING (topic_id, doc_id), (SELECT unnest({list(X.STAGE_CUTOFFS)}) AS cutoff) GROUP BY ALL)
      SELECT topic_id, stage, cutoff, judged, relevant, eligible, round(coalesce(relevant / nullif(ar, 0), 0), 6)::DOUBLE AS recall_relevant, round(coalesce(eligible / nullif(ae, 0), 0), 6)::DOUBLE AS recall_eligible, round(coalesce(judged / nullif(shown, 0), 0), 6)::DOUBLE AS judged_fraction FROM c LEFT JOIN tot USING (topic_id)"""
)
def agent_stage_audit(spark, sf_dir):
    judged = Q.qrels(spark, sf_dir).withColumn("topic_id", F.pmod("doc_id", F.lit(40)).cast("long"))
    return A.stage_audit(_traces(spark, sf_dir), judged, list(_AUDITED))


@query(
    f"""WITH {_TRACES}, one AS (SELECT topic_id, stage, doc_id, min(place) AS place FROM traces GROUP BY ALL), ids AS (SELECT topic_id, stage, string_agg(doc_id, ' ' ORDER BY place, doc_id) AS ids FROM one GROUP BY ALL)
      SELECT topic_id, stage, ids FROM ids UNION ALL SELECT topic_id, CASE stage WHEN 'reranked_candidates' THEN 'reranked' ELSE 'ranked' END, ids FROM ids WHERE stage IN ('reranked_candidates', 'ranked_trials')"""
)
def stage_traces(spark, sf_dir):
    return A.stage_traces(_traces(spark, sf_dir)).select("topic_id", "stage", F.array_join("ids", " ").alias("ids"))


_RANKED = f"{O.QRELS}, {O.bm25(['all'], 20)}, rows_ AS (SELECT topic_id, doc_id, rank, score, coalesce(grade, 0) AS gold, (doc_id + topic_id) % 3 AS predicted FROM run LEFT JOIN qrels USING (doc_id))"


def _ranked(spark, sf_dir):
    run = Q.bm25_topk(spark, sf_dir).join(Q.qrels(spark, sf_dir), "doc_id", "left")
    return run.select("topic_id", "doc_id", "rank", "score", F.coalesce("grade", F.lit(0)).alias("gold"), ((F.col("doc_id") + F.col("topic_id")) % 3).alias("predicted"))


@query(
    f"""WITH {_RANKED} SELECT topic_id, count(*) AS ranked, count(*) FILTER (gold > 0) AS relevant, count(*) FILTER (gold = 2) AS eligible, min(rank) FILTER (gold > 0) AS first_relevant_rank, min(rank) FILTER (gold = 2) AS first_eligible_rank,
        count(*) FILTER (gold <> predicted) AS disagreements, count(*) FILTER (rank <= 10 AND gold = 0 AND predicted > 0) AS top10_false_positives FROM rows_ GROUP BY topic_id"""
)
def error_topics(spark, sf_dir):
    return A.error_topics(_ranked(spark, sf_dir))


@query(f"WITH {_RANKED} SELECT topic_id, doc_id, rank, gold, predicted FROM rows_ WHERE gold <> predicted ORDER BY abs(gold - predicted) DESC, rank, score DESC, topic_id, doc_id LIMIT 20")
def error_representatives(spark, sf_dir):
    return A.representatives(_ranked(spark, sf_dir)).select("topic_id", "doc_id", "rank", "gold", "predicted")


_MEANS = "count(*) AS n_topics, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("ndcg10", "p10", "recall20", "rr", "ap"))


@query(
    f"""SELECT 'lexical' AS variant, {_MEANS} FROM ({O.metrics(False)}) UNION ALL SELECT 'fielded', {_MEANS} FROM ({O.metrics(False, 'fz', f"{O.bm25(X.FIELD_WEIGHTS, 1000)}, fz AS ({O.fused(X.FIELD_WEIGHTS, 20)})")})"""
)
def ablation_matrix(spark, sf_dir):
    fielded = R.fielded(Q.documents(spark, sf_dir), Q.topics(spark, sf_dir), 20)
    return A.ablations({"lexical": Q.bm25_topk(spark, sf_dir), "fielded": fielded}, Q.qrels(spark, sf_dir))


_CODE = lambda c: f"CASE {c} WHEN 'met' THEN 0 WHEN 'not_met' THEN 1 ELSE 2 END"
_LABELS = ("met", "not_met", "NEI")


@query(
    f"WITH {O.EVALS}, z AS (SELECT {_CODE('label')} AS predicted, ((trial + criterion) % 3)::INT AS gold FROM evals WHERE trial % 2 = 0) {O.rates(O.classes('z'))}"
)
def f1_criterion(spark, sf_dir):
    evals = Q.evaluations(spark, sf_dir)
    gold = evals.where("trial % 2 = 0").select(*E.KEY, "criterion", _pick(_LABELS, (F.col("trial") + F.col("criterion")) % 3).alias("label"))
    return A.criterion_scores(evals, gold)


@query(
    f"WITH {O.EVALS}, {O.COUNTS}, z AS (SELECT {O.grade(O.label('clinical', True))} AS predicted, (o_custkey % 3)::INT AS gold FROM counts JOIN orders ON o_orderkey = trial AND o_custkey % 2 = topic_id WHERE o_custkey % 4 > 0) SELECT {O.MEANS} FROM ({O.rates(O.classes('z'))})"
)
def f1_trial_overlap(spark, sf_dir):
    """Predictions meet judgements of another table; only what both hold is scored."""
    rows = E.trial_counts(Q.evaluations(spark, sf_dir)).select(*E.KEY, E.grade(E.trial_label("clinical", True)).alias("predicted"))
    gold = Q.table(spark, sf_dir, "orders").where("o_custkey % 4 > 0").select((F.col("o_custkey") % 2).alias("topic_id"), F.col("o_orderkey").alias("trial"), (F.col("o_custkey") % 3).cast("int").alias("gold"))
    return averages(class_scores(rows.join(gold, E.KEY)))


_GRID = ((1.0, 0.5, 0.2), (1.0, 0.0, 0.0), (0.3, 1.0, 0.2), (0.0, 0.0, 1.0), (0.5, 0.5, 0.5))


@query(
    f"""WITH {O.EVALS}, {O.COUNTS}, r AS (SELECT topic_id * 40 + trial % 40 AS topic_id, trial, trial % 3 AS grade, CASE WHEN n_inc > 0 THEN inc_met / n_inc ELSE 0 END::DOUBLE AS a, CASE WHEN n_exc > 0 THEN exc_not / n_exc ELSE 1 END::DOUBLE AS b, -fraction_nei AS c FROM counts),
      g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)' for i, (x, y, z) in enumerate(_GRID))}) v(place, x, y, z)),
      s AS (SELECT place, topic_id, grade, row_number() OVER (PARTITION BY place, topic_id ORDER BY round(x * a + y * b + z * c, 9) DESC, trial) AS rank FROM r, g),
      d AS (SELECT place, topic_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM s WHERE rank <= 10 GROUP BY ALL),
      i AS (SELECT topic_id, sum((pow(2, grade) - 1) / log2(k + 1)) AS ideal FROM (SELECT topic_id, grade, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, trial) AS k FROM r) WHERE k <= 10 GROUP BY topic_id),
      m AS (SELECT place, round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 6) AS ndcg10 FROM d JOIN i USING (topic_id) GROUP BY place) SELECT *, row_number() OVER (ORDER BY ndcg10 DESC, place) = 1 AS best FROM m"""
)
def weight_grid(spark, sf_dir):
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    rows = E.trial_counts(Q.evaluations(spark, sf_dir)).select(
        (F.col("topic_id") * 40 + F.col("trial") % 40).alias("topic_id"), F.col("trial").alias("doc_id"), (F.col("trial") % 3).alias("grade"),
        share("inc_met", "n_inc", 0.0).alias("met"), share("exc_not", "n_exc", 1.0).alias("clear"), (-F.col("fraction_nei")).alias("known"),
    )
    return A.grid_search(rows, ["met", "clear", "known"], list(_GRID))


_W = X.CHALLENGE_WEIGHTS


@query(
    f"""SELECT round({_W['retrieval']}::DOUBLE * (SELECT recall20 FROM ({O.ORACLES['trec_summary']})) + {_W['f1']}::DOUBLE * (SELECT micro_f1 FROM ({O.ORACLES['f1_average']})) + {_W['ndcg']}::DOUBLE * (SELECT ndcg10 FROM ({O.ORACLES['trec_summary']}))
        + {_W['questions']}::DOUBLE * (SELECT mean_score FROM ({O.ORACLES['question_summary']})) + {_W['dossiers']}::DOUBLE * (SELECT round(avg(completeness), 6) FROM ({O.ORACLES['dossier_completeness']})), 6) AS score"""
)
def challenge_score(spark, sf_dir):
    one = lambda name, df, value: df.select(F.lit(name).alias("part"), value.cast("double").alias("value"))
    ranking = cut(Q.trec_summary(spark, sf_dir))
    rows = one("retrieval", ranking, F.col("recall20")).unionAll(one("ndcg", ranking, F.col("ndcg10")))
    rows = rows.unionAll(one("f1", Q.f1_average(spark, sf_dir), F.col("micro_f1"))).unionAll(one("questions", Q.question_summary(spark, sf_dir), F.col("mean_score")))
    full = Q.dossier_completeness(spark, sf_dir).agg(F.round(F.avg("completeness"), 6).alias("completeness"))
    rows = rows.unionAll(one("dossiers", full, F.col("completeness")))
    parts = rows.agg(*[F.max(F.when(F.col("part") == k, F.col("value"))).alias(k) for k in _W])
    return parts.select(F.round(V.combined_score(**{k: F.col(k) for k in _W}), 6).alias("score"))
