"""Registered queries of the model hook, lenient JSON, saved indexes, access by id and manifests, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions import views as V
from quillmatch.functions.lenient import lenient_json
from quillmatch.operators import lexical as L
from quillmatch.operators import modelhook as H
from quillmatch.operators.lineage import shared_folder
from quillmatch.plans import matching as N
from quillmatch.plans import oracle as O
from quillmatch.plans import queries as Q
from quillmatch.sources import corpus as C
from quillmatch.sources import manifests as M

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _own_folder(spark, name):
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


# --- lenient JSON ------------------------------------------------------------------

_BARE = "replace(replace(coalesce(text, ''), chr(34), chr(39)), chr(92), '/')"


@query(
    f"""SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN md5({_BARE} || CASE turn % 4 WHEN 0 THEN '\\> 1' WHEN 1 THEN '"\\' ELSE '' END) END AS said,
        CASE WHEN turn % 4 < 3 THEN CASE turn % 4 WHEN 2 THEN 2 ELSE 1 END END AS level FROM conversations"""
)
def lenient_answers(spark, sf_dir):
    """What turns say, out of answers with fences, prose, stray backslashes, raw control characters and cut ends."""
    c, kind = Q.table(spark, sf_dir, "conversations"), F.col("turn") % 4
    bare = F.translate(F.coalesce("text", F.lit("")), '"\\', "'/")
    shaped = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"said": "'), bare, F.lit('\\> 1", "level": 1}\n```')))
        .when(kind == 1, F.concat(F.lit('Here: {"level": 1, "said": "'), bare, F.lit('\\"\\\\"} and {"level": 9}')))
        .when(kind == 2, F.concat(F.lit('{"more": [{"x": "}{"}], "level": 2, "said": "'), bare, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"level": 3, "said": "'), bare))
    )
    rows = c.select("conv_id", "turn", lenient_json(shaped).alias("v"))
    said = F.try_variant_get("v", "$.said", "string")
    return rows.select("conv_id", "turn", F.md5(said.cast("binary")).alias("said"), F.try_variant_get("v", "$.level", "int").alias("level"))


# --- model hook --------------------------------------------------------------------


def reader_model(requests: list[dict]) -> list[str]:
    """Stands for a model: reads a prompt's words; every third length fails at first, every seventh always."""
    out = []
    for r in requests:
        text = r["prompt"][: -len(X.JSON_INSTRUCTION)] if r["prompt"].endswith(X.JSON_INSTRUCTION) else r["prompt"].split(X.JSON_INSTRUCTION + X.RETRY_OPENING)[0]
        n, again = len(text.encode().split()), X.RETRY_OPENING in r["prompt"]
        quote = text[:30].replace('"', "").replace("\\", "")
        if n % 7 == 0 or n % 3 == 0 and not again:
            out.append(f'{{"n_words": "some", "size": "long", "quote": "{quote}"}}')
        else:
            out.append(f'Sure:\n```json\n{{"n_words": {n}, "size": "{"long" if n > 100 else "short"}", "quote": "{quote}\\> 1"}}\n```')
    return out


ANSWER = [H.Field("n_words", "long", low=0), H.Field("size", choices=("short", "long")), H.Field("quote", required=False)]


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents)
      SELECT doc_id, CASE WHEN n % 7 > 0 THEN n END AS n_words, CASE WHEN n % 7 > 0 THEN CASE WHEN n > 100 THEN 'long' ELSE 'short' END END AS size,
        CASE WHEN n % 7 > 0 THEN md5(replace(replace(substring(t, 1, 30), chr(34), ''), chr(92), '') || '\> 1') END AS quote,
        CASE WHEN n % 7 = 0 OR n % 3 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 7 = 0 THEN 'n_words: not a long' END AS error FROM d"""
)
def model_answers(spark, sf_dir):
    """Typed answers to a prompt per document, through the hook and a memo table of its own."""
    asked = Q.documents(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"))
    rows = H.ask(asked, reader_model, ANSWER, _own_folder(spark, "memo"), "documents")
    return rows.select("doc_id", "answer.n_words", "answer.size", F.md5(F.col("answer.quote").cast("binary")).alias("quote"), "attempts", "error")


# --- saved lexical index -------------------------------------------------------------


def _ranked_sql(index: str, asked: str, k: int) -> str:
    """CTEs up to full(field, topic_id, doc_id, score, rank) of idx(field, doc_id, t) and q(topic_id, field, text)."""
    return f"""idx AS ({index}), q AS ({asked}), size AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM idx GROUP BY field),
      terms AS (SELECT topic_id, field, term, count(*) AS qtf FROM (SELECT topic_id, field, unnest({O.tokens('text')}) AS term FROM q) GROUP BY ALL),
      tf AS (SELECT field, doc_id, dl, term, count(*) AS tf FROM (SELECT field, doc_id, len(t) AS dl, unnest(t) AS term FROM idx) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
      df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT tf.field, topic_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + {X.K1}::DOUBLE * (1 - {X.B}::DOUBLE + {X.B}::DOUBLE * dl / avgdl))), 6) AS score
        FROM tf JOIN df USING (field, term) JOIN size USING (field) JOIN terms USING (field, term) GROUP BY ALL),
      pairs AS (SELECT q.field, q.topic_id, d.doc_id, coalesce(score, 0) AS score FROM q JOIN (SELECT DISTINCT field, doc_id FROM idx) d ON d.field = q.field LEFT JOIN sc ON sc.field = q.field AND sc.topic_id = q.topic_id AND sc.doc_id = d.doc_id),
      full_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, topic_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM pairs) WHERE rank <= {k})"""


_ASKED = {
    "all": N._BROAD,
    "condition_title": N._sql_terms("[query]", "concepts"),
    "eligibility": N._sql_terms("[query]", N._OWN, "risks", "priorities"),
    "intervention": N._sql_terms("[query]", "priorities", "list_transform(given[1:8], lambda g: g.name)", "list_transform(marks[1:8], lambda b: b.name)"),
    "summary_description": N._BROAD,
}
_VIEWED = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, {O.tokens(N._sql_view(V.VIEWS[f]))} AS t FROM texts" for f in X.FIELD_WEIGHTS)


@query(
    f"""WITH {N.TEXTS}, {N.PROFILES}, p AS (SELECT profiles.*, text AS query, CASE WHEN topic_id % 2 = 0 THEN [lang] ELSE []::VARCHAR[] END AS concepts, CASE WHEN topic_id % 3 = 0 THEN ['recruiting phase2'] ELSE []::VARCHAR[] END AS priorities, ['web', ' '] AS risks
        FROM profiles JOIN (SELECT item_id AS topic_id, text, (['en', 'de', 'fr', 'es'])[(item_id % 4 + 1)::INT] AS lang FROM benchmark) USING (topic_id)),
      {_ranked_sql(_VIEWED, ' UNION ALL '.join(f"SELECT topic_id, '{f}' AS field, {e} AS text FROM p" for f, e in _ASKED.items()), 1000)}
      {O.fused(X.FIELD_WEIGHTS, 20, 'full_')}"""
)
def fielded_views_topk(spark, sf_dir):
    """Documents as trials, indexed by their views, searched with five query strings per patient and fused."""
    path = _own_folder(spark, "lexical")
    L.add(N.texts(spark, sf_dir), path, {f: V.trial_view(f) for f in X.FIELD_WEIGHTS})
    people = N.profiles(spark, sf_dir).join(Q.topics(spark, sf_dir).withColumnRenamed("text", "query"), "topic_id")
    none = F.array().cast("array<string>")
    lang = F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("topic_id") % 4).cast("int"))
    concepts = F.when(F.col("topic_id") % 2 == 0, F.array(lang)).otherwise(none)
    priorities = F.when(F.col("topic_id") % 3 == 0, F.array(F.lit("recruiting phase2"))).otherwise(none)
    asked = V.fielded_queries(F.col("query"), concepts, priorities, F.array(F.lit("web"), F.lit(" ")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), t.alias("text")) for f, t in asked.items()])
    queries = people.select("topic_id", F.inline(cells))
    return L.fielded_search(spark, path, queries, 20, 1000)


@query(
    f"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 'renewed ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3),
      {_ranked_sql(f"SELECT 'all' AS field, doc_id, {O.tokens('text')} AS t FROM now", "SELECT item_id AS topic_id, 'all' AS field, text FROM benchmark", 20)}
      SELECT topic_id, doc_id, score, rank FROM full_ WHERE score > 0"""
)
def lexical_update_topk(spark, sf_dir):
    """An index of all documents that then follows changed, new and removed ones, searched by all topics."""
    path = _own_folder(spark, "lexical")
    docs = Q.documents(spark, sf_dir)
    L.add(docs.where("doc_id % 13 <> 5"), path, {"all": F.col("text")}, block_rows=100_000)
    now = docs.where("doc_id % 11 <> 3")
    renewed = F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("renewed "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    L.update(now.withColumn("text", renewed), path, {"all": F.col("text")})
    queries = Q.topics(spark, sf_dir).select("topic_id", F.lit("all").alias("field"), "text")
    return L.search(spark, path, queries, 20).select("topic_id", "doc_id", "score", "rank")


# --- access by id ------------------------------------------------------------------


@query(
    r"""SELECT 'DOC' || doc_id AS nct_id, CASE WHEN doc_id % 30 = 0 THEN 'changed ' ELSE 'title ' END || doc_id AS title,
        md5(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[^\x21-\x7E]+', ' ', 'g')), ' +', ' ', 'g')) AS summary, coalesce(length(text), 0)::INT AS enrollment
      FROM documents WHERE doc_id % 20 = 0"""
)
def corpus_lookup(spark, sf_dir):
    """Documents as a registry dump whose files change once; every twentieth is looked up through the saved index."""
    folder = _own_folder(spark, "corpus")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7E]+", " "))

    def studies(rows, word):
        return rows.select(
            F.struct(F.concat(F.lit("DOC"), F.col("doc_id").cast("string")).alias("nct_id")).alias("id_info"),
            F.concat(F.lit(word), F.col("doc_id").cast("string")).alias("brief_title"),
            F.struct(text.alias("textblock")).alias("brief_summary"),
            F.coalesce(F.length("text"), F.lit(0)).alias("enrollment"),
        )

    def dump(rows, word, part):
        out = studies(rows, word).write.format("xml").option("rootTag", "studies").option("rowTag", "clinical_study")
        out.mode("overwrite").save(f"{folder}/dump/{part}")

    docs = Q.documents(spark, sf_dir)
    dump(docs.where("doc_id % 3 <> 0"), "title ", "a")
    dump(docs.where("doc_id % 3 = 0"), "title ", "b")
    C.refresh(spark, f"{folder}/dump", f"{folder}/index")
    dump(docs.where("doc_id % 3 = 0 and doc_id % 30 <> 0"), "title ", "b")
    dump(docs.where("doc_id % 30 = 0"), "changed ", "c")
    C.refresh(spark, f"{folder}/dump", f"{folder}/index")
    wanted = docs.where("doc_id % 20 = 0").select(F.concat(F.lit("DOC"), F.col("doc_id").cast("string")).alias("id"))
    found = C.look_up(spark, f"{folder}/index", wanted)
    return found.select("nct_id", "title", F.md5(F.col("brief_summary").cast("binary")).alias("summary"), "enrollment")


# --- manifests ---------------------------------------------------------------------

_KINDS = ("bm25", "bm25_fielded_rrf", "dense")


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 13 = 0 AS gone, o_custkey % 5 > 0 AS typed, o_custkey % 3 AS kind, o_orderdate::DATE < DATE '1997-01-01' AS dated, o_orderkey % 4 = 0 AS filtered,
        o_custkey % 2 = 0 AS hashed, o_custkey % 7 > 0 AS complete, o_custkey % 6 > 0 AS counted, o_custkey % 11 > 0 AS pathed, o_orderkey % 3 > 0 AS there FROM orders),
      r AS (SELECT k, CASE WHEN gone THEN ['missing_index_manifest'] ELSE list_filter([CASE WHEN NOT typed THEN 'invalid_manifest_type' END, CASE WHEN kind = 2 THEN 'unsupported_index_kind' END, CASE WHEN NOT dated THEN 'snapshot_date_mismatch' END,
          CASE WHEN filtered THEN 'destructive_filters_applied' END, CASE WHEN kind = 0 AND NOT hashed THEN 'missing_nct_ids_hash' END, CASE WHEN kind = 1 AND NOT complete THEN 'missing_fielded_subindices' END,
          CASE WHEN kind = 1 AND NOT there THEN 'missing_fielded_nct_ids' END, CASE WHEN kind = 1 AND NOT counted THEN 'fielded_doc_count_mismatch' END, CASE WHEN kind = 1 AND NOT hashed THEN 'missing_fielded_nct_ids_hash' END], lambda x: x IS NOT NULL) END AS i,
        CASE WHEN gone THEN ['missing_index_manifest'] WHEN NOT pathed THEN ['missing_corpus_manifest_path'] WHEN k % 8 = 0 THEN ['missing_or_invalid_corpus_manifest'] ELSE list_filter([CASE WHEN NOT typed THEN 'invalid_corpus_manifest_type' END,
          CASE WHEN NOT dated THEN 'corpus_snapshot_date_mismatch' END, CASE WHEN filtered THEN 'corpus_destructive_filters_applied' END, CASE WHEN NOT counted THEN 'corpus_index_doc_count_mismatch' END, CASE WHEN NOT hashed THEN 'missing_corpus_dir_in_manifest' END,
          CASE WHEN hashed AND NOT complete THEN 'agent_corpus_dir_mismatch' END, CASE WHEN NOT there THEN 'agent_corpus_dir_missing' END], lambda x: x IS NOT NULL) END AS c FROM o)
      SELECT k AS o_orderkey, array_to_string(i, ',') AS index_reasons, array_to_string(c, ',') AS corpus_reasons, coalesce(i[1], 'ok') AS verdict FROM r"""
)
def manifest_reasons(spark, sf_dir):
    """All reasons against a pair of manifests per order, whose faults follow its keys and date."""
    o = Q.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.when(F.to_date("o_orderdate") < "1997-01-01", X.SNAPSHOT_DATE).otherwise("2020-01-01")
    filters = F.when(k % 4 == 0, F.array(F.lit("harmless"), F.lit("sex_filter"))).otherwise(F.array(F.lit("harmless")))
    digest = F.when(c % 2 == 0, "d1")
    part = F.struct(F.when(c % 6 > 0, 5).otherwise(4).alias("doc_count"), digest.alias("nct_ids_sha256"))
    parts = F.struct(*[(F.when(c % 7 > 0, part) if f == X.INDEX_FIELDS[-1] else part).alias(f) for f in X.INDEX_FIELDS])
    kind = F.get(F.array(*map(F.lit, _KINDS)), (c % 3).cast("int"))
    index = F.to_json(
        F.struct(
            F.when(c % 5 > 0, M.INDEX_TYPE).otherwise("other").alias("manifest_type"), kind.alias("index_kind"), date.alias("snapshot_date"),
            filters.alias("filters_applied"), F.lit(5).alias("doc_count"), digest.alias("nct_ids_sha256"), parts.alias("subindices"),
            F.when(c % 11 > 0, "/m").alias("corpus_manifest_path"),
        )
    )
    told = F.to_json(
        F.struct(
            F.when(c % 5 > 0, M.CORPUS_TYPE).otherwise("other").alias("manifest_type"), date.alias("snapshot_date"), filters.alias("filters_applied"),
            F.when(c % 6 > 0, 5).otherwise(4).alias("doc_count"), F.when(c % 2 == 0, F.when(c % 7 > 0, "file:///data/a/").otherwise("/data/b")).alias("corpus_dir"),
        )
    )
    there = k % 3 > 0
    listed = F.when(there, F.array(*map(F.lit, X.INDEX_FIELDS))).otherwise(F.array(F.lit("none")))
    rows = o.select(
        "o_orderkey", listed.alias("listed"), there.alias("there"),
        M.parsed(F.when(c % 13 > 0, index)).alias("index"), M.parsed(F.when(k % 8 == 0, "{broken").otherwise(told)).alias("corpus"),
    )
    rows = rows.select(
        "o_orderkey",
        M.index_reasons(F.col("index"), F.col("listed")).alias("i"),
        M.alignment_reasons(F.col("index"), F.col("corpus"), F.lit("/data/./a"), F.col("there")).alias("c"),
    )
    return rows.select("o_orderkey", F.array_join("i", ",").alias("index_reasons"), F.array_join("c", ",").alias("corpus_reasons"), M.verdict(F.col("i")).alias("verdict"))


@query(
    """WITH i AS (SELECT * FROM documents WHERE lang <> 'fr' AND doc_id % 10 <> 3 UNION ALL SELECT * FROM documents WHERE lang = 'de'),
      s AS (SELECT coalesce(lang, '') AS lang, count(*) AS n, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT::HUGEINT) AS d FROM documents GROUP BY ALL),
      t AS (SELECT coalesce(lang, '') AS lang, count(*) AS n, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT::HUGEINT) AS d FROM i GROUP BY ALL)
      SELECT lang, s.n AS corpus_count, coalesce(t.n, 0) AS index_count, array_to_string(list_filter([CASE WHEN t.n IS NULL THEN 'not_indexed' END, CASE WHEN t.n IS DISTINCT FROM s.n THEN 'doc_count_mismatch' END,
        CASE WHEN t.d IS DISTINCT FROM s.d THEN 'ids_digest_mismatch' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s LEFT JOIN t USING (lang)"""
)
def corpus_drift(spark, sf_dir):
    """Documents against an index that lacks some, by language."""
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    index = docs.where("lang <> 'fr' and doc_id % 10 <> 3").unionAll(docs.where("lang = 'de'"))
    rows = M.drift(docs, index, "doc_id", "lang")
    return rows.select("lang", "corpus_count", "index_count", F.array_join("reasons", ",").alias("reasons"))
