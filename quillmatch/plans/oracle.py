"""The registered queries as DuckDB SQL, written apart from the DataFrame plans."""

from __future__ import annotations

from quillmatch.functions import fixed as X


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _case(key: str, values: dict, default) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


QRELS = """qrels AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic <> 1 THEN 2 WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END AS grade FROM labels)"""

TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[\p{{{{L}}}}\p{{{{N}}}}_]{{{{2,}}}}'), lambda x: x NOT IN {_in(X.INDEX_STOPWORDS)})"


def tokens(expression: str) -> str:
    return TOKENS.format(expression).replace("{{", "{").replace("}}", "}")


VIEWS = {
    "all": "coalesce(text, '')",
    "condition_title": "split(coalesce(text, ''), chr(10))[1]",
    "eligibility": "split(coalesce(text, ''), chr(10))[-1]",
    "intervention": "array_to_string(split(coalesce(text, ''), chr(10))[2:-2], chr(10))",
    "summary_description": "array_to_string(split(coalesce(text, ''), chr(10))[1:3], chr(10))",
}


def bm25(fields, k: int) -> str:
    """CTEs up to run(field, topic_id, doc_id, score, rank)."""
    index = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, {tokens(VIEWS[f])} AS t FROM documents" for f in fields)
    return f"""idx AS (SELECT * FROM ({index})),
      size AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM idx GROUP BY field),
      terms AS (SELECT topic_id, term, count(*) AS qtf FROM (SELECT item_id AS topic_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
      tf AS (SELECT field, doc_id, dl, term, count(*) AS tf FROM (SELECT field, doc_id, len(t) AS dl, unnest(t) AS term FROM idx) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
      df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT tf.field, topic_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + {X.K1}::DOUBLE * (1 - {X.B}::DOUBLE + {X.B}::DOUBLE * dl / avgdl))), 6) AS score
        FROM tf JOIN df USING (field, term) JOIN size USING (field) JOIN terms USING (term) GROUP BY ALL),
      run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, topic_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc) WHERE rank <= {k})"""


def fused(weights: dict, k: int, source: str = "run", name: str = "field") -> str:
    w = _case(name, weights, 0)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM (
        SELECT topic_id, doc_id, round(sum({w} / ({X.RRF_K} + rank)), 6) AS score, count(*) AS n_runs FROM {source} WHERE {w} > 0 GROUP BY ALL)) WHERE rank <= {k}"""


COSINE = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]) * list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]))"


def dense(where: str, k: int, asked: str = "q.vec_id % 20 = 0") -> str:
    return f"""SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, round({COSINE.format('q.embedding', 'v.embedding')}, 6) AS score
        FROM embeddings v, embeddings q WHERE {asked} AND {where})) WHERE rank <= {k}"""


TYPES = "CASE l_linenumber % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'age' WHEN 2 THEN 'sex' WHEN 3 THEN 'biomarker' WHEN 4 THEN 'lab' WHEN 5 THEN 'diagnosis' ELSE 'comorbidity' END"


def _evals(topic: str, by: str) -> str:
    return f"""evals AS (SELECT * EXCLUDE (rn) FROM (SELECT {topic} l_orderkey AS trial, l_linenumber AS criterion,
        CASE l_linestatus WHEN 'O' THEN 'inclusion' ELSE 'exclusion' END AS polarity,
        CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'NEI' ELSE 'not_met' END AS label,
        l_discount * 10 AS confidence, l_quantity >= 10 AS mandatory, {TYPES} AS type,
        row_number() OVER (PARTITION BY {by} l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1)"""


#: Evaluations of each topic, and criteria whatever the topic.
EVALS, PLAIN = _evals("l_suppkey % 2 AS topic_id,", "l_suppkey % 2,"), _evals("", "")
COUNTS = """counts AS (SELECT *, (inc_nei + exc_nei)::DOUBLE / (n_inc + n_exc) AS fraction_nei FROM (SELECT topic_id, trial,
        count(*) FILTER (polarity = 'inclusion') AS n_inc, count(*) FILTER (polarity = 'exclusion') AS n_exc,
        count(*) FILTER (polarity = 'inclusion' AND label = 'met') AS inc_met, count(*) FILTER (polarity = 'inclusion' AND label = 'not_met') AS inc_not,
        count(*) FILTER (polarity = 'inclusion' AND label = 'NEI') AS inc_nei, count(*) FILTER (polarity = 'exclusion' AND label = 'met') AS exc_met,
        count(*) FILTER (polarity = 'exclusion' AND label = 'not_met') AS exc_not, count(*) FILTER (polarity = 'exclusion' AND label = 'NEI') AS exc_nei,
        bool_or(polarity = 'inclusion' AND label = 'not_met' AND mandatory) AS mandatory_failed, avg(confidence) AS avg_confidence FROM evals GROUP BY topic_id, trial))"""


def label(mode: str, irrelevance: bool = False) -> str:
    share, most = X.LABEL_POLICY[mode]
    first = "WHEN n_inc > 0 AND inc_met <= 0 AND fraction_nei >= 0.8 AND exc_met = 0 THEN 'irrelevant'" if irrelevance else ""
    return f"""CASE {first} WHEN exc_met > 0 OR mandatory_failed THEN 'excludes' WHEN n_inc > 0 AND inc_met = n_inc THEN 'eligible'
        WHEN inc_met >= greatest(1, trunc({share}::DOUBLE * n_inc)) AND fraction_nei < {most} THEN 'eligible' ELSE 'excludes' END"""


def grade(expression: str) -> str:
    return f"CASE {expression} WHEN 'eligible' THEN 2 WHEN 'excludes' THEN 1 ELSE 0 END"


ELIG = """least(1, greatest(0, (CASE WHEN n_inc > 0 THEN inc_met::DOUBLE / n_inc ELSE 0 END + CASE WHEN n_exc > 0 THEN exc_not::DOUBLE / n_exc ELSE 1 END
        - CASE WHEN n_inc > 0 THEN inc_not::DOUBLE / n_inc ELSE 0 END) / 2 * (1 - 0.5::DOUBLE * fraction_nei)))::DOUBLE"""
TRIALS = """trials AS (SELECT o_orderkey AS trial, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RECRUITING' ELSE 'ACTIVE_NOT_RECRUITING' END AS status,
        CASE o_orderpriority[1] WHEN '1' THEN 'PHASE1' WHEN '2' THEN 'PHASE2' WHEN '3' THEN 'PHASE3' WHEN '4' THEN 'PHASE4' ELSE 'NA' END AS phase, o_orderdate::DATE AS updated FROM orders)"""


def score(mode: str, soft: bool) -> str:
    w = X.SCORE_WEIGHTS
    days = "date_diff('day', updated, DATE '2001-08-01')"
    base = f"""({w['eligibility']} * {ELIG} + {w['recruiting']} * {_case('status', X.STATUS_BONUS[mode], 0)} + {w['phase']} * {_case('phase', X.PHASE_PRIORITY, 0.5)}
        + {w['recency']} * CASE WHEN {days} <= 0 THEN 1 ELSE 1 / (1 + ln(1 + {days} / 365.0::DOUBLE)) END
        + {w['retrieval']} * (trial % 100)::DOUBLE / 100 - {w['nei']} * fraction_nei) * (0.5::DOUBLE * avg_confidence + 0.5::DOUBLE)"""
    sunk = f"{base} - {w['soft_veto']}" if soft else f"-1 + {w['veto_tie']}::DOUBLE * (trial % 100)::DOUBLE / 100"
    return f"""WITH {EVALS}, {COUNTS}, {TRIALS} SELECT topic_id, trial, round(CASE WHEN exc_met > 0 OR mandatory_failed THEN {sunk} ELSE {base} END, 6)::DOUBLE AS score
        FROM counts JOIN trials USING (trial)"""


def evidence() -> str:
    w = f"({_case('type', X.EVIDENCE_WEIGHTS, 0.8)} * CASE WHEN mandatory THEN 1 ELSE 0.65::DOUBLE END)"
    total = lambda cond, share="1": f"coalesce(sum({w} * {share}) FILTER ({cond}), 0)"
    inc, exc, sub, sure = "polarity = 'inclusion'", "polarity = 'exclusion'", f"type NOT IN {_in(X.NOT_SUBSTANTIVE)}", "least(1, greatest(0, confidence))"
    over = lambda a, b, empty=0: f"CASE WHEN {b} > 0 THEN least(1, {a} / {b}) ELSE {empty} END::DOUBLE"
    return f"""WITH {EVALS}, {COUNTS}, sums AS (SELECT topic_id, trial, {total(inc)} AS it, {total(exc)} AS et, {total(f"{inc} AND {sub}")} AS st,
        {total(f"{inc} AND label = 'met'", sure)} AS im, {total(f"{inc} AND {sub} AND label = 'met'", sure)} AS sm, {total(f"{inc} AND label = 'not_met'", sure)} AS inf,
        {total(f"{inc} AND label = 'NEI' AND mandatory", '0.75::DOUBLE')} AS rq, {total(f"{inc} AND label = 'NEI'", 'CASE WHEN mandatory THEN 0.75::DOUBLE ELSE 0.45::DOUBLE END')} AS ms, {total(f"{exc} AND label = 'not_met'", sure)} AS ec, {total(f"{exc} AND label = 'met'", sure)} AS eh,
        {total(f"{exc} AND label = 'NEI'", 'CASE WHEN mandatory THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END')} AS eu FROM evals GROUP BY topic_id, trial),
      parts AS (SELECT topic_id, trial, {over('im', 'it')} AS a, {over('sm', 'st')} AS b, {over('inf', 'it')} AS c, {over('ms', 'it')} AS miss, {over('ec', 'et', 1)} AS d, {over('eh', 'et')} AS e, {over('eu', 'et')} AS f,
        least(1, rq / greatest(it + 0.45::DOUBLE * et, 1e-9))::DOUBLE AS g FROM sums),
      thin AS (SELECT p.*, fraction_nei, CASE WHEN {label('benchmark')} = 'eligible' THEN CASE WHEN n_inc = 0 OR inc_met = 0 THEN 0.12::DOUBLE WHEN inc_met <= 1 AND b < 0.35::DOUBLE THEN 0.10::DOUBLE
        WHEN inc_met <= 1 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN fraction_nei >= 0.65::DOUBLE THEN 0.04::DOUBLE ELSE 0 END ELSE 0 END::DOUBLE AS t FROM parts p JOIN counts USING (topic_id, trial))
      SELECT topic_id, trial, round(a + 1e-9, 6) AS inclusion_support, round(b + 1e-9, 6) AS substantive_support, round(c + 1e-9, 6) AS inclusion_failure, round(miss + 1e-9, 6) AS inclusion_missing, round(d + 1e-9, 6) AS exclusion_clear, round(e + 1e-9, 6) AS exclusion_penalty,
        round(f + 1e-9, 6) AS exclusion_unknown, round(g + 1e-9, 6) AS missing_required, round(t + 1e-9, 6) AS thin,
        round(least(1, greatest(0, 0.38 * a + 0.30 * b + 0.12 * d + 0.10 * (1 - fraction_nei) - 0.45 * c - 0.72 * e - 0.06 * f - 0.42 * g - t)) + 1e-9, 6)::DOUBLE AS evidence FROM thin"""


def metrics(linear: bool, run: str = "run", before: str = "") -> str:
    gain = (lambda g: f"{g}::DOUBLE") if linear else (lambda g: f"(pow(2, {g}) - 1)")
    return f"""WITH {QRELS}, {before or bm25(['all'], 20)},
      best AS (SELECT sum({gain('grade')} / log2(i + 1)) AS ideal FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, doc_id) AS i FROM qrels) WHERE i <= 10),
      total AS (SELECT count(*) AS relevant FROM qrels WHERE grade > 0),
      j AS (SELECT {run}.*, coalesce(grade, 0) AS g, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id ORDER BY rank) AS hits FROM {run} LEFT JOIN qrels USING (doc_id))
      SELECT topic_id, round(coalesce(sum(CASE WHEN rank <= 10 THEN {gain('g')} / log2(rank + 1) END) / (SELECT ideal FROM best), 0), 6) AS ndcg10,
        round(count(*) FILTER (g > 0 AND rank <= 10) / 10, 6) AS p10, round(coalesce(count(*) FILTER (g > 0 AND rank <= 20) / (SELECT relevant FROM total), 0), 6) AS recall20,
        round(coalesce(max(CASE WHEN g > 0 THEN 1 / rank END), 0), 6)::DOUBLE AS rr, round(coalesce(sum(CASE WHEN g > 0 THEN hits / rank END) / (SELECT relevant FROM total), 0), 6)::DOUBLE AS ap FROM j GROUP BY topic_id"""


PAIRS = f"""{EVALS}, {COUNTS}, pairs AS (SELECT topic_id, trial, {grade(label('benchmark', True))} AS gold, {grade(label('clinical', True))} AS predicted,
        {ELIG} AS score, exc_met > 0 OR mandatory_failed AS veto FROM counts)"""


def classes(source: str, by: str = "") -> str:
    return f"""SELECT {by} c AS class, count(*) FILTER (gold = c AND predicted = c) AS tp, count(*) FILTER (gold <> c AND predicted = c) AS fp,
        count(*) FILTER (gold = c AND predicted <> c) AS fn FROM {source}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY ALL"""


def rates(source: str, by: str = "") -> str:
    z = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0), 6)::DOUBLE"
    return f"SELECT {by} class, tp, fp, fn, {z('tp', '(tp + fp)')} AS precision, {z('tp', '(tp + fn)')} AS recall, {z('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM ({source})"


MEANS = "round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6)::DOUBLE AS micro_f1, round(avg(f1), 6) AS macro_f1"

NOTE = """(CASE (conv_id + turn) % 6 WHEN 0 THEN 'No evidence of ' WHEN 1 THEN 'within the past 6 months ' WHEN 2 THEN 'history of '
        WHEN 3 THEN 'at least 3 weeks since ' WHEN 4 THEN 'currently ' ELSE 'without ' END || coalesce(text, ''))"""


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def temporal() -> str:
    rel = " ".join(f"WHEN regexp_matches(note, '(?i){_re(p)}') THEN '{name}'" for p, name, _ in X.TEMPORAL)
    unit = lambda p: "CASE lower(regexp_extract(note, '(?i)" + _re(p) + "', 2)) " + " ".join(f"WHEN '{u}' THEN {n}" for u, n in X.UNIT_DAYS.items()) + " END"
    days = " ".join(
        f"WHEN regexp_matches(note, '(?i){_re(p)}') THEN " + (f"regexp_extract(note, '(?i){_re(p)}', 1)::BIGINT * {unit(p)}" if counted else "NULL::BIGINT")
        for p, _, counted in X.TEMPORAL
    )
    return f"SELECT conv_id, turn, CASE {rel} END AS relation, CASE {days} END AS days FROM (SELECT conv_id, turn, {NOTE} AS note FROM conversations)"


def annotated() -> str:
    out = "note"
    for p, _, _ in X.TEMPORAL:
        out = f"regexp_replace({out}, '(?i)({_re(p)})', '[TEMPORAL: \\1]', 'g')"
    return f"SELECT conv_id, turn, md5({out}) AS digest FROM (SELECT conv_id, turn, {NOTE} AS note FROM conversations)"


STEM = r"""(CASE WHEN length(b) > 4 AND b LIKE '%ies' THEN b[:-4] || 'y' WHEN length(b) > 4 AND b LIKE '%s' AND b NOT LIKE '%ss' THEN b[:-2] ELSE b END)"""
BARE = r"regexp_replace({}, '^[-_.,;:()\[\]{{}}]+|[-_.,;:()\[\]{{}}]+$', '', 'g')"


def stems(expression: str) -> str:
    bare = BARE.format("x")
    return f"list_filter(list_transform(list_transform(regexp_extract_all(lower(coalesce({expression}, '')), '{X.ENTITY_TOKEN}'), lambda x: {bare}), lambda b: {STEM}), lambda t: t <> '')"


def terms(expression: str, generic: bool) -> str:
    drop = X.ENTITY_STOPWORDS + (X.GENERIC_TERMS if generic else [])
    return f"list_distinct(list_filter({stems(expression)}, lambda t: t NOT IN {_in(drop)}))"


def chosen(expression: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({expression}, '')), '{X.SELECTION_TOKEN}'), lambda t: t NOT IN {_in(X.SELECTION_STOPWORDS)}))"


def negated() -> str:
    return f"""WITH s AS (SELECT conv_id, turn, i, {stems('sentence')} AS t FROM (SELECT conv_id, turn, unnest(string_split_regex({NOTE}, '{X.SENTENCE_END}')) AS sentence, generate_subscripts(string_split_regex({NOTE}, '{X.SENTENCE_END}'), 1) AS i FROM conversations)),
      w AS (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS k FROM s),
      c AS (SELECT conv_id, turn, CASE WHEN t[k] || ' ' || coalesce(t[k + 1], '') IN {_in(X.NEGATION_BIGRAMS)} THEN t[k + 2:k + 8] WHEN t[k] IN {_in(X.NEGATION_CUES)} THEN t[k + 1:k + 7] END AS x FROM w),
      f AS (SELECT DISTINCT conv_id, turn, unnest(x) AS term FROM c),
      g AS (SELECT conv_id, turn, string_agg(term, ' ' ORDER BY term) AS terms FROM f WHERE term NOT IN {_in(X.ENTITY_STOPWORDS + X.GENERIC_TERMS)} GROUP BY ALL)
      SELECT conv_id, turn, coalesce(terms, '') AS terms FROM conversations LEFT JOIN g USING (conv_id, turn)"""


SPLIT_TEXT = r"""(CASE doc_id % 4 WHEN 0 THEN 'Inclusion Criteria: ' || split(coalesce(text, ''), chr(10))[1] || ' EXCLUSION criteria ' || array_to_string(split(coalesce(text, ''), chr(10))[2:], chr(10))
        WHEN 1 THEN 'Inclusion Criteria: ' || text WHEN 2 THEN text || ' exclusion criteria: x y' ELSE text END)"""
SPLIT = rf"""WITH a AS (SELECT doc_id, t, regexp_extract(t, '(?is)inclusion\s*criteria\s*:?') AS im, regexp_extract(t, '(?is)exclusion\s*criteria\s*:?') AS em FROM (SELECT doc_id, coalesce({SPLIT_TEXT}, '') AS t FROM documents)),
      b AS (SELECT *, CASE WHEN im <> '' THEN strpos(t, im) END AS i, CASE WHEN em <> '' THEN strpos(t, em) END AS e FROM a)
      SELECT doc_id, md5(regexp_replace(CASE WHEN i < e THEN substr(t, i + length(im), e - i - length(im)) WHEN i IS NOT NULL AND e IS NULL THEN substr(t, i + length(im)) WHEN i IS NULL AND e IS NOT NULL THEN substr(t, 1, e - 1) ELSE t END, '^\s+|\s+$', '', 'g')) AS inclusion,
        md5(CASE WHEN i < e OR (i IS NULL AND e IS NOT NULL) THEN regexp_replace(substr(t, e + length(em)), '^\s+|\s+$', '', 'g') ELSE '' END) AS exclusion FROM b"""

PHASE_TEXT = "CASE p_size % 8 WHEN 0 THEN 'Phase 1' WHEN 1 THEN 'phase 2/phase 3' WHEN 2 THEN 'PHASE3' WHEN 3 THEN 'Early Phase 1' WHEN 4 THEN 'Phase 1/Phase 2' WHEN 5 THEN 'N/A' WHEN 6 THEN '' ELSE 'Phase 4' END"


def phases() -> str:
    j = "replace(replace(upper(trim(t)), 'PHASE ', 'PHASE'), '/', '_')"
    x = "replace(replace(upper(t), ' ', ''), '/', '_')"
    near = " ".join(f"WHEN contains(j, '{p}') OR contains('{p}', j) THEN '{p}'" for p in X.PHASES)
    has = " ".join(f"WHEN contains(x, '{p}') THEN '{p}'" for p in X.PHASES)
    return f"""SELECT p_partkey, CASE WHEN j = '' THEN 'NA' WHEN j IN {_in(X.PHASES)} THEN j {near} ELSE 'NA' END AS json_phase,
        CASE WHEN contains(x, 'EARLY') AND contains(x, '1') THEN 'EARLY_PHASE1' WHEN contains(x, 'PHASE1') AND contains(x, 'PHASE2') THEN 'PHASE1_PHASE2'
        WHEN contains(x, 'PHASE2') AND contains(x, 'PHASE3') THEN 'PHASE2_PHASE3' {has} ELSE 'NA' END AS xml_phase FROM (SELECT p_partkey, {j} AS j, {x} AS x FROM (SELECT p_partkey, {PHASE_TEXT} AS t FROM part))"""


PEOPLE = """people AS (SELECT p_partkey AS topic_id, CASE WHEN p_partkey % 9 > 0 THEN p_size::DOUBLE END AS age, ['male', 'female', 'unknown'][p_partkey % 3 + 1] AS own FROM part)"""
STUDIES = f"""{TRIALS}, studies AS (SELECT trial, status, CASE trial % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' ELSE 'ALL' END AS sex, CASE WHEN trial % 7 > 0 THEN trial % 40 END AS low, CASE WHEN trial % 5 > 0 THEN trial % 40 + 15 END AS high FROM trials)"""
HARD = f"""WITH {STUDIES}, {PEOPLE}, r AS (SELECT topic_id, topic_id AS trial, CASE WHEN status IS NULL THEN 'trial not found in corpus'
        WHEN age * 365 < low * 365 OR age * 365 > high * 365 THEN 'age ' || age || ' outside [' || coalesce(low || ' Years', 'None') || ', ' || coalesce(high || ' Years', 'None') || ']'
        WHEN sex <> 'ALL' AND own <> 'unknown' AND upper(own) <> sex THEN 'sex ' || own || ' vs trial ' || sex
        WHEN status NOT IN {_in(X.ACTIVE_STATUSES)} THEN 'status ' || status || ' not in [''ENROLLING_BY_INVITATION'', ''NOT_YET_RECRUITING'', ''RECRUITING'']' END AS excluded_reason FROM people LEFT JOIN studies ON trial = topic_id)
      SELECT *, excluded_reason IS NOT NULL AS hard_excluded FROM r"""


def features() -> str:
    both = "len(list_intersect(q, d))"
    return f"""WITH {bm25(['all'], 20)}, d AS (SELECT doc_id, {terms('text', False)} AS d FROM documents WHERE doc_id IN (SELECT doc_id FROM run)), q AS (SELECT item_id AS topic_id, {terms('text', False)} AS q FROM benchmark)
      SELECT topic_id, doc_id, round(CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE least(1, {both} / sqrt(len(q)::DOUBLE * len(d))) END, 6)::DOUBLE AS cosine,
        round(CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE {both} / (len(q) + len(d) - {both}) END, 6)::DOUBLE AS jaccard,
        round(CASE WHEN len(q) = 0 THEN 0.5 ELSE least(1, {both} / greatest(1, least(8, len(q)))) END, 6)::DOUBLE AS support FROM run JOIN d USING (doc_id) JOIN q USING (topic_id)"""


def mmr(keep: int, total: int) -> str:
    both = lambda a, b: f"len(list_intersect({a}, {b}))"
    jac = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {both(a, b)}::DOUBLE / (len({a}) + len({b}) - {both(a, b)}) END"
    return f"""WITH RECURSIVE {bm25(['all'], 20)}, d AS (SELECT doc_id, {chosen('text')} AS d FROM documents WHERE doc_id IN (SELECT doc_id FROM run)), q AS (SELECT item_id AS topic_id, {chosen('text')} AS q FROM benchmark),
      norm AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN n = 1 THEN 1 ELSE 1 - (rank - 1) / (n - 1) END AS nm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM run WINDOW w AS (PARTITION BY topic_id))),
      p AS (SELECT topic_id, doc_id, score, rank, d, 0.7::DOUBLE * nm + 0.2::DOUBLE * CASE WHEN len(q) = 0 THEN 0.5::DOUBLE ELSE least(1, {both('d', 'q')} / greatest(1, least(8, len(q)))) END AS base FROM norm JOIN d USING (doc_id) JOIN q USING (topic_id)),
      pairs AS (SELECT a.topic_id, a.doc_id AS x, b.doc_id AS y, {jac('a.d', 'b.d')} AS j FROM p a JOIN p b ON a.topic_id = b.topic_id),
      sel AS (SELECT topic_id, {keep} AS step, list(doc_id ORDER BY rank) AS ids FROM p WHERE rank <= {keep} GROUP BY topic_id
        UNION ALL SELECT topic_id, step + 1, list_append(ids, best) FROM (SELECT s.topic_id, s.step, s.ids,
          (SELECT p.doc_id FROM p WHERE p.topic_id = s.topic_id AND NOT list_contains(s.ids, p.doc_id)
            ORDER BY round(p.base + 0.1::DOUBLE * (1 - (SELECT max(j) FROM pairs WHERE pairs.topic_id = s.topic_id AND x = p.doc_id AND list_contains(s.ids, y))), 9) DESC, p.score DESC, p.rank, p.doc_id DESC LIMIT 1) AS best
          FROM sel s WHERE s.step < {total}) WHERE best IS NOT NULL)
      SELECT topic_id, unnest(ids) AS doc_id, unnest(range(1, len(ids) + 1))::INTEGER AS place FROM sel QUALIFY step = max(step) OVER (PARTITION BY topic_id)"""


CRITERIA = (
    "Age 18 years or older", "Male or female", "ECOG performance status 0-1", "HER2 positive by IHC", "Prior chemotherapy within 4 weeks",
    "Adequate organ function", "Pregnant or breast-feeding women", "Active HIV infection", "Histologically confirmed melanoma",
    "Able to give informed consent", "Radiotherapy:", "See Disease Characteristics", "Inclusion Criteria:", "Creatinine < 1.5 mg/dL:",
    "Likes long walks", "- Platelets >= 100,000", "For control participants", "EGFR mutation or normal eGFR", "", "Arm 1:",
)
CRITERION = "crit AS (SELECT p_partkey, (['" + "', '".join(CRITERIA) + f"'])[((p_partkey * 7 + p_size) % {len(CRITERIA)} + 1)::INT] AS t FROM part)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _bare(t: str) -> str:
    return rf"regexp_replace({_STRIP.format(t)}, '^\s*(?:[-*•·]|\d+\.)\s*', '')"


def _low(t: str) -> str:
    return _STRIP.format(f"regexp_replace(lower({_bare(t)}), ':+$', '')")


def _hit(t: str, patterns) -> str:
    return "regexp_matches(" + t + ", '" + "|".join(f"(?:{_re(p)})" for p in patterns) + "')"


def header(t: str) -> str:
    short = f"({_bare(t)} LIKE '%:' AND len(regexp_extract_all({_low(t)}, '{X.HEADER_WORD}')) <= 8 AND NOT regexp_matches({_low(t)}, '{X.HEADER_NOT}'))"
    return f"({_bare(t)} <> '' AND ({_low(t)} IN {_in(X.HEADER_HINTS)} OR {_hit(_low(t), X.HEADER_REFERENCES)} OR {short}))"


def typed() -> str:
    cases = " ".join(f"WHEN {_hit('low', p)} THEN '{name}'" for name, p in X.CRITERION_TYPES)
    return f"WITH {CRITERION} SELECT p_partkey, CASE WHEN {header('t')} THEN 'section_header' {cases} ELSE 'other' END AS type FROM (SELECT *, ' ' || lower(t) || ' ' AS low FROM crit)"


def asked(t: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({t}), '{h}')" for h in hints) + f" THEN '{name}'" for name, hints in X.QUESTION_HINTS) + " ELSE 'text' END"


SEGMENTS = f"""WITH l AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN '- ' || x WHEN 2 THEN ' ' WHEN 3 THEN 'Organ function:' ELSE x END AS raw
        FROM (SELECT doc_id, unnest(split(coalesce(text, ''), chr(10))) AS x, unnest(range(0, len(split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
      k AS (SELECT doc_id, i, {_STRIP.format('raw')} AS line FROM l),
      j AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{X.BULLET}') THEN 'bullet' WHEN {header('line')} THEN 'header' ELSE 'more' END AS kind FROM k),
      b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM j),
      c AS (SELECT *, sum(CASE WHEN kind IN ('bullet', 'header') OR before IS NULL OR before IN ('blank', 'header') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS n FROM b WHERE kind <> 'blank')
      SELECT doc_id, n, md5(string_agg(CASE kind WHEN 'bullet' THEN {_STRIP.format(f"regexp_extract(line, '{X.BULLET}', 1)")} ELSE line END, ' ' ORDER BY i)) AS digest FROM c GROUP BY ALL"""

RUBRIC = f"""WITH {CRITERION}, q AS (SELECT p_partkey, 'Can you confirm the status of: ' || t || CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE '' END AS text, CASE WHEN p_partkey % 2 = 0 THEN t ELSE '' END AS point,
        p_partkey % 5 = 0 AS timed, {asked('t')} AS kind, CASE WHEN p_partkey % 4 > 0 THEN 'The trial needs it: ' || t ELSE '' END AS why FROM crit),
      s AS (SELECT p_partkey, CASE WHEN length(point) > 3 THEN 2 WHEN point <> '' THEN 1 ELSE 0 END::DOUBLE AS specific, CASE WHEN timed THEN 2 WHEN contains(lower(text), 'within') THEN 1 ELSE 0 END::DOUBLE AS temporal,
        CASE WHEN kind <> 'text' THEN 2 ELSE 1 END::DOUBLE AS format, CASE WHEN contains(lower(why), 'trial') AND length(why) > 30 THEN 2 WHEN why <> '' THEN 1 ELSE 0 END::DOUBLE AS rationale_score,
        CASE WHEN len(regexp_extract_all(text, '\\S+')) BETWEEN 5 AND 60 AND contains(text, '?') THEN 2 ELSE 1 END::DOUBLE AS actionable FROM q)
      SELECT *, (specific + temporal + format + rationale_score + actionable) / 10 AS normalized FROM s"""

ERRORS = f"""WITH {EVALS}, {COUNTS}, e AS (SELECT *, trial % 3 AS gold, {grade(label('benchmark'))} AS predicted, trial % 2 = 0 AS judged, exc_met > 0 OR mandatory_failed AS veto, (trial % 10)::DOUBLE / 10 AS prior, {ELIG} AS score FROM counts),
      x AS (SELECT list_filter([CASE WHEN gold = 0 AND predicted > 0 THEN 'retrieval_false_positive' END, CASE WHEN gold = 0 AND predicted > 0 AND judged THEN 'retrieval_false_positive_judged' END,
        CASE WHEN gold = 0 AND predicted > 0 AND NOT judged THEN 'retrieval_false_positive_unjudged' END, CASE WHEN gold = 2 AND predicted < 2 THEN 'missed_gold_eligible' END,
        CASE WHEN gold < 2 AND predicted = 2 THEN 'overcalled_eligible' END, CASE WHEN gold = 1 AND predicted <> 1 THEN 'missed_excludes' END,
        CASE WHEN gold = 2 AND predicted < 2 AND (veto OR score <= -0.99) THEN 'hard_veto_gold_eligible' END, CASE WHEN gold = 2 AND predicted < 2 AND exc_met > 0 THEN 'exclusion_met_gold_eligible' END,
        CASE WHEN gold = 2 AND predicted < 2 AND n_inc > 0 AND inc_met::DOUBLE / n_inc < 0.6::DOUBLE THEN 'low_inclusion_support_gold_eligible' END,
        CASE WHEN gold = 2 AND predicted < 2 AND fraction_nei >= 0.6::DOUBLE THEN 'high_nei_gold_eligible' END, CASE WHEN prior < 0.25::DOUBLE THEN 'low_retrieval_prior' END], lambda c: c IS NOT NULL) AS c FROM e WHERE gold <> predicted)
      SELECT category, count(*) AS n FROM (SELECT unnest(CASE WHEN len(c) = 0 THEN ['generic_disagreement'] ELSE c END) AS category FROM x) GROUP BY ALL"""

FLAGS = f"""WITH {EVALS}, {COUNTS}, {TRIALS} SELECT topic_id, trial, array_to_string(list_filter([CASE WHEN fraction_nei >= 0.4::DOUBLE THEN 'warning:data_quality' END, CASE WHEN mandatory_failed THEN 'critical:eligibility_mandatory' END,
        CASE WHEN exc_met > 0 THEN 'critical:eligibility_exclusion' END, CASE WHEN trial % 4 = 0 THEN 'warning:geographic' END, CASE WHEN status NOT IN ('RECRUITING', 'NOT_YET_RECRUITING') THEN 'warning:trial_status' END], lambda c: c IS NOT NULL), ',') AS flags
      FROM counts JOIN trials USING (trial)"""

ALIASES = "(VALUES " + ", ".join("('" + a.replace("'", "''") + f"', '{name}')" for name, aliases in X.COUNTRIES.items() for a in aliases) + ") AS known(alias, country)"
GEOGRAPHY = f"""WITH n AS (SELECT *, country FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN {ALIASES} ON alias = lower(n_name)),
      p AS (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN r_name WHEN 1 THEN r_name || ' city' ELSE n_name END) AS home FROM customer JOIN n ON c_nationkey = n_nationkey),
      h AS (SELECT p.*, known.country FROM p LEFT JOIN {ALIASES} ON alias = home),
      s AS (SELECT c_custkey, s.n_nationkey, CASE WHEN s.country = h.country THEN 1 WHEN contains(lower(s.r_name), home) THEN 0.7 WHEN contains(home, lower(s.r_name)) THEN 0.5 ELSE 0 END::DOUBLE AS score FROM h JOIN n s ON c_custkey % 5 = s.n_regionkey)
      SELECT c_custkey, coalesce(min_by(score, n_nationkey) FILTER (score > 0), 0)::DOUBLE AS score FROM s GROUP BY c_custkey"""


BLEND = f"""{bm25(['all'], 50)}, r AS (SELECT *, ((doc_id * 7919 + topic_id * 31) % 1000)::DOUBLE AS ce FROM run),
      n AS (SELECT *, min(ce) OVER w AS l1, max(ce) OVER w AS h1, min(score) OVER w AS l2, max(score) OVER w AS h2, count(*) OVER w AS n, row_number() OVER (PARTITION BY topic_id ORDER BY rank, doc_id) - 1 AS i FROM r WINDOW w AS (PARTITION BY topic_id)),
      v AS (SELECT topic_id, doc_id, rank AS old_rank, CASE WHEN h1 > l1 THEN (ce - l1) / (h1 - l1) WHEN n = 1 THEN 1 ELSE 1 - i / (n - 1) END AS a, CASE WHEN h2 > l2 THEN (score - l2) / (h2 - l2) WHEN n = 1 THEN 1 ELSE 1 - i / (n - 1) END AS b FROM n),
      s AS (SELECT topic_id, doc_id, round(0.7::DOUBLE * a + 0.3::DOUBLE * b, 6) AS blended, old_rank FROM v),
      blend AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY blended DESC, old_rank, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 20)"""


def triage() -> str:
    polar, low = "CASE WHEN p_partkey % 2 = 0 THEN 'exclusion' ELSE 'inclusion' END", "lower(t)"
    words = f"list_distinct(list_filter(regexp_extract_all({low}, '{X.HEADER_WORD}'), lambda x: length(x) >= 3 AND x NOT IN {_in(X.TRIAGE_STOPWORDS)}))"
    signals = " + ".join(f"CASE WHEN regexp_matches({low}, '{_re(p)}') THEN {v}::DOUBLE ELSE 0 END" for p, v in X.TRIAGE_WORDS)
    return f"""WITH {CRITERION}, k AS (SELECT * FROM crit JOIN ({typed()}) USING (p_partkey))
      SELECT p_partkey, round(greatest(0, {_case('type', X.TRIAGE_BASE, 2)} + CASE WHEN {polar} = 'exclusion' THEN 0.4 + CASE WHEN type IN {_in(X.TRIAGE_STRONG_EXCLUSIONS)} THEN 0.8 ELSE 0 END ELSE 0 END::DOUBLE
        + CASE WHEN p_partkey % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END + least(3, 0.7::DOUBLE * len(list_intersect(['melanoma', 'her2', 'chemotherapy', 'hiv', 'infection'], {words}))) + {signals}
        - CASE WHEN {_hit(low, X.TRIAGE_ADMIN)} THEN 3.5::DOUBLE ELSE 0 END - CASE WHEN regexp_matches({low}, '{X.TRIAGE_BROAD}') THEN 0.6::DOUBLE ELSE 0 END), 6)::DOUBLE AS score FROM k"""


def adjusted() -> str:
    hard = score("benchmark", False).replace("round(", "(", 1).replace(", 6)::DOUBLE AS score", ")::DOUBLE AS score", 1)
    veto = f"(SELECT topic_id, trial, exc_met > 0 OR mandatory_failed AS veto FROM (WITH {EVALS}, {COUNTS} SELECT * FROM counts))"
    ev = evidence().replace("+ 1e-9, 6)::DOUBLE AS evidence", ", 15)::DOUBLE AS evidence")
    return f"""SELECT topic_id, trial, round(score + CASE WHEN veto AND score <= -0.95 THEN 0.125::DOUBLE ELSE 0.5::DOUBLE END * (evidence - 0.5::DOUBLE) + 1e-9, 6) AS score
      FROM ({hard}) JOIN ({ev}) USING (topic_id, trial) JOIN {veto} USING (topic_id, trial)"""


DEMOTE = f"""WITH RECURSIVE {bm25(['all'], 10)}, l AS (SELECT topic_id, list(doc_id ORDER BY rank) AS ids, list_sort(list(doc_id) FILTER (doc_id % 3 = 0)) AS bad FROM run GROUP BY topic_id),
      r AS (SELECT topic_id, ids, coalesce(bad, []) AS bad, 0 AS k FROM l UNION ALL
        SELECT topic_id, CASE WHEN p - 1 < len(ids) - 2 THEN list_filter(ids[1:p + 2], lambda y: y <> x) || [x] || ids[p + 3:] ELSE ids END, bad, k + 1
        FROM (SELECT *, bad[k + 1] AS x, list_position(ids, bad[k + 1]) AS p FROM r WHERE k < len(bad)))
      SELECT topic_id, unnest(ids) AS doc_id, unnest(range(1, len(ids) + 1))::INTEGER AS rank FROM r QUALIFY k = max(k) OVER (PARTITION BY topic_id)"""

STAGES = f"""WITH {QRELS}, {bm25(['all'], 200)}, h AS (SELECT topic_id, cutoff, count(*) FILTER (rank <= cutoff AND grade > 0) AS relevant, count(*) FILTER (rank <= cutoff AND grade = 2) AS eligible
        FROM run LEFT JOIN qrels USING (doc_id), (SELECT unnest([10, 20, 50, 100, 200]) AS cutoff) GROUP BY ALL)
      SELECT cutoff, round(avg(relevant), 6) AS mean_relevant, round(avg(eligible), 6) AS mean_eligible, count(*) FILTER (relevant = 0) AS zero_topics FROM h GROUP BY cutoff"""
AVERAGE = "count(*) AS n_topics, round(avg(ndcg10), 6) AS ndcg10, round(avg(p10), 6) AS p10, round(avg(recall20), 6) AS recall20, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap"


ORACLES = {
    "tok_bm25": f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "tok_entity_stem": f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id, {terms('text', True)} AS t FROM documents)",
    "tok_selection": f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id, {chosen('text')} AS t FROM documents)",
    "negation_cue": rf"""SELECT conv_id, turn, regexp_matches(note, '(?i){X.NEGATION_CUE}') AS negated,
        length(array_to_string(list_transform(split(regexp_replace(note, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: CASE WHEN regexp_matches(s, '(?i){X.NEGATION_CUE}') THEN '[CONTAINS_NEGATION] ' || s ELSE s END), ' ')) AS n_annotated
        FROM (SELECT conv_id, turn, {NOTE} AS note FROM conversations)""",
    "negation_window": negated(),
    "temporal_extract": temporal(),
    "temporal_annotate": annotated(),
    "age_to_days": """SELECT p_partkey, p_size || ' ' || u AS age, CASE u WHEN 'Years' THEN p_size * 365 WHEN 'months' THEN p_size * 30 WHEN 'Weeks' THEN p_size * 7 WHEN 'day' THEN p_size WHEN 'N/A' THEN NULL ELSE 0 END::BIGINT AS days
        FROM (SELECT *, CASE p_size % 7 WHEN 0 THEN 'Years' WHEN 1 THEN 'months' WHEN 2 THEN 'Weeks' WHEN 3 THEN 'day' WHEN 4 THEN 'Hours' WHEN 5 THEN 'minutes' ELSE 'N/A' END AS u FROM part)""",
    "phase_norm": phases(),
    "status_norm": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NOT_YET_RECRUITING' ELSE 'UNKNOWN' END AS status FROM customer",
    "date_multi": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') WHEN 2 THEN strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') END AS day FROM orders""",
    "split_eligibility": SPLIT,
    "clean_truncate": r"""SELECT doc_id, CASE WHEN length(c) > 260 THEN rtrim(substr(c, 1, 257)) || '...' ELSE c END AS cleaned FROM (SELECT doc_id,
        trim(regexp_replace(regexp_replace(regexp_replace('[**name**] ' || coalesce(text, ''), '\[\*\*.*?\*\*\]', '[redacted]', 'g'), '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents)""",
    "html_fields": """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages""",
    "sha_key": """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS key FROM customer""",
    "corpus_filter": f"WITH {TRIALS} SELECT trial, status FROM trials WHERE status <> 'COMPLETED' AND (updated IS NULL OR updated >= DATE '1997-01-01')",
    "bm25_topk": f"WITH {bm25(['all'], 20)} SELECT topic_id, doc_id, score, rank FROM run",
    "bm25_fielded_runs": f"WITH {bm25(X.FIELD_WEIGHTS, 10)} SELECT field, topic_id, doc_id, score, rank FROM run",
    "bm25_fielded_rrf": f"WITH {bm25(X.FIELD_WEIGHTS, 1000)} {fused(X.FIELD_WEIGHTS, 20)}",
    "dense_cosine_topk": dense("true", 20),
    "dense_filtered_topk": dense("v.label IN (1, 2)", 10),
    "hyde_mean_vector": "SELECT query_id, i, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT vec_id // 4 AS query_id, unnest(embedding) AS x, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings) GROUP BY ALL",
    "rrf_hybrid": f"""WITH {bm25(['all'], 50)}, both_ AS (SELECT 'bm25' AS source, topic_id, doc_id, rank FROM run UNION ALL SELECT 'dense', query_id, vec_id, rank FROM ({dense('true', 50, '(q.vec_id % 20 = 0 OR q.vec_id IN (SELECT item_id FROM benchmark))')}))
        {fused({'bm25': 1.0, 'dense': 1.0}, 30, 'both_', 'source')}""",
    "rerank_blend": f"WITH {BLEND} SELECT * FROM blend",
    "run_overlap": f"""WITH {bm25(['all', 'summary_description'], 100)}, d AS (SELECT topic_id, doc_id, count(*) AS k FROM run GROUP BY ALL)
        SELECT topic_id, count(*) FILTER (k = 2) AS common, count(*) AS together, round(count(*) FILTER (k = 2) / count(*), 6) AS jaccard FROM d GROUP BY topic_id""",
    "hard_filter_reasons": HARD,
    "viable_counts": f"SELECT excluded_reason, count(*) AS n FROM ({HARD}) GROUP BY ALL",
    "overlap_features": features(),
    "top_score_select": f"WITH {bm25(['all'], 5)} SELECT topic_id, doc_id, score, rank FROM run",
    "retrieval_prior": f"WITH {bm25(['all'], 50)} SELECT topic_id, doc_id, round(CASE WHEN m <= 1 THEN 1 ELSE 1 - (rank - 1) / (m - 1) END, 6)::DOUBLE AS prior FROM (SELECT *, max(rank) OVER (PARTITION BY topic_id) AS m FROM run)",
    "mmr_select": mmr(3, 10),
    "trial_label_benchmark": f"WITH {EVALS}, {COUNTS} SELECT topic_id, trial, label, {grade('label')} AS qrel, n_inc, n_exc, round(fraction_nei, 6) AS fraction_nei FROM (SELECT *, {label('benchmark')} AS label FROM counts)",
    "trial_label_clinical": f"WITH {EVALS}, {COUNTS} SELECT topic_id, trial, {label('clinical', True)} AS label FROM counts",
    "predicate_eval": """SELECT p_partkey, CASE WHEN p_size <= 3 THEN 'NEI' WHEN CASE p_partkey % 7 WHEN 0 THEN p_size >= 25 WHEN 1 THEN p_size <= 25 WHEN 2 THEN p_size > 25 WHEN 3 THEN p_size < 25 WHEN 4 THEN p_size = 25 WHEN 5 THEN p_size <> 25 ELSE false END THEN 'met' ELSE 'not_met' END AS label FROM part""",
    "sc_vote": """WITH c AS (SELECT l_suppkey % 2 AS topic_id, l_orderkey % 500 AS trial, l_linenumber AS criterion, l_returnflag AS label, count(*) AS n, avg(l_discount) AS conf FROM lineitem GROUP BY ALL),
      b AS (SELECT *, sum(n) OVER (PARTITION BY topic_id, trial, criterion) AS k, row_number() OVER (PARTITION BY topic_id, trial, criterion ORDER BY n DESC, label DESC) AS r FROM c)
      SELECT topic_id, trial, criterion, CASE WHEN n > floor(k / 2) THEN label ELSE 'NEI' END AS label, round(CASE WHEN n > floor(k / 2) THEN conf ELSE 0.4 END, 6)::DOUBLE AS confidence FROM b WHERE r = 1""",
    "eligibility_score": f"WITH {EVALS}, {COUNTS} SELECT topic_id, trial, round({ELIG}, 6) AS score FROM counts",
    "trial_score_hard": score("clinical", False),
    "trial_score_soft": score("benchmark", True),
    "criterion_evidence": evidence(),
    "label_histogram": f"WITH {EVALS} SELECT type, polarity, label, count(*) AS n FROM evals GROUP BY ALL",
    "trec_metrics": metrics(False),
    "trec_metrics_linear": metrics(True),
    "trec_summary": f"SELECT count(*) AS n_topics, round(avg(ndcg10), 6) AS ndcg10, round(avg(p10), 6) AS p10, round(avg(recall20), 6) AS recall20, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap FROM ({metrics(False)})",
    "f1_trial": f"WITH {PAIRS} {rates(classes('pairs'))}",
    "f1_average": f"WITH {PAIRS} SELECT {MEANS} FROM ({rates(classes('pairs'))})",
    "confusion": f"WITH {PAIRS} SELECT gold, predicted, count(*) AS n FROM pairs GROUP BY ALL",
    "threshold_sweep": f"""WITH {EVALS}, {COUNTS}, grid AS (SELECT i * 10 + j AS place, round(0.05 * i, 2)::DOUBLE AS fraction, round(0.1 * j, 2)::DOUBLE AS most_nei FROM range(1, 15) a(i), range(1, 11) b(j)),
      z AS (SELECT place, fraction, most_nei, trial % 3 AS gold, CASE WHEN exc_met > 1 OR mandatory_failed THEN 1 WHEN n_inc > 0 AND inc_met = n_inc AND exc_met = 0 THEN 2
        WHEN n_inc > 0 AND inc_met >= greatest(1, trunc(fraction * n_inc)) AND exc_met = 0 AND fraction_nei < most_nei THEN 2 ELSE 1 END AS predicted FROM counts, grid),
      f AS (SELECT place, fraction, most_nei, round(coalesce(2 * count(*) FILTER (gold = 2 AND predicted = 2) / (count(*) FILTER (gold = 2) + count(*) FILTER (predicted = 2)), 0), 6)::DOUBLE AS class_2_f1,
        round(count(*) FILTER (gold = predicted) / count(*), 6) AS micro_f1 FROM z GROUP BY ALL)
      SELECT fraction, most_nei, class_2_f1, micro_f1, row_number() OVER (ORDER BY class_2_f1 DESC, micro_f1 DESC, place) = 1 AS best_class_2, row_number() OVER (ORDER BY micro_f1 DESC, class_2_f1 DESC, place) = 1 AS best_micro FROM f""",
    "stage_metrics": f"""WITH {QRELS}, {bm25(['all'], 200)} SELECT topic_id, cutoff, count(*) FILTER (rank <= cutoff AND grade IS NOT NULL) AS judged, count(*) FILTER (rank <= cutoff AND grade > 0) AS relevant,
        count(*) FILTER (rank <= cutoff AND grade = 2) AS eligible, count(*) FILTER (rank <= cutoff AND grade IS NULL) AS unjudged FROM run LEFT JOIN qrels USING (doc_id), (SELECT unnest([10, 20, 50, 100, 200]) AS cutoff) GROUP BY ALL""",
    "missing_reasons": f"""WITH {QRELS}, {bm25(['all'], 20)}, w AS (SELECT doc_id % 40 AS topic_id, doc_id FROM qrels WHERE grade > 0 AND doc_id % 40 IN (SELECT topic_id FROM run))
        SELECT topic_id, CASE WHEN run.doc_id IS NOT NULL THEN 'retrieved' WHEN w.doc_id % 10 = 7 THEN 'not_in_corpus' WHEN w.doc_id % 10 = 3 THEN 'not_in_index' ELSE 'not_retrieved' END AS reason, count(*) AS n
        FROM w LEFT JOIN run USING (topic_id, doc_id) GROUP BY ALL""",
    "infer_type": typed(),
    "section_header": f"WITH {CRITERION} SELECT p_partkey, {header('t')} AS header, CASE WHEN {header('t')} THEN CASE WHEN {_hit(_low('t'), X.HEADER_DROP)} THEN 'drop' ELSE 'merge' END END AS action FROM crit",
    "question_type": f"WITH {CRITERION} SELECT p_partkey, {asked('t')} AS type FROM crit",
    "segment_lines": SEGMENTS,
    "cap_legacy": f"""WITH {PLAIN}, r AS (SELECT trial, criterion AS pos, polarity, row_number() OVER (PARTITION BY trial, polarity ORDER BY criterion) AS nth, count(*) FILTER (polarity = 'exclusion') OVER (PARTITION BY trial) AS ne FROM evals),
      t AS (SELECT *, CASE WHEN polarity = 'inclusion' THEN nth <= CASE WHEN ne > 0 THEN 2 ELSE 4 END ELSE nth <= 2 END AS first FROM r)
      SELECT trial, pos, polarity FROM t QUALIFY row_number() OVER (PARTITION BY trial ORDER BY first DESC, pos) <= 4""",
    "question_rubric": RUBRIC,
    "question_summary": f"SELECT count(*) AS n, round(avg(normalized), 6) AS mean_score, round(avg(specific) / 2, 6) AS specific, round(avg(temporal) / 2, 6) AS temporal, round(avg(format) / 2, 6) AS format, round(avg(rationale_score) / 2, 6) AS rationale_score, round(avg(actionable) / 2, 6) AS actionable FROM ({RUBRIC})",
    "dossier_completeness": "SELECT c_custkey, round(0.7 * (" + " + ".join(f"(c_custkey % {n} > 0)::INT" for n in (2, 3, 5, 7, 11, 13, 17, 19)) + ") / 8.0::DOUBLE + 0.2 * (" + " + ".join(f"(c_custkey % {n} > 0)::INT" for n in (2, 3, 4, 5)) + ") / 4.0::DOUBLE + CASE WHEN c_acctbal > 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS completeness FROM customer",
    "error_categories": ERRORS,
    "attention_flags": FLAGS,
    "geography": GEOGRAPHY,
    "fill_excluded": f"""WITH {bm25(['all'], 30)}, a AS (SELECT * FROM run WHERE rank <= 5), n AS (SELECT topic_id, count(*) AS n, min(score) AS low FROM a GROUP BY topic_id),
      free AS (SELECT topic_id, doc_id, score, doc_id % 2 = 0 AS ex FROM run WHERE rank > 5 AND rank <> 7 AND rank % 4 > 0 AND doc_id % 11 > 0),
      i AS (SELECT *, row_number() OVER (PARTITION BY topic_id, ex ORDER BY score DESC, doc_id) AS i FROM free),
      t AS (SELECT topic_id, doc_id, least(-1.5::DOUBLE, low - 0.5::DOUBLE) + 0.001::DOUBLE * greatest(0, 1 - (i - 1) / (15 - n)::DOUBLE) AS score FROM i JOIN n USING (topic_id) WHERE NOT ex AND i <= 15 - n),
      m AS (SELECT topic_id, count(*) AS n, min(score) AS low FROM (SELECT topic_id, score FROM a UNION ALL SELECT topic_id, score FROM t) GROUP BY topic_id),
      e AS (SELECT topic_id, doc_id, least(-2::DOUBLE, low - 1) + 0.001::DOUBLE * greatest(0, 1 - (i - 1) / greatest(15 - n, 1)::DOUBLE) AS score FROM i JOIN m USING (topic_id) WHERE ex AND i <= 15 - n)
      SELECT topic_id, doc_id, round(score, 6) AS score, 'ranked' AS source FROM a UNION ALL SELECT topic_id, doc_id, round(score, 6), 'tail' FROM t UNION ALL SELECT topic_id, doc_id, round(score, 6), 'excluded' FROM e""",
    "irrelevance_policy": f"""WITH {EVALS}, {COUNTS}, s AS (SELECT *, {label('benchmark')} AS label, (trial % 10)::DOUBLE / 10 <= 0.5::DOUBLE AS low FROM counts)
      SELECT topic_id, trial, CASE WHEN label = 'eligible' THEN 'eligible_label' WHEN exc_met > 0 THEN 'explicit_exclusion_met' WHEN mandatory_failed THEN 'mandatory_inclusion_failed'
        WHEN NOT (fraction_nei >= 0.8::DOUBLE AND inc_met <= 0 AND low) THEN 'missing_core_irrelevance_signals' WHEN 3 + (trial % 2 = 0)::INT + (trial % 3 = 0)::INT < 4 THEN 'insufficient_signals' ELSE 'irrelevant' END AS outcome FROM s""",
    "index_coverage": f"WITH {QRELS} SELECT grade, count(*) AS judged, count(d.doc_id) AS in_corpus, count(*) FILTER (d.doc_id % 10 <> 3) AS in_index FROM qrels LEFT JOIN documents d USING (doc_id) GROUP BY grade",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
    "triage_score": triage(),
    "alias_norm": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'numeric' WHEN 1 THEN 'boolean' WHEN 2 THEN 'text' WHEN 3 THEN 'numeric' WHEN 4 THEN 'date' WHEN 5 THEN 'categorical' ELSE 'other_kind' END AS type FROM part",
    "thesaurus_lookup": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'D1' WHEN 1 THEN 'D2' WHEN 2 THEN 'D3' WHEN 3 THEN 'D4' ELSE 'D1' END AS concept FROM part WHERE p_partkey % 6 < 5",
    "verifier_rule": f"""WITH {EVALS}, f AS (SELECT *, confidence < 0.85 AND trial % 4 >= 2 AND label <> CASE trial % 3 WHEN 0 THEN 'met' WHEN 1 THEN 'not_met' ELSE 'NEI' END AS flipped FROM evals)
      SELECT topic_id, trial, criterion, CASE WHEN flipped THEN 'NEI' ELSE label END AS label, round(CASE WHEN flipped THEN least(confidence, 0.5::DOUBLE) ELSE confidence END, 6) AS confidence, flipped FROM f""",
    "cascade_route": f"""WITH {EVALS} SELECT CASE WHEN trial % 2 = 0 AND (label <> 'NEI' OR type IN ('age', 'sex')) THEN 'deterministic' WHEN type IN {_in((*X.LLM_TYPES, 'performance_status'))} THEN 'model' ELSE 'votes' END AS route, count(*) AS n FROM evals GROUP BY ALL""",
    "evidence_adjust": adjusted(),
    "critique_demote": DEMOTE,
    "final_ranked_gap": f"""WITH {QRELS}, {bm25(['all'], 20)} SELECT topic_id, count(*) AS missing, count(*) FILTER (grade > 0) AS relevant_lost, count(*) FILTER (grade = 2) AS eligible_lost
      FROM run LEFT JOIN qrels USING (doc_id) WHERE rank > 10 GROUP BY topic_id""",
    "stage_aggregate": STAGES,
    "run_compare": f"SELECT 'bm25' AS run, {AVERAGE} FROM ({metrics(False)}) UNION ALL SELECT 'blend', {AVERAGE} FROM ({metrics(False, 'blend', BLEND)})",
    "reretrieval_flag": f"WITH {bm25(['all'], 20)} SELECT topic_id, count(*) FILTER (doc_id % 2 = 0) AS viable, count(*) FILTER (doc_id % 2 = 0) < 10 AS again FROM run GROUP BY topic_id",
    "fewshot_knn": f"""SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC)::INTEGER AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, round({COSINE.format('q.embedding', 'v.embedding')}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id % 20 <> 0)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) <= 3""",
}
