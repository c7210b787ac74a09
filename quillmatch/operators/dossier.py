"""Dossiers: what a reader of a matched trial sees, assembled by joins and one aggregate a trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import criteria as C
from quillmatch.functions import fixed as X
from quillmatch.functions import views as V
from quillmatch.operators.eligibility import KEY

PRIORITIES = X.PRIORITIES


def locations_summary(locations: Column) -> Column:
    """``city, country`` of the first six sites."""
    place = lambda x: V.joined([x["city"], x["country"]], ", ")
    text = F.array_join(F.filter(F.transform(F.slice(locations, 1, 6), place), lambda x: x != ""), "; ")
    return F.when(F.coalesce(text, F.lit("")) == "", "(no locations listed)").otherwise(text)


def contact_summary(contacts: Column) -> Column:
    """Name, email and phone of the first contact, or null."""
    first = F.get(contacts, F.lit(0))
    text = V.joined([first["name"], first["email"], first["phone"]], " | ")
    return F.when(text != "", text)


def label_counts() -> list[Column]:
    inc, met, no = F.col("polarity") == "inclusion", F.col("label") == "met", F.col("label") == "not_met"
    out = []
    for name, side in (("inclusion", inc), ("exclusion", ~inc)):
        out += [F.count_if(side).alias(f"{name}_total"), F.count_if(side & met).alias(f"{name}_met")]
        out += [F.count_if(side & no).alias(f"{name}_not_met"), F.count_if(side & ~met & ~no).alias(f"{name}_nei")]
    return out


def fallback_questions(evals: DataFrame) -> DataFrame:
    """A question for every criterion whose evaluation lacks information.

    ``evals``: topic_id, trial, criterion, id, text, label, mandatory, reasoning.
    """
    reason = F.when(F.coalesce("reasoning", F.lit("")) != "", F.col("reasoning")).otherwise(V.missing_reason(F.col("reasoning"), F.col("label")))
    made = V.fallback_question(F.col("trial"), F.col("id"), F.col("text"), F.col("mandatory"), reason, C.question_type)
    return evals.where("label = 'NEI'").select(*KEY, "criterion", F.col("id").alias("criterion_id"), made.alias("q")).select(
        *KEY, "criterion", "criterion_id", "q.*"
    )


def with_payload(questions: DataFrame, payload: DataFrame) -> DataFrame:
    """Questions replaced by a model's where it gave one (topic_id, trial, criterion_id, question_text, priority)."""
    said = payload.select(*KEY, "criterion_id", F.col("question_text").alias("asked"), F.col("priority").alias("urgency"))
    rows = questions.join(said, [*KEY, "criterion_id"], "left")
    return rows.select(
        *[
            F.coalesce("asked", c).alias(c) if c == "question_text" else F.coalesce("urgency", c).alias(c) if c == "priority" else F.col(c)
            for c in questions.columns
        ]
    )


def generated_questions(evals: DataFrame, payload: DataFrame) -> DataFrame:
    """Questions for every criterion that lacks information: a model's where it gave a usable one, else the fallback.

    ``evals`` as in `fallback_questions`; ``payload``: topic_id, trial, criterion (what was asked about), question_text,
    data_point, rationale, expected_data_type, priority and, if the model named them, trial_id and criterion_id.  Types
    and priorities are taken by their aliases; an unknown one, a missing text and a missing rationale make an answer
    unusable, a missing type is text and a missing priority medium.  Of several usable answers the first in order of
    their texts counts.
    """
    kind = F.coalesce(C.data_type(F.col("expected_data_type")), F.lit("text"))
    urgency = F.coalesce(C.priority_alias(F.col("priority")), F.lit("medium"))
    said = payload.select(
        *KEY, "criterion", "trial_id", F.col("criterion_id").alias("named"), "question_text", "data_point", "rationale", kind.alias("kind"), urgency.alias("urgency")
    ).where("question_text is not null and data_point is not null and rationale is not null")
    said = said.where(F.col("kind").isin(*X.DATA_TYPES) & F.col("urgency").isin(*X.PRIORITIES))
    value = F.struct("question_text", "data_point", "rationale", "kind", "urgency", "trial_id", "named")
    said = said.groupBy(*KEY, "criterion").agg(F.min(value).alias("said"))
    rows = fallback_questions(evals).join(said, [*KEY, "criterion"], "left")
    own = {"question_text": "question_text", "data_point": "data_point", "rationale": "rationale", "expected_data_type": "kind", "priority": "urgency"}
    return rows.select(
        *KEY,
        "criterion",
        F.coalesce(F.nullif(F.col("said.trial_id"), F.lit("")), F.col("trial").cast("string")).alias("trial_id"),
        F.coalesce(F.nullif(F.col("said.named"), F.lit("")), F.col("criterion_id")).alias("criterion_id"),
        *[F.coalesce(F.col(f"said.{theirs}"), F.col(mine)).alias(mine) for mine, theirs in own.items()],
        F.col("said").isNotNull().alias("asked_by_model"),
    )


def attention(home: Column) -> Column:
    """What a reader should look at, as severity, category and message.

    Reads fraction_nei, mandatory_failed, exc_met, status and locations; ``home`` is the patient's place, if known.
    """
    c = F.col
    near = F.exists("locations", lambda x: F.coalesce(F.contains(F.lower(x["country"]), F.lower(home)), F.lit(False)))
    far = (F.coalesce(home, F.lit("")) != "") & (F.size("locations") > 0) & ~near
    share = F.bround(100 * c("fraction_nei"), 0).cast("long").cast("string")
    rules = (
        (c("fraction_nei") >= 0.4, "warning", "data_quality", F.concat(share, F.lit(X.FLAG_UNKNOWN))),
        (c("mandatory_failed"), "critical", "eligibility", F.lit(X.FLAG_FAILED)),
        (c("exc_met") > 0, "critical", "eligibility", F.lit(X.FLAG_EXCLUDED)),
        (far, "warning", "geographic", F.concat(F.lit(X.FLAG_FAR[0]), home, F.lit(X.FLAG_FAR[1]))),
        (~c("status").isin("RECRUITING", "NOT_YET_RECRUITING"), "warning", "trial_status", F.concat(F.lit(X.FLAG_STATUS), c("status"), F.lit("."))),
    )
    cells = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("category"), m.alias("message"))) for cond, s, k, m in rules]
    return F.array_compact(F.array(*cells))


def breakdown() -> Column:
    """The parts of a score; reads score and the columns of `eligibility.trial_score`."""
    c = F.col
    sure = X.SCORE_WEIGHTS["blend"] * F.coalesce("avg_confidence", F.lit(0.7)) + (1 - X.SCORE_WEIGHTS["blend"])
    parts = {
        "total": c("score"), "eligibility_score": c("elig"), "recruiting_bonus": c("status_bonus"), "phase_alignment": c("phase_score"),
        "recency": c("recency"), "geographic_proximity": c("geography"), "nei_penalty": c("fraction_nei"),
    }
    rest = F.coalesce((c("exc_met") > 0) | c("mandatory_failed"), F.lit(False)).alias("mandatory_veto")
    return F.struct(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()], rest, F.coalesce(sure, F.lit(1.0)).alias("confidence_adjustment"))


def dossiers(judged: DataFrame, evals: DataFrame, trials: DataFrame, questions: DataFrame, facts: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """One row per judged trial: counts, criterion table, evidence, summary, questions by priority, sites, contact, url.

    With ``facts`` (topic_id, trial, fraction_nei, mandatory_failed, exc_met, avg_confidence, elig, status_bonus, phase_score,
    recency, geography) also the attention flags and the parts of the score; ``people`` (topic_id, home) tells where patients live.

    ``judged``: topic_id, trial, rank, score, rationale.  ``evals``: topic_id, trial, criterion, id, polarity, type, text, label,
    evidence, confidence.  ``trials``: trial, title, brief_summary, phase, status, locations, contacts.
    """
    row = F.struct("criterion", "id", "type", "polarity", "text", "label", "evidence", "confidence")
    shown = F.when((F.col("label") == "met") & (F.coalesce("evidence", F.lit("")) != ""), F.col("criterion"))
    tables = evals.groupBy(*KEY).agg(
        *label_counts(), F.sort_array(F.collect_list(row)).alias("criteria"), F.min_by(F.substring("evidence", 1, 200), shown).alias("top_evidence")
    )
    urgency = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    asked = questions.groupBy(*KEY).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(urgency.alias("u"), "criterion", "criterion_id", "priority", "question_text"))),
            lambda q: F.struct(q["criterion_id"].alias("criterion_id"), q["priority"].alias("priority"), q["question_text"].alias("question_text")),
        ).alias("missing_information")
    )
    rows = judged.join(tables, KEY, "left").join(trials, "trial", "left").join(asked, KEY, "left")
    said = F.coalesce("rationale", F.lit(""))
    more = []
    if facts is not None:
        rows = rows.join(facts, KEY, "left")
        if people is not None:
            rows = rows.join(people.select("topic_id", F.col("home").alias("home")), "topic_id", "left")
        home = F.col("home") if people is not None else F.lit(None).cast("string")
        more = [attention(home).alias("attention_flags"), breakdown().alias("score_breakdown")]
    return rows.select(
        "topic_id", "trial", "rank", "score", "title", "phase", "status",
        *[F.coalesce(f"{p}_{x}", F.lit(0)).alias(f"{p}_{x}") for p in ("inclusion", "exclusion") for x in ("total", "met", "not_met", "nei")],
        "criteria", F.coalesce("top_evidence", F.lit("")).alias("top_evidence"),
        F.when(said != "", said).otherwise(F.substring(F.coalesce("brief_summary", F.lit("")), 1, 300)).alias("executive_summary"),
        F.coalesce("missing_information", F.array().cast("array<struct<criterion_id:string,priority:string,question_text:string>>")).alias("missing_information"),
        locations_summary(F.col("locations")).alias("locations_summary"),
        contact_summary(F.col("contacts")).alias("contact_summary"),
        V.trial_url(F.col("trial")).alias("url"),
        *more,
    )


def markdown(rows: DataFrame) -> DataFrame:
    """(topic_id, trial, markdown) of `dossiers`."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    line = lambda r: F.concat(F.lit("| "), r["id"], F.lit(" | "), r["polarity"], F.lit(" | "), r["type"], F.lit(" | "), r["label"], F.lit(" | "), F.replace(r["text"], F.lit("|"), F.lit("\\|")), F.lit(" |"))
    ask = lambda q: F.concat(F.lit("- ["), q["priority"], F.lit("] "), q["question_text"])
    side = lambda p: F.concat(F.lit(f"{p}: "), *[x for k in ("met", "not_met", "nei") for x in (c(f"{p}_{k}"), F.lit(f" {k} "))])
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), c("trial"), F.lit(" "), c("title")),
        F.concat(F.lit("rank "), c("rank"), F.lit(" | "), c("phase"), F.lit(" | "), c("status"), F.lit(" | "), c("url")),
        F.concat(F.lit("sites: "), c("locations_summary")),
        F.concat(F.lit("\n"), c("executive_summary"), F.lit("\n")),
        side("inclusion"),
        side("exclusion"),
        F.lit("\n| id | polarity | type | label | text |\n|-|-|-|-|-|"),
        F.array_join(F.transform(F.coalesce("criteria", F.array().cast(rows.schema["criteria"].dataType)), line), "\n"),
        F.lit("\n## Missing information"),
        F.array_join(F.transform("missing_information", ask), "\n"),
    )
    return rows.select("topic_id", "trial", text.alias("markdown"))
