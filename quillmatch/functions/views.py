"""Column functions that render documents, profiles, criteria and candidates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions import text as T


def _said(part: Column) -> Column:
    return F.coalesce(part, F.lit(""))


def joined(parts: list[Column], by: str) -> Column:
    """The parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*map(_said, parts)), lambda x: x != ""), by)


_PARTS = {
    "title": lambda: F.col("title"),
    "official": lambda: F.col("official_title"),
    "summary": lambda: F.col("brief_summary"),
    "detail": lambda: F.col("detailed_description"),
    "conditions": lambda: F.array_join("conditions", " "),
    "keywords": lambda: F.array_join("keywords", " "),
    "interventions": lambda: F.array_join("interventions", " "),
    "inclusion": lambda: F.col("inclusion_text"),
    "exclusion": lambda: F.col("exclusion_text"),
    "eligibility": lambda: F.col("raw_text"),
}

#: Which parts of a trial make up each view, in order.
VIEWS = {
    "all": "title official summary detail conditions keywords interventions inclusion exclusion",
    "condition_title": "title official conditions keywords",
    "eligibility": "inclusion exclusion eligibility",
    "intervention": "interventions summary detail",
    "summary_description": "summary detail title",
    "rerank": "title official conditions keywords interventions summary detail inclusion",
    "listwise": "title official conditions interventions summary",
    "audit": "title summary conditions",
    "dense": "title summary conditions inclusion exclusion",
}


def trial_view(name: str) -> Column:
    """A text view of a trial's columns; the dense view has at most 4000 characters, others are whole."""
    text = joined([_PARTS[p]() for p in VIEWS[name].split()], "\n")
    return F.substring(text, 1, 4000) if name == "dense" else text


def selection_view(candidate_title: Column, snippet: Column) -> Column:
    """What selection tokens are taken from: candidate and trial texts, criteria up to 4000 characters."""
    parts = [candidate_title, snippet, *[_PARTS[p]() for p in "title official conditions keywords interventions".split()]]
    return joined([*parts, F.col("phase"), F.col("status"), F.substring(_said(F.col("raw_text")), 1, 4000)], "\n")


def trial_url(trial: Column) -> Column:
    return F.concat(F.lit("https://clinicaltrials.gov/study/"), trial.cast("string"))


def criterion_short(ident: Column, polarity: Column, kind: Column, text: Column) -> Column:
    side = F.when(polarity == "inclusion", "INCL").otherwise("EXCL")
    return F.concat(F.lit("["), ident, F.lit(" "), side, F.lit(" "), kind, F.lit("] "), text)


def example_block(example: Column) -> Column:
    """One worked example of a prompt."""
    lines = (
        ("### Example (", "category", ")\n"),
        ("Criterion: ", "criterion_text", "\n"),
        ("Patient excerpt: ", "patient_excerpt", "\n"),
        ("Reasoning: ", "reasoning", "\n"),
        ("Decision: ", "decision", "\n"),
    )
    return F.concat(*[x for a, name, b in lines for x in (F.lit(a), _said(example[name]), F.lit(b))])


def examples_block(examples: Column) -> Column:
    return F.array_join(F.transform(examples, example_block), "\n")


def percent(share: Column) -> Column:
    """A share as a whole per cent, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def candidate_line(place: Column, trial: Column, title: Column) -> Column:
    """One candidate for a judge; reads phase, status and the counts of `trial_counts`."""
    c = lambda x: F.col(x).cast("string")
    known = lambda x, other: F.coalesce(F.col(x), F.lit(other))
    return F.concat(
        place.cast("string"), F.lit(". "), trial.cast("string"), F.lit(" — "), F.substring(F.coalesce(title, F.lit("?")), 1, 120),
        F.lit(" | phase="), known("phase", "NA"), F.lit(" | status="), known("status", "UNKNOWN"),
        F.lit(" | incl met/total="), c("inc_met"), F.lit("/"), c("n_inc"),
        F.lit(", excl clear/total="), c("exc_not"), F.lit("/"), c("n_exc"), F.lit(", NEI="), percent(F.col("fraction_nei")),
    )


def missing_reason(reasoning: Column, label: Column) -> Column:
    unsaid = "The available patient note does not contain enough information to determine this criterion confidently."
    unfit = "The criterion could not be converted into a stable screening question from the available structured data."
    return F.when((_said(reasoning) == "") | (label == "NEI"), unsaid).otherwise(unfit)


# --- profiles: age_years, sex, primary_diagnosis, primary_diagnosis_stage, secondary_diagnoses, biomarkers, prior_treatments,
# comorbidities, labs, ecog, karnofsky, raw_text


def profile_summary() -> Column:
    """One line about a person, or the start of the note if nothing is known."""
    c = F.col
    diagnosed = _said(c("primary_diagnosis")) != ""
    marks = F.transform(F.slice("biomarkers", 1, 3), lambda b: F.concat_ws(" ", b["name"], b["status"]))
    parts = [
        F.when(c("age_years").isNotNull(), F.concat(F.bround("age_years", 0).cast("long").cast("string"), F.lit("-year-old"))),
        F.when(c("sex") != "unknown", c("sex")),
        F.when(diagnosed, F.concat(F.lit("with "), c("primary_diagnosis"))),
        F.when(diagnosed & (_said(c("primary_diagnosis_stage")) != ""), F.concat(F.lit("("), c("primary_diagnosis_stage"), F.lit(")"))),
        F.when(c("ecog").isNotNull(), F.concat(F.lit("ECOG "), c("ecog").cast("string"))),
        F.when(F.size("biomarkers") > 0, F.concat(F.lit("biomarkers: "), F.array_join(marks, ", "))),
    ]
    text = joined(parts, " ")
    return F.when(text == "", F.substring(_said(c("raw_text")), 1, 200)).otherwise(text)


def profile_excerpt(limit: int = 2200) -> Column:
    """All that is known about a person, the note last, up to ``limit`` characters."""
    c = F.col

    def listed(head: str, column: str, one, by: str = ", ") -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(head), F.array_join(F.transform(column, one), by)))

    mark = lambda b: F.concat(b["name"], F.lit("="), b["status"], F.when(_said(b["method"]) != "", F.concat(F.lit(" ("), b["method"], F.lit(")"))).otherwise(""))
    given = lambda t: F.concat(t["name"], F.when(F.coalesce(t["line"], F.lit(0)) > 0, F.concat(F.lit(" line "), t["line"].cast("string"))).otherwise(""))
    lab = lambda x: F.trim(F.concat(x["name"], F.lit("="), x["value"].cast("string"), F.lit(" "), _said(x["units"])))
    measured = F.filter("labs", lambda x: x["value"].isNotNull())
    parts = [
        F.concat(F.lit("Summary: "), profile_summary()),
        listed("Biomarkers: ", "biomarkers", mark),
        listed("Prior treatments: ", "prior_treatments", given),
        listed("Comorbidities: ", "comorbidities", lambda x: x["name"]),
        F.when(F.size("labs") > 0, F.concat(F.lit("Labs: "), F.array_join(F.transform(measured, lab), "; "))),
        F.concat(F.lit("Patient note (verbatim): "), _said(c("raw_text"))),
    ]
    return F.substring(F.concat_ws("\n", *parts), 1, limit)


def _terms(*parts: Column) -> Column:
    """Non-blank strings of arrays, trimmed and joined by spaces."""
    flat = F.filter(F.transform(F.concat(*parts), lambda x: F.trim(_said(x))), lambda x: x != "")
    return F.array_join(flat, " ")


def profile_terms() -> Column:
    """The terms of a person that fielded queries add, in order."""
    c = F.col
    mark = lambda b: F.concat(b["name"], F.lit(" "), b["status"], F.lit(" "), _said(b["value"]))
    return F.concat(
        F.array(c("primary_diagnosis"), c("primary_diagnosis_stage")),
        F.slice("secondary_diagnoses", 1, 5),
        F.transform(F.slice("biomarkers", 1, 8), mark),
        F.transform(F.slice("prior_treatments", 1, 8), lambda t: t["name"]),
        F.transform(F.slice("comorbidities", 1, 6), lambda x: x["name"]),
        F.array(
            F.concat(F.lit("ECOG "), c("ecog").cast("string")),
            F.concat(F.lit("Karnofsky "), c("karnofsky").cast("string")),
        ),
    )


def fielded_queries(query: Column, concepts: Column, priorities: Column, risks: Column) -> dict[str, Column]:
    """The query string of each indexed field from a plan's lists and a profile's columns."""
    own, base = profile_terms(), F.array(query)
    names = lambda column: F.transform(F.slice(column, 1, 8), lambda x: x["name"])
    broad = _terms(base, concepts, priorities, own)
    found = {
        "all": broad,
        "condition_title": _terms(base, concepts),
        "eligibility": _terms(base, own, risks, priorities),
        "intervention": _terms(base, priorities, names("prior_treatments"), names("biomarkers")),
        "summary_description": broad,
    }
    return {k: F.when(v == "", query).otherwise(v) for k, v in found.items()}


def concept_summary(concepts: Column) -> Column:
    """``name (id)`` of the first six concepts."""
    one = lambda c: F.concat(c["name"], F.lit(" ("), c["concept_id"], F.lit(")"))
    return F.array_join(F.transform(F.slice(concepts, 1, 6), one), ", ")


# --- questions


def fallback_question(trial: Column, ident: Column, text: Column, mandatory: Column, reason: Column, kind) -> Column:
    """struct of a question that asks for what a criterion needs; ``kind`` maps a text to its data type."""
    short = T.clean(text, 220)
    whole = F.concat(F.lit("For trial "), trial.cast("string"), F.lit(", what patient information confirms this criterion: "), short)
    needed = F.concat(F.lit("Required by trial "), trial.cast("string"), F.lit(" criterion "), ident, F.lit("."))
    why = T.clean(reason, 240)
    return F.struct(
        F.when(F.length(whole) > 260, F.concat(F.rtrim(F.substring(whole, 1, 257)), F.lit("..."))).otherwise(whole).alias("question_text"),
        F.substring(short, 1, 120).alias("data_point"),
        F.lit("Use the time window specified by the trial criterion, if any.").alias("time_window"),
        F.lit("Clinical record, laboratory report, imaging report, or treatment history as applicable.").alias("measurement_context"),
        F.when(why == "", needed).otherwise(why).alias("rationale"),
        kind(short).alias("expected_data_type"),
        F.when(F.coalesce(mandatory, F.lit(True)), "high").otherwise("medium").alias("priority"),
    )


def combined_score(**shares: Column) -> Column:
    """Weighted sum of retrieval, f1, ndcg, questions and dossiers."""
    return sum((F.lit(w) * shares[k] for k, w in X.CHALLENGE_WEIGHTS.items()), F.lit(0.0))
