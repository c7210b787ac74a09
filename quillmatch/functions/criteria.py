"""Column functions over criterion texts: headings, types, question types, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.text import once, strip


def any_of(text: Column, patterns) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def bare_header(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"^\s*(?:[-*•·]|\d+\.)\s*", "")


def is_header(text: Column) -> Column:
    """Headings by name, by reference, or short lines that end in a colon and demand nothing."""

    def judged(bare: Column) -> Column:
        def by_name(low: Column) -> Column:
            short = bare.endswith(":") & (F.regexp_count(low, F.lit(X.HEADER_WORD)) <= 8) & ~low.rlike(X.HEADER_NOT)
            return (bare != "") & (low.isin(list(X.HEADER_HINTS)) | any_of(low, X.HEADER_REFERENCES) | short)

        return once(strip(F.regexp_replace(F.lower(bare), ":+$", "")), by_name)

    return once(bare_header(F.coalesce(text, F.lit(""))), judged)


def header_action(text: Column) -> Column:
    low = strip(F.regexp_replace(F.lower(bare_header(text)), ":+$", ""))
    return F.when(is_header(text), F.when(any_of(low, X.HEADER_DROP), "drop").otherwise("merge"))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def is_section_header(text: Column) -> Column:
    """Whether ``criterion_type`` is section_header, without trying the patterns of other types."""
    return is_header(text) | any_of(padded(text), [p for name, patterns in X.CRITERION_TYPES if name == "section_header" for p in patterns])


def criterion_type(text: Column) -> Column:
    def typed(low: Column) -> Column:
        out = F
        for name, patterns in X.CRITERION_TYPES:
            out = out.when(any_of(low, patterns), name)
        return out.otherwise("other")

    return F.when(is_header(text), "section_header").otherwise(once(padded(text), typed))


def question_type(text: Column) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F
    for name, hints in X.QUESTION_HINTS:
        hit = F.contains(low, F.lit(hints[0]))
        for h in hints[1:]:
            hit = hit | F.contains(low, F.lit(h))
        out = out.when(hit, name)
    return out.otherwise("text")


def line_chunks(texts: DataFrame, key: str) -> DataFrame:
    """(key, n, chunk): bullets start chunks, blank lines end them, headings stand alone, others continue."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", strip(F.col("raw")))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike(X.BULLET), "bullet").when(is_header(F.col("line")), "header").otherwise("more")
    w = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    starts = F.col("kind").isin("bullet", "header") | F.coalesce(F.col("before").isin("blank", "header"), F.lit(True))
    content = F.when(F.col("kind") == "bullet", strip(F.regexp_extract("line", X.BULLET, 1))).otherwise(F.col("line"))
    lines = lines.where("kind <> 'blank'").withColumn("content", content)
    lines = lines.withColumn("n", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    return lines.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("x")).select(
        key, "n", F.array_join(F.transform("x", lambda c: c["content"]), " ").alias("chunk")
    )


def cap_balanced(criteria: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` criteria of each key: half of each polarity (rounded up for inclusions), then source order."""
    by = W.partitionBy(key, "polarity").orderBy("pos")
    whole = W.partitionBy(key)
    rows = criteria.withColumn("nth", F.row_number().over(by)).withColumn("n_exc", F.count_if(F.col("polarity") == "exclusion").over(whole))
    quota = F.when(F.col("n_exc") > 0, (most + 1) // 2).otherwise(most)
    first = F.when(F.col("polarity") == "inclusion", F.col("nth") <= quota).otherwise(F.col("nth") <= most - quota)
    order = whole.orderBy(F.when(first, 0).otherwise(1), "pos")
    rows = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    return rows.select(*criteria.columns)


def triage_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({X.HEADER_WORD})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(X.TRIAGE_STOPWORDS)))


def triage_facts(text: Column) -> dict[str, Column]:
    """name: all that triage reads off a criterion's text alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    signals = {f"signal_{i}": low.rlike(p) for i, (p, _) in enumerate(X.TRIAGE_WORDS)}
    return {"words": triage_terms(low), **signals, "admin": any_of(low, X.TRIAGE_ADMIN), "broad": low.rlike(X.TRIAGE_BROAD)}


def triage_score(facts: dict[str, Column], kind: Column, polarity: Column, mandatory: Column, terms: Column, typed: Column | None = None) -> Column:
    """How much a criterion tells: base by type, raised by signals, lowered for administration, 0 at least.

    ``facts`` as of `triage_facts`; ``typed``: whether the criterion has a predicate.
    """
    typed = F.lit(False) if typed is None else typed
    base = F
    for k, v in X.TRIAGE_BASE.items():
        base = base.when(kind == k, F.lit(v))
    exclusion = polarity == "exclusion"
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        base.otherwise(2.0)
        + add(exclusion, 0.4)
        + add(exclusion & kind.isin(list(X.TRIAGE_STRONG_EXCLUSIONS)), 0.8)
        + add(mandatory, 0.3)
        + add(typed, 0.4)
        + F.least(F.lit(3.0), 0.7 * F.size(F.array_intersect(terms, facts["words"])))
    )
    for i, (_, v) in enumerate(X.TRIAGE_WORDS):
        score = score + add(facts[f"signal_{i}"], v)
    score = score - add(facts["admin"], 3.5) - add(facts["broad"], 0.6)
    return F.greatest(score, F.lit(0.0))


def triage_reasons(facts: dict[str, Column], kind: Column, polarity: Column, mandatory: Column, terms: Column, typed: Column) -> Column:
    """What raised or lowered `triage_score`, in order."""
    exclusion = polarity == "exclusion"
    matched = F.array_sort(F.array_intersect(terms, facts["words"]))
    names = ("disease_severity", "molecular_status", "functional_status")
    return F.array_compact(
        F.array(
            F.concat(F.lit("type:"), kind),
            F.when(exclusion, "exclusion"),
            F.when(exclusion & kind.isin(list(X.TRIAGE_STRONG_EXCLUSIONS)), "high_signal_exclusion"),
            F.when(mandatory, "mandatory"),
            F.when(typed, "typed_predicate"),
            F.when(F.size(matched) > 0, F.concat(F.lit("patient_match:"), F.array_join(F.slice(matched, 1, 4), ","))),
            *[F.when(facts[f"signal_{i}"], name) for i, name in enumerate(names)],
            F.when(facts["admin"], "administrative_penalty"),
            F.when(facts["broad"], "broad_organ_function"),
        )
    )


def lookup_keys(term: Column) -> Column:
    """Keys to try in a thesaurus, in order: whole, without a qualifier, its three longest words."""
    whole = F.trim(F.regexp_replace(F.lower(F.regexp_replace(term, r"[()]", " ")), r"\s+", " "))
    short = [F.when(F.startswith(whole, F.lit(q)), F.substring(whole, F.lit(len(q) + 1), F.length(whole))) for q in X.QUALIFIERS]
    words = F.filter(F.split(whole, " "), lambda w: w != "")
    ranked = F.sort_array(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    longest = F.slice(F.transform(ranked, lambda r: r["w"]), 1, 3)
    return F.array_compact(F.concat(F.array(whole, *short), longest))


def data_type(text: Column) -> Column:
    return _alias(text, X.TYPE_ALIASES)


def priority_alias(text: Column) -> Column:
    """A priority's own name for one of its aliases; other texts in their normal form."""
    return _alias(text, X.PRIORITY_ALIASES)


def _alias(text: Column, names: dict[str, str]) -> Column:
    t = F.replace(F.replace(F.lower(F.trim(text)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    out = F
    for k, v in names.items():
        out = out.when(t == k, v)
    return out.otherwise(t)
