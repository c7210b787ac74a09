"""From eligibility texts to criterion rows, and which of them are evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import criteria as C
from quillmatch.functions import fixed as X
from quillmatch.functions import text as T
from quillmatch.operators.retrieval import fits

SENTENCE = r"(?<=[.;])\s+(?=[A-Z])"
LEGACY = r"\n\s*(?:[-*•·]|\d+\.)\s*|\n\s*\n"


def sides(trials: DataFrame) -> DataFrame:
    """(trial, polarity, text) of the non-empty inclusion and exclusion texts."""
    parts = [F.struct(F.lit(p).alias("polarity"), F.col(f"{p}_text").alias("text")) for p in ("inclusion", "exclusion")]
    rows = trials.select("trial", F.explode(F.array(*parts)).alias("x")).select("trial", "x.polarity", "x.text")
    return rows.where("text <> ''")


def legacy_chunks(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, chunk) by bullets and blank lines, or by sentences where these give one chunk."""
    parts = F.split("text", LEGACY)
    parts = F.when(F.size(parts) <= 1, F.split("text", SENTENCE)).otherwise(parts)
    kept = F.filter(F.transform(parts, T.strip), lambda x: x != "")
    return texts.select(*keys, F.posexplode(kept).alias("n", "chunk")).select(*keys, (F.col("n") + 1).alias("n"), "chunk")


def chunks(texts: DataFrame) -> DataFrame:
    """(trial, polarity, pos, chunk): lines, or sentences where the lines make one chunk at most."""
    keyed = texts.select(F.struct("trial", "polarity").alias("side"), "text")
    lines = C.line_chunks(keyed, "side")
    several = lines.groupBy("side").agg(F.count("*").alias("k")).where("k > 1").select("side")
    spoken = keyed.join(several, "side", "left_anti").select("side", F.posexplode(F.split("text", SENTENCE)).alias("n", "chunk"))
    rows = lines.join(several, "side", "left_semi").unionByName(spoken.withColumn("n", F.col("n").cast("long")))
    return rows.select("side.trial", "side.polarity", F.col("n").alias("pos"), T.strip(F.col("chunk")).alias("chunk")).where("chunk <> ''")


def merged(rows: DataFrame) -> DataFrame:
    """(trial, polarity, n, chunk, headers, dropped): headings go, or lead the next chunk as ``A / B: chunk``.

    Rows with a null ``n`` hold headings that no chunk follows.
    """
    rows = rows.withColumn("action", C.header_action(F.col("chunk")))
    w = W.partitionBy("trial", "polarity").orderBy("pos")
    before = F.sum(F.when(F.col("action").isNull(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("n", F.coalesce(before, F.lit(0)) + 1)
    name = T.strip(F.regexp_replace("chunk", ":+$", ""))
    groups = rows.groupBy("trial", "polarity", "n").agg(
        F.sort_array(F.collect_list(F.when(F.col("action") == "merge", F.struct("pos", name.alias("t"))))).alias("heads"),
        F.max(F.when(F.col("action").isNull(), F.col("chunk"))).alias("body"),
        F.count_if(F.col("action") == "drop").alias("gone"),
    )
    lead = F.array_join(F.transform("heads", lambda h: h["t"]), " / ")
    chunk = F.when(F.size("heads") > 0, F.concat(lead, F.lit(": "), F.col("body"))).otherwise(F.col("body"))
    alone = F.col("body").isNull()
    return groups.select(
        "trial",
        "polarity",
        F.when(~alone, F.col("n")).alias("n"),
        chunk.alias("chunk"),
        F.when(alone, 0).otherwise(F.size("heads")).alias("headers"),
        (F.col("gone") + F.when(alone, F.size("heads")).otherwise(0)).alias("dropped"),
    )


def segment(trials: DataFrame, header_policy: bool = True) -> DataFrame:
    """trial, polarity, n, id (``i_1``, ``e_1``, gaps where a heading went), type, text, annotated, has_negation."""
    texts = sides(trials)
    rows = merged(chunks(texts)).where("n is not null") if header_policy else legacy_chunks(texts, ["trial", "polarity"])
    if header_policy:  # not by the type: a filter on it would try all patterns twice
        rows = rows.where(~C.is_section_header(F.col("chunk")))
    kind = C.criterion_type(F.col("chunk"))
    rows = rows.select("trial", "polarity", "n", F.col("chunk").alias("text"), kind.alias("type"))
    text = F.col("text")
    return rows.select(
        "trial",
        "polarity",
        "n",
        F.concat(F.when(F.col("polarity") == "inclusion", "i_").otherwise("e_"), F.col("n").cast("string")).alias("id"),
        F.when(F.col("type") == "section_header", "other").otherwise(F.col("type")).alias("type"),
        "text",
        T.annotate_temporal(T.annotate_negation(text)).alias("annotated"),
        T.has_negation(text).alias("has_negation"),
    )


def segment_counts(trials: DataFrame) -> DataFrame:
    """trial, section_headers_merged, section_headers_dropped."""
    rows = merged(chunks(sides(trials)))
    late = (F.col("n").isNotNull() & C.is_section_header(F.col("chunk"))).cast("int")
    return rows.groupBy("trial").agg(
        F.sum("headers").alias("section_headers_merged"), F.sum(F.col("dropped") + late).alias("section_headers_dropped")
    )


def classified(segmented: DataFrame, payload: DataFrame) -> DataFrame:
    """Segments with a classifier's type and text where it gave some; the first valid row of an id counts, order stays.

    ``payload``: trial, id, place, type, text.  Unknown types make a row invalid; a null type keeps the segment's.
    """
    valid = payload.where(F.col("type").isNull() | (F.col("type") == "") | F.col("type").isin(list(X.TRIAGE_BASE)))
    first = valid.groupBy("trial", "id").agg(F.min_by(F.struct("type", "text"), "place").alias("said"))
    said = lambda x: F.when(F.coalesce(F.col(f"said.{x}"), F.lit("")) != "", F.col(f"said.{x}")).otherwise(F.col(x))
    rows = segmented.join(first, ["trial", "id"], "left")
    return rows.select(*[said(c).alias(c) if c in ("type", "text") else F.col(c) for c in segmented.columns])


RAW = (
    "id string, polarity string, type string, raw_text string, is_mandatory boolean, has_negation boolean, "
    "extraction_confidence double, triage_score double, predicate struct<op:string,feature:string,value:string>"
)


def coerced(json: Column) -> Column:
    """A criterion struct with defaults from a JSON object; null if its polarity or type is unknown."""
    raw = F.from_json(json, RAW)

    def build(r: Column) -> Column:
        text = T.strip(F.coalesce(r["raw_text"], F.lit("")))
        kind = F.when(F.coalesce(r["type"], F.lit("")) == "", "other").otherwise(r["type"])
        polarity = F.coalesce(r["polarity"], F.lit("inclusion"))
        p = r["predicate"]
        full = (F.coalesce(p["op"], F.lit("")) != "") & (F.coalesce(p["feature"], F.lit("")) != "")
        out = F.struct(
            F.when(F.coalesce(r["id"], F.lit("")) == "", "x_0").otherwise(r["id"]).alias("id"),
            polarity.alias("polarity"),
            kind.alias("type"),
            text.alias("raw_text"),
            F.coalesce(r["is_mandatory"], F.lit(True)).alias("is_mandatory"),
            F.coalesce(r["has_negation"], T.has_negation(text)).alias("has_negation"),
            F.coalesce(r["extraction_confidence"], F.lit(1.0)).alias("extraction_confidence"),
            F.coalesce(r["triage_score"], F.lit(0.0)).alias("triage_score"),
            F.when(full, p).alias("predicate"),
        )
        known = polarity.isin("inclusion", "exclusion") & kind.isin(list(X.TRIAGE_BASE))
        return F.when(known, out)

    return T.once(raw, build)


def with_facts(criteria: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``criteria`` with `triage_facts` and text_type of each text; where the different texts are few (counted), each is read once.

    ``texts``: rows that hold every text of ``criteria``, where there are some that take less work.
    """
    facts = C.triage_facts(F.col("text")) | {"text_type": C.criterion_type(F.col("text"))}
    cells = [f.alias(name) for name, f in facts.items()]
    texts = (criteria if texts is None else texts).select("text").distinct()
    if not fits(texts, 3):  # a text's words take about as much again
        return criteria.select("*", *cells)
    known = texts.select(F.col("text").alias("_text"), *cells)
    return criteria.join(F.broadcast(known), F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text")


def triaged(criteria: DataFrame, terms: Column, most: int, texts: DataFrame | None = None) -> DataFrame:
    """``criteria`` with score, reasons, selected, and the place among the five best that were dropped.

    ``criteria``: trial, pos, polarity, type, text, mandatory, typed; ``texts`` as of `with_facts`.  At most ``most`` of a
    trial are selected (all if ``most`` is 0): half of each polarity (rounded up for inclusions; all if there are no
    exclusions), by score, then the best of the rest.
    """
    c = F.col
    rows = with_facts(criteria, texts).withColumn("type", F.when(c("type") == "other", c("text_type")).otherwise(c("type")))
    args = ({name: c(name) for name in C.triage_facts(c("text"))}, c("type"), c("polarity"), c("mandatory"), terms, c("typed"))
    rows = rows.withColumn("score", F.round(C.triage_score(*args), 6)).withColumn("reasons", C.triage_reasons(*args))
    rows = rows.select(*criteria.columns, "score", "reasons")
    whole = W.partitionBy("trial")
    best = [F.desc("score"), F.asc("pos")]
    # by trial first: rows dealt by trial need not move again for its polarities
    rows = rows.withColumn("n_exc", F.count_if(c("polarity") == "exclusion").over(whole)).withColumn("n_all", F.count("*").over(whole))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("trial", "polarity").orderBy(*best)))
    quota = F.when(c("n_exc") > 0, (most + 1) // 2).otherwise(most)
    first = F.when(c("polarity") == "inclusion", c("nth") <= quota).otherwise(c("nth") <= most - quota)
    rows = rows.withColumn("turn", F.row_number().over(whole.orderBy(F.when(first, 0).otherwise(1), *best)))
    rows = rows.withColumn("selected", (c("n_all") <= most) | F.lit(most <= 0) | (c("turn") <= most))
    place = F.row_number().over(W.partitionBy("trial", "selected").orderBy(*best))
    rows = rows.withColumn("place", place)
    return rows.select(
        *criteria.columns, "score", "reasons", "selected", F.when(~c("selected") & (c("place") <= 5), c("place")).alias("dropped_place")
    )


def triage_summary(rows: DataFrame) -> DataFrame:
    """One row over all trials of `triaged`: totals and the mean score of what was selected."""
    by = rows.groupBy("trial").agg(
        F.count("*").alias("seen"), F.count_if("selected").alias("selected"), F.round(F.avg(F.when(F.col("selected"), F.col("score"))), 3).alias("mean")
    )
    weighted = F.sum(F.col("mean") * F.col("selected")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("selected")))
    return by.agg(
        F.count("*").alias("trials_with_triage"),
        F.sum("seen").alias("total_seen"),
        F.sum("selected").alias("selected"),
        F.sum(F.col("seen") - F.col("selected")).alias("dropped"),
        F.round(F.coalesce(weighted, F.lit(0.0)), 3).alias("mean_selected_score"),
    )


def dropped_first(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of all trials' dropped criteria: a report, so the limit is the feature."""
    listed = rows.where("dropped_place is not null").select("trial", "pos", "type", "polarity", F.round("score", 3).alias("score"))
    return listed.orderBy(F.desc("score"), "trial", "pos").limit(k)
