"""Quality rules as a short-circuit cascade, with built-in functions only.

A rule is a condition that rejects a document.  On a bounded sample each rule
is timed and its rejection share counted; the cascade then asks rules in order
of rejection per cost, and a document's first hit ends its evaluation.  The
order changes the cost and the reported rule, never the verdict.

Defined cases: null text has no words; ties between rules keep their given
order; an empty table keeps the given order; repeated rows are judged each;
other columns are ignored (``measures`` returns its own only).
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import SPACE, documents


class Rule(NamedTuple):
    name: str
    rejects: Column


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in ``words``."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts(runs: Column) -> Column:
        def same(e, other):
            return F.coalesce(F.get(runs, other)["h"] == e["h"], F.lit(False))

        hits = F.transform(runs, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
        return F.array_sort(F.filter(hits, lambda i: i.isNotNull()))

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

        def inside(h: Column) -> Column:
            runs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(
                F.size(F.array_distinct(h)) < F.size(h),
                let(runs, lambda r: let(starts(r), covered)),
            ).otherwise(F.lit(0))

        return F.when(F.size(w) >= 4, let(hashes, inside)).otherwise(F.lit(0))

    return let(words, count).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts that the rules look at."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = documents(docs).select("doc_id", "text", words_of(text).alias("words"), lines.alias("lines"))
    return rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


class Measures(NamedTuple):
    """What rules look at: columns that exist, or expressions over the text."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    repeated_lines: Column
    n_repeat_words: Column


def base_rules(m: Measures) -> list[Rule]:
    return [
        Rule("short", m.n_words < 50),
        Rule("repetition", 100 * m.n_repeat_words > 50 * m.n_words),
    ]


def style_rules(m: Measures) -> list[Rule]:
    """Symbols, repeated lines, word lengths, shouting and capitals."""
    return [
        Rule("symbols", 10 * m.n_symbols > m.n_words),
        Rule("repeated_lines", m.repeated_lines),
        Rule("word_length", (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
        Rule("shouting", 10 * F.length(F.regexp_replace(m.text, "[^!]+", "")) > 3 * m.n_words),
        Rule("capitals", 10 * F.length(F.regexp_replace(m.text, r"[^\p{Lu}]+", "")) > 5 * m.word_chars),
    ]


def order_rules(rows: DataFrame, rules: list[Rule], sample_rows: int = 2000) -> list[Rule]:
    """``rules`` by estimated rejection per second, from at most ``sample_rows`` rows."""
    every = max(1, rows.count() // sample_rows)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(sample_rows).persist()
    try:
        total = sample.count()
        if not total:
            return rules
        worth = []
        for k, rule in enumerate(rules):
            probe = sample.agg(F.count_if(rule.rejects))
            rejected, spent = probe.first()[0], []
            for _ in range(2):
                began = time.perf_counter()
                sample.agg(F.count_if(rule.rejects)).first()
                spent.append(time.perf_counter() - began)
            worth.append((-(rejected / total) / max(min(spent), 1e-6), k))
        return [rules[k] for _, k in sorted(worth)]
    finally:
        sample.unpersist()


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects, or null; later rules aren't evaluated then."""
    chain = F
    for rule in rules:
        chain = chain.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return chain.otherwise(F.lit(None)) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """All measures with base_failed, rejected_by and kept, one row per document."""
    rows = measures(docs)
    m = Measures(
        F.coalesce("text", F.lit("")),
        *map(F.col, ("n_words", "word_chars", "n_symbols")),
        10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        F.col("n_repeat_words"),
    )
    rules = order_rules(rows, style_rules(m), sample_rows)
    short, repetition = base_rules(m)
    return (
        rows.withColumn("base_failed", short.rejects | repetition.rejects)
        .withColumn("rejected_by", verdict([Rule("base", F.col("base_failed")), *rules]))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("text")
    )


def passing(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    All rules take part in one cascade; what a rule measures is computed only
    for documents that reach it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = Measures(
        text,
        F.size(words_of(text)),
        F.length(F.regexp_replace(text, SPACE, "")),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        let(lines, lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x)),
        repeat_words(words_of(text)),
    )
    rules = order_rules(docs.select("doc_id", "text"), [*base_rules(m), *style_rules(m)], sample_rows)
    return docs.where(verdict(rules).isNull())
