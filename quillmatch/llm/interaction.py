"""How filters interact: what each removes after every subset of the others.

One pass over the texts gives each document the set of filters that it fails.
Documents are counted by (part, failed set, labels); each count contributes to
the edges of the lattice of filter subsets: an edge is (filters already
applied, next filter), so n filters have n * 2**(n - 1) edges, 80 for five.
Every order of the filters is a path through the lattice, and its steps are
looked up among the aggregated edges: 120 paths of five steps never touch a
document again.

The duplicate filter needs no join of documents with each other: all documents
fail it but the first of each text, so the first ones are counted and taken
from the rest.

Defined cases: null text is empty; null lang is the part ''; a null doc_id has
no labels and never fails the duplicate filter; rows that repeat an id and a
text are no copies of each other (none has the smaller id); of several label
rows of an id, any 1 counts; an empty table gives no rows, since it has no
part; very long texts are measured whole; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import cut
from quillmatch.llm.quality import words_of


class Fails(NamedTuple):
    name: str
    condition: Column


def text_filters(text: Column, n_words: Column, n_distinct: Column) -> list[Fails]:
    """Too short, too monotonous, too many capitals, control symbols."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        Fails("A", n_words < 100),
        Fails("B", 100 * n_distinct < 80 * n_words),
        Fails("C", 100 * capitals > 10 * F.length(text)),
        Fails("D", text.rlike("[#$%&*|]")),
    ]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, digest, mask, good, toxic, part, m: how often each row occurs, with its labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        words_of(text).alias("words"),
    )
    rows = rows.select(
        "doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")
    )
    failed = text_filters(F.col("text"), F.col("n_words"), F.col("n_distinct"))
    mask = F.lit(0)
    for k, f in enumerate(failed):
        mask = mask + F.when(f.condition, F.lit(1 << k)).otherwise(F.lit(0))
    counted = (
        rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), mask.alias("mask"))
        .groupBy("doc_id", "digest", "mask", "part")
        .agg(F.count("*").alias("m"))
    )
    said = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    no = F.lit(False)
    return cut(
        counted.join(said, "doc_id", "left").select(
            "doc_id", "digest", "mask", "part", "m", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
        )
    )


def _cells(rows: DataFrame, copies: int) -> DataFrame:
    """part, mask, good, toxic, n: documents by all that the edges need; ``copies`` is the duplicate filter's bit."""
    key = ("part", "mask", "good", "toxic")
    every = rows.groupBy(*key).agg(F.sum("m").alias("n"))
    known = rows.where("doc_id is not null")
    # all rows of one id and text, whatever their parts, are first together
    one = known.groupBy("digest", "mask", "doc_id", "good", "toxic").agg(
        F.sort_array(F.collect_list(F.struct("part", "m"))).alias("parts")
    )
    first = (
        one.groupBy("digest", "mask")
        .agg(F.min(F.struct("doc_id", "good", "toxic", "parts")).alias("first"))
        .select("mask", "first.good", "first.toxic", F.explode("first.parts").alias("p"))
        .groupBy(F.col("p.part").alias("part"), "mask", "good", "toxic")
        .agg(F.sum("p.m").alias("n"))
    )
    lone = rows.where("doc_id is null").groupBy(*key).agg(F.sum("m").alias("n"))
    firsts = first.select(*key, "n").unionByName(lone)
    failing = F.col("mask").bitwiseOR(F.lit(copies)).alias("mask")
    return (
        every.select("part", failing, "good", "toxic", "n")
        .unionByName(firsts.select("part", failing, "good", "toxic", (-F.col("n")).alias("n")))
        .unionByName(firsts)
        .groupBy(*key)
        .agg(F.sum("n").alias("n"))
    )


def edges(cells: DataFrame, filters: int) -> DataFrame:
    """part, applied, next and the counts of every edge of the lattice, zeros included."""
    all_edges = [(s, 1 << f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    edge = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in all_edges])
    met = cells.select("*", F.explode(edge).alias("e")).select("*", "e.applied", "e.next")
    fails, gone = F.col("mask").bitwiseAND(F.col("next")) > 0, F.col("mask").bitwiseAND(F.col("applied")) > 0

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).cast("long").alias(name)

    return met.groupBy("part", "applied", "next").agg(
        total(~fails & ~gone, "kept"),
        total(fails & ~gone, "removed"),
        total(fails & gone, "redundant"),
        total(F.col("mask") == F.col("next"), "unique_fails"),
        total(fails & ~gone & F.col("good"), "good_lost"),
        total(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of each step of every filter order.

    ``names`` are one letter per filter: the four of ``text_filters`` and the duplicate filter.
    """
    found = edges(_cells(_labelled(docs, labels), 1 << (len(names) - 1)), len(names))
    bit = {name: 1 << k for k, name in enumerate(names)}
    steps = [
        ("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[order[k]])
        for order in permutations(names)
        for k in range(len(names))
    ]
    # as many rows as the orders have steps: 600 for five filters
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    return (
        found.join(F.broadcast(paths), ["applied", "next"])
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "next")))
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        )
    )
