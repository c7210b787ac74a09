"""Draws documents that look like a target: hashed n-gram importance weights.

Higher-order functions turn each text into an array of hash buckets.  Bucket
totals of the documents and of the target are the only thing that scoring
shuffles (partial counts, at most ``buckets`` rows a task); they give a gain
per bucket, a literal array that every document's buckets are looked up in and
summed, without exploding it.  Gumbel noise from a hash of the id turns the
weights into a draw without replacement: the highest scores are taken.

The draw sorts only what an approximate quantile leaves (a percent more than
needed, counted before use), by range partitions whose rows are numbered by
their own offsets.

Defined cases: null text has no words, weight 0; a null doc_id draws the hash
of an empty id; ties go to the smaller doc_id, null first; repeated rows are
counted, scored and ranked each; empty documents give no rows; an empty target
leaves t and T at 0; very long texts count whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import cut

#: Everything below U+0080 that is neither a digit nor a lower-case letter.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, BREAK), "")


def features(words: Column, longest: int) -> Column:
    """All runs of one to ``longest`` words, joined by a space."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return words if longest == 1 else F.concat(words, *[runs(n) for n in range(2, longest + 1)])


def bucketed(rows: DataFrame, keep: list, longest: int, buckets: int) -> DataFrame:
    """The columns ``keep``, n_words and the bucket of every feature of each text."""
    cut_up = rows.select(*keep, words(F.col("text")).alias("words"))
    bucket = F.transform(
        features(F.col("words"), longest), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")
    )
    names = [c for c in cut_up.columns if c != "words"]
    return cut_up.select(*names, F.size("words").alias("n_words"), bucket.alias("buckets"))


def totals(rows: DataFrame, buckets: int) -> list[int]:
    """How many features fall into each bucket: ``buckets`` numbers."""
    counted = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    found = dict(map(tuple, counted.collect()))
    return [found.get(b, 0) for b in range(buckets)]


def gains(own: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed bucket shares, rounded down."""
    size, s_all, t_all = len(own), sum(own), sum(target)
    return [
        math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
        for s, t in zip(own, target)
    ]


def summed(buckets: Column, gain: list[int]) -> Column:
    """Sum of the gains of ``buckets``; the gains are one literal array after constant folding."""
    book = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.element_at(book, b + 1))


def noise(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel draw from a hash of the id, in thousandths, rounded down."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` with rank 1 to ``drawn`` by score, then doc_id; null beyond."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("uid").asc()]
    listed = rows.withColumn("uid", F.monotonically_increasing_id())
    numbered = cut(
        listed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    )
    part = F.shiftright("m", 33)
    # one row per partition of the sorted rows, however many rows it has
    starts = numbered.groupBy(part.alias("part")).count().selectExpr("part", "sum(count) over (order by part) - count as start")
    place = F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1) + 1
    return numbered.join(F.broadcast(starts), part == F.col("part")).select(
        *rows.columns, F.when(place <= drawn, place).alias("rank")
    )


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 1,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    rows = bucketed(docs, [F.col("doc_id").cast("long").alias("doc_id")], longest, buckets)
    gain = gains(totals(rows, buckets), totals(bucketed(target, [], longest, buckets), buckets))
    weight = summed(F.col("buckets"), gain)
    scored = rows.select(
        "doc_id", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), F.col("n_words") >= min_words
    ).toDF("doc_id", "n_features", "weight", "able")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    # a percent more than is drawn; the quantile's rank is off by a ten-thousandth at most
    share = max(0.0, 1 - percent / 100 - 0.01)
    able, near = scored.where("able").agg(F.count("*"), F.percentile_approx("score", share, 10_000)).first()
    drawn = percent * able // 100
    fits = F.col("able") & (F.col("score") >= F.lit(near).cast("long"))
    if drawn and scored.where(fits).count() < drawn:
        fits = F.col("able")
    names = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    rest = scored.where(~fits).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(fits).select(*names), drawn).unionByName(rest)
