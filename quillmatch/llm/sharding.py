"""Balanced label propagation of linked documents over shards, built-ins only.

A link is a shared key; documents of one key are neighbours of each other.
Linked documents start in shards dealt by their ids.  Each round counts every
key's members by shard (one aggregate, never the pairs), lets each member
propose the shard where most of its neighbours are among those with room, and
accepts proposals up to the shard's free quota.  Unlinked documents fill what
is left, so the law ``rows`` holds exactly: shard sizes differ by one at most.

Defined cases: null text counts as empty; texts that are equal are linked,
empty ones too; repeated rows get a place each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import cut, documents


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Members of each shard: as many numbers as there are shards."""
    found = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _longs(values) -> F.Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """(uid, link, shard) for rows (uid, link) after ``rounds`` of moves."""
    state = cut(linked.select("uid", "link", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard")))
    for k in range(rounds):
        loads = _loads(state, shards)
        free = [max(0, quota - n) for n in loads]
        here = state.groupBy("link", "shard").agg(F.count("*").alias("n"))
        # neighbours by shard; a shard without room counts only for those in it
        best = here.groupBy("link").agg(
            F.max(
                F.when(
                    F.get(_longs(free), F.col("shard")) > 0,
                    F.struct("n", F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("to")),
                )
            ).alias("best")
        )
        wish = (
            state.join(best, "link")
            .join(here.withColumnRenamed("n", "mine"), ["link", "shard"])
            .where("best is not null and best.to <> shard")
            .where("best.n > mine or best.n = mine and best.tie > xxhash64(link, shard)")
            .select("uid", F.col("best.to").alias("to"))
        )
        wish = cut(wish)
        asked = {r["to"]: r["count"] for r in wish.groupBy("to").count().collect()}
        if not asked:
            break
        # the share of a shard's proposals that its quota has room for
        share = F.array(*[F.lit(min(1.0, free[s] / asked[s]) if asked.get(s) else 0.0) for s in range(shards)])
        draw = F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        moves = wish.where(draw < F.get(share, F.col("to")))
        state = cut(
            state.join(moves, "uid", "left").select("uid", "link", F.coalesce("to", "shard").alias("shard"))
        )
    return state


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per document."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.crc32(text.cast("binary"))).alias("link"),
    )
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    total = rows.count()
    # shard s takes rows [total * s / shards, total * (s + 1) / shards) of a list as long as the table
    want = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    several = rows.groupBy("link").agg(F.count("*").alias("k")).where("k > 1").select("link")
    linked = rows.select("uid", "link").join(several, "link", "left_semi")
    state = propagate(linked, shards, min(want, default=0), rounds)
    listed = rows.join(state.select("uid", "shard"), "uid", "left")
    # number all rows by (shard, link), the unlinked last: ids within sorted partitions plus their offsets
    listed = listed.select("*", F.coalesce("shard", F.lit(shards)).alias("label")).drop("shard")
    sorted_ = listed.repartitionByRange("label", "link", "uid").sortWithinPartitions("label", "link", "uid")
    numbered = cut(sorted_.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    counts = numbered.groupBy(part.alias("part"), "label").agg(F.count("*").alias("n"))
    # one row per partition of the table, however many documents it has
    starts = counts.groupBy("part").agg(F.sum("n").alias("n")).selectExpr(
        "part", "sum(n) over (order by part) - n as start"
    )
    per_label = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    have = [per_label.get(s, 0) for s in range(shards)]
    first = [0, *accumulate(have)]
    over = [max(0, h - w) for h, w in zip(have, want)]
    over_first = [0, *accumulate(over)]
    lack = [max(0, w - h) for h, w in zip(have, want)]
    lack_first = [0, *accumulate(lack)]
    row = F.shiftleft(F.lit(1).cast("long"), 33) - 1
    g = (F.col("start") + F.col("m").bitwiseAND(row)).alias("g")
    placed = numbered.join(F.broadcast(starts), part == F.col("part")).select(
        "doc_id", "size", "text_crc32", "label", g
    )
    rank = F.col("g") - F.get(_longs(first), F.col("label"))
    stays = (F.col("label") < shards) & (rank < F.get(_longs([*want, 0]), F.col("label")))
    spare = F.when(
        F.col("label") < shards,
        F.get(_longs(over_first), F.col("label")) + rank - F.get(_longs([*want, 0]), F.col("label")),
    ).otherwise(F.lit(over_first[-1]) + rank)
    placed = placed.select("doc_id", "size", "text_crc32", "label", rank.alias("rank"), stays.alias("stays"), spare.alias("spare"))
    # the shard whose gap the spare row falls into
    gap = F.size(F.filter(_longs(lack_first[1:]), lambda e: e <= F.col("spare")))
    placed = placed.withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(gap).cast("int"))
    into = F.get(_longs([min(h, w) for h, w in zip(have, want)]), F.col("shard"))
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(
        into + F.col("spare") - F.get(_longs(lack_first), F.col("shard"))
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
