"""Benchmark decontamination by SimHash over item-sized windows, built-ins only.

Texts are lower-cased and cut into words; a window holds as many words as an
item (the whole document if that is shorter).  An item and a window are alike
if the weighted Jaccard similarity of their ``shingle``-word shingles, counted
with multiplicity, reaches ``percent``.  The stages:

1. a window that shares no shingle with an item of its size has similarity 0,
   so only windows that hold a shingle of some item of their size are looked at;
   they come in runs of neighbouring starts, at most ``RUN`` to a row;
2. every window of a run gets a 64-bit SimHash from rolling lane sums: one
   shingle is added and one dropped from word to word;
3. fingerprints are cut into ``BLOCKS`` blocks.  The items' blocks are listed
   with up to ``radius // BLOCKS`` flipped bits, and windows meet them in an
   equi-join on size, block and value: by the pigeonhole principle every pair
   within ``radius`` shares an entry.  The distance is then checked; no pair
   passes but through its fingerprints;
4. the exact weighted similarity verifies the candidates.

At similarity 0.8 a bit differs with probability 0.15: 9.7 of 64 are expected,
and more than the default radius of 19 has a probability under 0.001; of
unrelated pairs fewer than 0.1 % are within it.

Defined cases: null or blank texts and items have no shingles and match
nothing; a text or item under ``shingle`` words is one shingle; very long items
get wider lanes (up to 2**29 shingles); items that repeat an id with different
texts are items each; repeated rows get equal results; empty tables are fine on
either side; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import cut, documents
from quillmatch.llm.quality import let, words_of

#: Rows of item shingles, of index entries or of runs up to this many are sent to every task; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Starts of one row of windows.
RUN = 256
BLOCKS = 5


def runs(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def lane_width(longest: int) -> int:
    """Bits of a lane that counts up to ``longest`` with two bits to spare."""
    return 16 if longest < 1 << 13 else 32


def fingerprints(g: str, m: str, width: int) -> Column:
    """SimHash of every run of ``m`` entries of column ``g``: bit b is set if more than half of the entries have it.

    Bit b is counted in lane b // width of sum b % width, so that one shift and
    one mask spread a hash over a sum's lanes.
    """
    ones = sum(1 << (width * i) for i in range(64 // width))
    guard = 1 << (width - 2)

    def spread(h: str, j: int) -> str:
        return f"(shiftrightunsigned({h}, {j}) & {ones}L)"

    def sums(one) -> str:
        return ", ".join(f"'sum{j}', {one(j)}" for j in range(width))

    # a lane reaches the guard bit if its count is m / 2 + 1 or more
    lift = f"(({guard}L - {m} div 2 - 1) * {ones}L)"
    signs = " | ".join(
        f"shiftleft(shiftrightunsigned((s.sum{j} + {lift}) & {ones * guard}L, {width - 2}), {j})" for j in range(width)
    )
    first = (
        f"aggregate(slice({g}, 1, {m}), named_struct({sums(lambda j: '0L')}), "
        f"(s, h) -> named_struct({sums(lambda j: f's.sum{j} + ' + spread('h', j))}))"
    )
    moved = sums(lambda j: f"s.sum{j} + {spread(f'get({g}, i + {m})', j)} - {spread(f'get({g}, i)', j)}")
    rolled = (
        f"aggregate(sequence(0, size({g}) - {m}), named_struct({sums(lambda j: f'f.sum{j}')}, 'out', cast(array() as array<bigint>)), "
        f"(s, i) -> named_struct({moved}, 'out', concat(s.out, array({signs}))), s -> s.out)"
    )
    return F.expr(f"get(transform(array({first}), f -> {rolled}), 0)")


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    at = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def block(h: Column, bounds: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(h, bounds[0]).bitwiseAND(F.lit((1 << bounds[1]) - 1).cast("long")).cast("int")


def flips(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def prepare_items(items: DataFrame, shingle: int) -> DataFrame:
    """item (a hash of id and text), item_id, n (words), k (shingle length), shingles."""
    rows = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select("item_id", F.xxhash64("item_id", "text").alias("item"), words_of(F.lower("text")).alias("w"))
    rows = rows.where("size(w) > 0").dropDuplicates(["item"])
    n = F.size("w")
    grams = F.coalesce(*[F.when(n == s, runs(F.col("w"), s)) for s in range(1, shingle)], runs(F.col("w"), shingle))
    return rows.select("item", "item_id", n.alias("n"), F.least(n, F.lit(shingle)).alias("k"), grams.alias("shingles"))


def window_runs(docs: DataFrame, items: DataFrame, sizes: list[int], percent: int) -> DataFrame:
    """uid, n, k, m, lo, g: starts ``lo`` and following of windows that share a shingle with an item of ``n``
    words; ``m`` shingles to a window, ``g`` the shingles of them all."""
    known = items.select("n", F.explode("shingles").alias("known")).distinct()
    if (items.select(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    words = docs.select("uid", words_of(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    grams = None
    for k in sizes:
        part = words.select(
            "uid", F.size("w").alias("n_words"), F.lit(k).alias("k"), F.posexplode(runs(F.col("w"), k)).alias("pos", "h")
        )
        grams = part if grams is None else grams.unionAll(part)
    m = F.least("n", "n_words") - F.col("k") + 1
    hits = (
        grams.join(known, F.col("h") == F.col("known"))
        .select("uid", "n", "k", "n_words", m.alias("m"), "pos")
        .where(100 * F.col("m") >= percent * (F.col("n") - F.col("k") + 1))
    )
    key = ["uid", "n", "k", "m", "n_words"]
    near = hits.groupBy(*key, F.floor(F.col("pos") / RUN).alias("c")).agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    lo = F.greatest(F.lit(0), F.col("a") - F.col("m") + 1)
    hi = F.least("b", F.col("n_words") - F.col("k") + 1 - F.col("m"))
    near = near.select(*key, lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    part = F.sequence(F.floor(F.col("lo") / RUN).cast("int"), F.floor(F.col("hi") / RUN).cast("int"))
    spans = near.select("*", F.explode(part).alias("c"))
    spans = spans.groupBy("uid", "n", "k", "m", "c").agg(
        F.min(F.greatest("lo", F.col("c") * RUN)).alias("lo"), F.max(F.least("hi", F.col("c") * RUN + RUN - 1)).alias("hi")
    )
    spans = cut(spans)
    asked = spans.groupBy("uid").agg(F.collect_list(F.struct("n", "k", "m", "lo", "hi")).alias("spans"))
    if spans.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)

    def cell(s):
        part = F.slice("w", s["lo"] + 1, s["hi"] - s["lo"] + s["m"] + s["k"] - 1)
        g = let(part, lambda words: F.coalesce(*[F.when(s["k"] == k, runs(words, k)) for k in sizes]))
        return F.struct(s["n"].alias("n"), s["k"].alias("k"), s["m"].alias("m"), s["lo"].alias("lo"), g.alias("g"))

    there = docs.join(asked, "uid").dropDuplicates(["uid"])
    there = there.select("uid", "spans", words_of(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    return there.select("uid", F.explode(F.transform("spans", cell)).alias("x")).select("uid", "x.*")


def candidates(windows: DataFrame, items: DataFrame, radius: int, width: int) -> DataFrame:
    """uid, n, lo, at, item: windows (start ``lo + at``) and items whose fingerprints are within ``radius``."""
    bounds = block_bounds(BLOCKS)

    def blocks(h: str):
        return [(no, b, block(F.col(h), b)) for no, b in enumerate(bounds)]

    marks = items.select(
        "item", "n", F.get(fingerprints("shingles", "size(shingles)", width), F.lit(0)).alias("item_print")
    )
    def listed(no: int, b: tuple[int, int], v: Column) -> Column:
        masks = F.expr(f"array({', '.join(map(str, flips(b[1], radius // BLOCKS)))})")
        return F.struct(F.lit(no).alias("no"), F.transform(masks, lambda x: x.bitwiseXOR(v)).alias("vs"))

    index = marks.select("*", F.explode(F.array(*[listed(*x) for x in blocks("item_print")])).alias("b"))
    index = index.select("item", "n", "item_print", "b.no", F.explode("b.vs").alias("v"))
    if items.count() * sum(len(flips(b[1], radius // BLOCKS)) for b in bounds) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    asked = windows.select("uid", "n", "lo", F.posexplode(fingerprints("g", "m", width)).alias("at", "print"))
    asked = asked.select(
        "*", F.explode(F.array(*[F.struct(F.lit(no).alias("no"), v.alias("v")) for no, _, v in blocks("print")])).alias("b")
    ).select("uid", "n", "lo", "at", "print", "b.no", "b.v")
    return (
        asked.join(index, ["n", "no", "v"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("uid", "n", "lo", "at", "item")
        .distinct()
    )


def search(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 19):
    """(prepared items, runs of windows, candidates) of ``docs`` with uid and text."""
    if not 0 <= radius < 64:
        raise ValueError("the radius must be under 64")
    items = cut(prepare_items(items, shingle))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` numbers
    width = lane_width(items.agg(F.max(F.size("shingles"))).first()[0] or 0)
    windows = cut(window_runs(docs, items, sizes or [shingle], percent))
    return items, windows, cut(candidates(windows, items, radius, width))


def matches(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 19) -> DataFrame:
    """uid, item_id, start, words, percent of the windows that are alike; ``docs`` has uid and text."""
    items, windows, close = search(docs, items, shingle, percent, radius)
    weights = items.select("item", F.size("shingles").alias("mi"), F.explode("shingles").alias("h"))
    weights = weights.groupBy("item", "mi", "h").agg(F.count("*").alias("weight"))
    key = ["uid", "item", "start", "k", "m"]
    mine = (
        close.join(windows, ["uid", "n", "lo"])
        .select(
            "uid", "item", (F.col("lo") + F.col("at")).alias("start"), "k", "m",
            F.explode(F.slice("g", F.col("at") + 1, F.col("m"))).alias("h"),
        )
        .groupBy(*key, "h")
        .agg(F.count("*").alias("mine"))
    )
    shared = mine.join(weights, ["item", "h"]).groupBy(*key, "mi").agg(F.sum(F.least("mine", "weight")).alias("both"))
    union = F.col("m") + F.col("mi") - F.col("both")
    alike = shared.where(100 * F.col("both") >= percent * union)
    return alike.join(items.select("item", "item_id"), "item").select(
        "uid", "item_id", "start", (F.col("m") + F.col("k") - 1).alias("words"), (100.0 * F.col("both") / union).alias("percent")
    )


def contamination(
    docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 19
) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), best_percent: one row per document."""
    rows = documents(docs).withColumn("uid", F.xxhash64("doc_id", "text"))
    found = (
        matches(rows.select("uid", "text"), items, shingle, percent, radius)
        .groupBy("uid", "item_id")
        .agg(F.max("percent").alias("percent"))
        .groupBy("uid")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("percent").alias("best_percent"))
    )
    return (
        rows.select("doc_id", "uid")
        .join(found, "uid", "left")
        .select(
            "doc_id",
            F.col("item_ids").isNotNull().alias("contaminated"),
            F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
            F.coalesce("best_percent", F.lit(0.0)).alias("best_percent"),
        )
    )


def uncontaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 19) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns."""
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    rows = documents(docs).select(F.xxhash64("doc_id", "text").alias("uid"), "text")
    found = matches(rows, items, shingle, percent, radius).select("uid").distinct()
    return docs.join(found, key == found["uid"], "left_anti")
