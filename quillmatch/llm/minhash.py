"""MinHash near-duplicates: one-permutation hashing, optimal densification, stars.

Every text becomes the set of its distinct ``shingle``-word shingles (a shorter
text with words: the whole sequence as one).  Texts with equal sets are one
class.  A class is sketched by one permutation cut into ``bands * rows`` bins;
empty bins borrow from a bin chosen by an independent hash sequence, repeated
until a filled one is met.  Classes that share a band's bins share a bucket.
A bucket emits the star from its smallest id instead of all pairs; the edges
are confirmed on full sets.  Classes in buckets that still span several
components meet once more by exact prefix filtering, so no link is lost.

Defined cases: null, empty or blank text has ``n_shingles`` 0 and is linked
with nothing; a null ``doc_id`` is linked with nothing and its
``component_id`` is null; repeated rows come back as often as they went in;
rows that share an id are one document, linked by any of their texts;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.llm.common import cut, documents, in_pieces, mix, unused, window_hashes, word_hashes

BANDS = 32
ROWS = 4
#: So many ids with several texts are sent to every task; more are shuffled.
MIXED_ROWS = 200_000
HOT_ROWS, HOT_KEYS = 1000, 10_000


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts, lower=True)
    runs = window_hashes(words, size)
    sets = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(mix(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=int(b - a))], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def probe_table(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin, the sequence of bins that an empty bin asks in turn."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(tries, dtype=np.uint64), indexing="ij")
    return (mix(i * np.uint64(1_000_003) + t + np.uint64(77)) % np.uint64(bins)).astype(np.int64)


_PROBES: dict[int, np.ndarray] = {}


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band of the densified one-permutation sketch."""
    bins = bands * rows
    probes = _PROBES.setdefault(bins, probe_table(bins))
    h = mix(shingles + np.uint64(0x51ED270B))
    where = (h % np.uint64(bins)).astype(np.int64)
    sketch = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(h) > 4 * bins:
        order = np.lexsort((h, where))
        first = np.r_[True, where[order][1:] != where[order][:-1]]
        sketch[where[order][first]] = h[order][first]
    else:
        np.minimum.at(sketch, where, h)
    full = np.zeros(bins, bool)
    full[where] = True
    donor = np.arange(bins)
    empty = np.flatnonzero(~full)
    for t in range(probes.shape[1]):
        if not len(empty):
            break
        asked = probes[empty, t]
        hit = full[asked]
        donor[empty[hit]] = asked[hit]
        empty = empty[~hit]
    if len(empty):  # nearly empty sketches: walk to the next filled bin
        filled = np.flatnonzero(full)
        donor[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
    values = sketch[donor].reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for r in range(rows):
            key = mix(key + values[:, r])
    return key


def _sketcher(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            keys = [band_keys(s, bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()),
                        pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()),
                    ),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _set_maker(size: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"]
            )

    return run


def _shingle_maker(size: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            at = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                names=["rep", "shingles"],
            )

    return run


def _confirmer(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sx"), batch.column("sy")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of ``edges(a, b)``; root is its component's smallest id.

    Alternating large and small stars; neighbours are reduced to a minimum
    before any join, so a hub costs one row per task and side.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()

    star = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = state(star)
    while True:
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(star.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = cut(large.where("a <> b"))
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
        star = cut(small.unionAll(low.select(F.col("m").alias("a"), "b")).distinct())
        after = state(star)
        if after == before:
            return star.select(F.col("b").alias("id"), F.col("a").alias("root")).unionAll(
                star.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
            )
        before = after


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold; ``docs`` holds each id once."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    sets = (
        docs.join(ids, docs.doc_id == ids.id, "left_semi")
        .select("doc_id", "text")
        .mapInArrow(in_pieces(_set_maker(size)), "id long, shingles binary")
    )
    sets = cut(sets)
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sy")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sx")), "a")
        .select("a", "b", "sx", "sy")
        .mapInArrow(_confirmer(percent), "a long, b long")
    )


def on_hot_key(many: DataFrame, few: DataFrame, key: str, total: int) -> DataFrame:
    """``many`` joined with ``few``, which has one row and the count ``k`` of its rows in ``many`` for each key.

    Keys that hold more than a ten-thousandth of the ``total`` rows (and ``HOT_ROWS``) are at most ``HOT_KEYS``:
    these are sent to every task, so that no hot key is collected in one.
    """
    few = cut(few)
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = few.where(F.col("k") > bound)
    if hot.isEmpty():
        return many.join(few, key)
    hot = F.broadcast(hot)
    rest = many.join(hot.select(key), key, "left_anti").join(few.where(F.col("k") <= bound), key)
    return many.join(hot, key).unionByName(rest)


def _sizes_fit(x: str, y: str, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, n, root) of classes in buckets that span several components."""
    live = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("root", "rep").alias("root")
    )
    mixed = live.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k")).where("x < y")
    return cut(on_hot_key(live, mixed, "bucket", members.count()).select("rep", "n", "root").distinct())


def _prefix_pairs(rest: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose rarest shingles meet."""
    sets = (
        docs.join(rest, docs.doc_id == rest.rep, "left_semi")
        .select("doc_id", "text")
        .mapInArrow(in_pieces(_shingle_maker(size)), "rep long, shingles array<long>")
    )
    grams = cut(sets.select("rep", F.explode("shingles").alias("h")))
    often = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = grams.join(often, "h", "left").select(
        "rep", "h", "df", F.row_number().over(W.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "h")).alias("r")
    )
    prefix = (
        ranked.where("df is not null")
        .join(rest, "rep")
        .where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        .select("h", "rep", "n", "root", "r")
    )
    prefix = cut(prefix)
    other = prefix.toDF("h", "a", "na", "ra", "rank_a")
    # at two sets' first common shingle, what follows it in either bounds their intersection
    most = 1 + F.least(F.col("na") - F.col("rank_a"), F.col("n") - F.col("r"))
    return (
        prefix.join(other, "h")
        .where(F.col("a") < F.col("rep"))
        .where(F.col("ra") != F.col("root"))
        .where(_sizes_fit("na", "n", percent))
        .where((100 + percent) * most >= percent * (F.col("na") + F.col("n")))
        .select("a", F.col("rep").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, digest: one row per row of ``docs``.

    ``percent``: documents are linked if 100 * intersection >= percent * union.
    Rows that share an id are one document: a link of any of their texts links it.
    Where an id has several texts, these are judged apart and then linked by the id.
    """
    docs = documents(docs)
    mixed = _mixed_ids(docs)
    if mixed.isEmpty():
        return _near(docs, shingle, percent, bands, rows)
    told = _told_apart(docs, mixed)
    near = _near(told.select(F.col("own").alias("doc_id"), "text"), shingle, percent, bands, rows)
    near = cut(near.select(F.col("doc_id").alias("own"), "n_shingles", F.col("component_id").alias("root"), "digest"))
    names = cut(told.select("own", "doc_id").distinct())
    ids = names.join(near.select("own", "root").distinct(), "own")
    # a mixed id is no row's own number, so that it can stand for itself among the roots
    edges = ids.where("own <> doc_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    joined = components(edges).select(F.col("id").alias("root"), F.col("root").alias("whole"))
    ids = cut(ids.join(joined, "root", "left").withColumn("whole", F.coalesce("whole", "root")))
    least = ids.groupBy("whole").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
    ids = on_hot_key(ids, least, "whole", ids.count()).select("own", "doc_id", "component_id")
    out = near.join(ids, "own").select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "digest"
    )
    nameless = _near(docs.where("doc_id is null"), shingle, percent, bands, rows)
    return out.unionByName(nameless)


def _without_copies(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``docs`` with one row of each repeated id; ``named`` has the same ids, and ids have one text each.

    Most tables repeat no id: these are told by their ids alone, and only rows of repeated ids move with their texts.
    """
    again = cut(named.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("k")).where("k > 1").select("again"))
    if again.isEmpty():
        return docs
    repeated = docs.doc_id == again.again
    once = docs.where("doc_id is not null").join(again, repeated, "left_anti")
    return once.unionAll(docs.join(again, repeated, "left_semi").dropDuplicates(["doc_id"]))


def _near(docs: DataFrame, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The same for rows whose ids have one text each."""
    sketch = cut(
        docs.mapInArrow(
            in_pieces(_sketcher(shingle, bands, rows)), "doc_id long, n_shingles long, digest binary, bands array<long>"
        )
    )
    named = sketch.where("doc_id is not null and n_shingles > 0")
    single = _without_copies(docs, named)
    classes = cut(
        named.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        )
    )
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    centre = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("k")).where("k > 1")
    members = cut(on_hot_key(members, centre, "bucket", classes.count() * bands))
    stars = (
        members.where(F.col("rep") != F.col("c.rep"))
        .where(_sizes_fit("c.n", "n", percent))
        .select(F.col("c.rep").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    links = cut(_confirm(cut(stars), single, shingle, percent))
    roots = cut(components(links))
    rest = _unsettled(members.where(F.col("rep") != F.col("c.rep")).drop("c", "k"), roots)
    if not rest.isEmpty():
        more = cut(_confirm(cut(_prefix_pairs(rest, single, shingle, percent)), single, shingle, percent))
        if not more.isEmpty():
            roots = components(links.unionAll(more))
    to_root = classes.select("digest", "rep")
    to_root = to_root.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("root", "rep").alias("root")
    )
    # a null id names no document; it takes no part in a class
    return (
        sketch.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("digest")))
        .join(to_root.withColumnRenamed("digest", "key"), "key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("root", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("root", "doc_id")).alias("kept"),
            "digest",
        )
    )


def _mixed_ids(docs: DataFrame) -> DataFrame:
    """The ids that have several texts, as ``mixed``."""
    said = F.xxhash64(F.col("text").cast("string"))
    return cut(
        docs.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("mixed"))
        .agg(F.min(said).alias("x"), F.max(said).alias("y"))
        .where("x < y")
        .select("mixed")
    )


def _told_apart(docs: DataFrame, mixed: DataFrame, own: str = "own") -> DataFrame:
    """The rows with an id, and ``own``: the id, or a hash of id and text where an id has several texts."""
    named = docs.where("doc_id is not null")
    number = named["doc_id"].cast("long")
    if mixed.isEmpty():
        return named.select("*", number.alias(own))
    if mixed.count() <= MIXED_ROWS:
        mixed = F.broadcast(mixed)
    apart = F.when(mixed["mixed"].isNull(), number).otherwise(F.xxhash64(number, named["text"].cast("string")))
    return named.join(mixed, number == mixed["mixed"], "left").select(*[named[c] for c in docs.columns], apart.alias(own))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their groups, with all columns.

    Rows are judged by their texts: different texts under one id are documents
    of their own here, each with a 64-bit hash in place of the id.  Of rows that
    repeat id and text one stays; rows without an id stay all.
    """
    own, nth = unused("own", docs.columns), unused("nth", docs.columns)
    rows = _told_apart(docs, _mixed_ids(docs), own)
    texts = rows.select(F.col(own).alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = _near(texts, shingle, percent).where("kept").select("doc_id").distinct()
    order = W.partitionBy(own).orderBy(F.col("text").asc_nulls_last())
    named = (
        rows.join(kept, rows[own] == kept["doc_id"], "left_semi")
        .select(*docs.columns, F.row_number().over(order).alias(nth))
        .where(F.col(nth) == 1)
        .select(*docs.columns)
    )
    return named.unionAll(docs.where("doc_id is null"))
