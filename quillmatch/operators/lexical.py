"""A saved lexical index over text views: built once, added to, searched by terms.

An index is a folder of Parquet tables, one generation per addition:

* ``docs``: doc_id, digest of its views and tokens per field of what the addition holds; a null digest removes.
* ``postings``: field, term, doc_id, tf, dl, sorted and cut into blocks of about ``block_rows`` rows, so that a
  frequent term's postings lie in several blocks and a rare one's in one.
* ``lexicon``: field, term, df and the first and last block of its postings.
* ``size``: field, documents and tokens of the whole index after the addition; written last, so that a generation
  whose size is missing doesn't exist.

A search meets its terms with the lexicon first, reads only the blocks named there, and counts nothing that
the lexicon knows.  A changed document's older postings stay where they are and are left out by its generation;
where there are such, document frequencies of the terms asked for are counted again, without them.

Defined cases: documents without tokens count as documents; null texts are empty; repeated doc_ids within an
addition are refused; a topic whose terms match fewer than ``k`` documents is filled up with score 0 in id order
if asked to; queries without a known term match nothing; an empty index has no rows to give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.text import index_tokens, once
from quillmatch.operators.lineage import cut, kept
from quillmatch.operators.nearest import hit_scores
from quillmatch.operators.retrieval import fits, fuse, small, top
from quillmatch.sources import folders

_DOCS = "doc_id long, digest string, lens array<int>, generation int"
_LEXICON = "field string, term string, df long, first int, last int, generation int"
_POSTINGS = "field string, term string, doc_id long, tf int, dl int, generation int, block int"
_SIZE = "field string, place int, n long, tokens long, generation int"


def counted(tokens: Column) -> Column:
    """(term, tf) of every different token of a row, without a shuffle: runs of the sorted tokens."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda p: p.isNotNull())
        pair = lambda p, k, b: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).alias("tf"))
        return once(starts, lambda b: F.transform(b, lambda p, k: pair(p, k, b)))

    return once(F.array_sort(tokens), runs)


def generations(spark: SparkSession, path: str) -> list[int]:
    """The additions that the index holds, one number each."""
    if not folders.exists(spark, f"{path}/size"):
        return []
    return sorted(r.generation for r in spark.read.schema(_SIZE).parquet(f"{path}/size").select("generation").distinct().collect())


def _table(spark: SparkSession, path: str, name: str, schema: str, known: list[int]) -> DataFrame:
    if not known or not folders.exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("generation").isin(known))


def live(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, digest, lens, generation of the documents that the index holds now."""
    rows = _table(spark, path, "docs", _DOCS, generations(spark, path))
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("digest", "lens", "generation"), "generation").alias("d"))
    return last.select("doc_id", "d.*").where("digest is not null")


def digest(views: dict[str, Column]) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(v, F.lit("")) for v in views.values()])), 256)


def add(docs: DataFrame, path: str, views: dict[str, Column], removed: DataFrame | None = None, block_rows: int = 2_000_000) -> int:
    """Add or replace ``docs`` (doc_id and the columns of ``views``) and drop the doc_ids of ``removed``; the new generation."""
    spark = docs.sparkSession
    known = generations(spark, path)
    new, fields = (known[-1] + 1 if known else 0), list(views)
    for name in ("docs", "postings", "lexicon"):  # what an addition that died has left
        folders.remove(spark, f"{path}/{name}/generation={new}")
    tokens = F.array(*[index_tokens(F.coalesce(v, F.lit(""))) for v in views.values()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(views).alias("digest"), tokens.alias("tokens"))
    # each text is tokenised once; the terms of a document with their counts are what all the rest is made of
    counts = F.transform("tokens", lambda t: once(counted(t), lambda c: F.struct(F.size(t).alias("dl"), c["term"].alias("term"), c["tf"].alias("tf"))))
    rows = kept(rows.select("doc_id", "digest", counts.alias("fields")))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        raise ValueError("an addition holds a doc_id twice")
    told = rows.select("doc_id", "digest", F.col("fields.dl").alias("lens"))
    if removed is not None:
        gone = removed.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(told, "doc_id", "left_anti")
        told = told.unionAll(gone.select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("array<int>")))
    told.write.parquet(f"{path}/docs/generation={new}")
    cells = rows.select("doc_id", F.posexplode("fields").alias("place", "x"))
    found = cells.select(F.col("place").cast("short").alias("place"), "doc_id", F.col("x.dl").alias("dl"), F.inline(F.arrays_zip("x.term", "x.tf")))
    found = found.select("place", "term", "doc_id", "tf", "dl")
    n = rows.agg(F.coalesce(F.sum(F.aggregate("fields", F.lit(0).cast("long"), lambda s, x: s + F.size(x["term"]))), F.lit(0)).alias("n")).first().n
    blocks, order, names = max(1, -(-n // block_rows)), ("place", "term", "doc_id"), F.array(*map(F.lit, fields))
    dealt = found.repartitionByRange(int(blocks), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.get(names, F.col("place").cast("int")).alias("field"), "term", "doc_id", "tf", "dl", F.spark_partition_id().alias("block"))
    dealt.write.partitionBy("block").parquet(f"{path}/postings/generation={new}")
    written = spark.read.schema(_POSTINGS.replace(", generation int", "")).parquet(f"{path}/postings/generation={new}")
    lexicon = written.groupBy("field", "term").agg(F.count("*").alias("df"), F.min("block").alias("first"), F.max("block").alias("last"))
    lexicon.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/lexicon/generation={new}")
    # the sizes of all that lives, this addition included
    before = live(spark, path).join(told.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lens")
    now = before.unionAll(told.where("digest is not null").select("doc_id", "lens"))
    totals = now.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.get("lens", F.lit(k))), F.lit(0)).alias(f"t{k}") for k in range(len(fields))])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("place"), F.col(f"t{k}").alias("tokens")) for k, f in enumerate(fields)])
    totals.select("n", F.inline(cells)).select("field", "place", "n", "tokens").coalesce(1).write.parquet(f"{path}/size/generation={new}")
    return new


def update(docs: DataFrame, path: str, views: dict[str, Column]) -> tuple[int, int, int]:
    """Make the index hold ``docs`` and nothing else: (added or changed, kept, removed); only the first are tokenised."""
    spark = docs.sparkSession
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(views).alias("digest"))
    old = live(spark, path).select("doc_id", F.col("digest").alias("was"))
    both = cut(now.join(old, "doc_id", "full"))
    kind = F.when(F.col("digest").isNull(), "gone").when(F.col("digest").eqNullSafe(F.col("was")), "kept").otherwise("new")
    n = {r.kind: r["count"] for r in both.groupBy(kind.alias("kind")).count().collect()}
    if n.get("new") or n.get("gone"):
        fresh = both.where(kind == "new").select(F.col("doc_id").alias("fresh"))
        changed = docs.join(fresh, docs["doc_id"].cast("long") == fresh["fresh"], "left_semi")
        add(changed, path, views, both.where(kind == "gone"))
    return n.get("new", 0), n.get("kept", 0), n.get("gone", 0)


def _dead(spark: SparkSession, path: str, known: list[int]) -> DataFrame | None:
    """(doc_id, generation) of postings that a later addition replaced or removed; None where there are none."""
    if len(known) < 2:
        return None
    rows = _table(spark, path, "docs", _DOCS, known)
    last = rows.groupBy("doc_id").agg(F.max("generation").alias("last"), F.count("*").alias("k")).where("k > 1")
    dead = cut(rows.join(last, "doc_id").where("generation < last and digest is not null").select("doc_id", "generation"))
    return None if dead.isEmpty() else dead


def asked_terms(queries: DataFrame) -> DataFrame:
    """topic_id, field, term, qtf of ``queries`` (topic_id, field, text)."""
    terms = queries.select("topic_id", "field", F.explode(index_tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return terms.groupBy("topic_id", "field", "term").agg(F.count("*").alias("qtf"))


def hits(spark: SparkSession, path: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lexicon rows) of the distinct (field, term) of ``terms``; only blocks that hold them are read."""
    known = generations(spark, path)
    wanted = small(terms.select("field", "term").distinct())
    lexicon = cut(_table(spark, path, "lexicon", _LEXICON, known).join(wanted, ["field", "term"]))
    near = F.lit(False)
    spans = lexicon.select("generation", F.explode(F.sequence("first", "last")).alias("block")).distinct()
    # as many rows as the index has blocks, at most
    for r in spans.groupBy("generation").agg(F.collect_set("block").alias("blocks")).collect():
        near = near | ((F.col("generation") == r.generation) & F.col("block").isin(sorted(r.blocks)))
    found = _table(spark, path, "postings", _POSTINGS, known).where(near).drop("block")
    return found.join(wanted, ["field", "term"]), lexicon


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, fill: bool = False, k1: float = X.K1, b: float = X.B
) -> DataFrame:
    """(field, topic_id, doc_id, score, rank) of the best ``k`` documents of each topic and field by BM25.

    ``queries``: topic_id, field, text: a text of its own for each field.
    """
    known = generations(spark, path)
    terms = cut(asked_terms(queries))
    found, lexicon = hits(spark, path, terms)
    dead = _dead(spark, path, known)
    if dead is None:
        df = lexicon.groupBy("field", "term").agg(F.sum("df").alias("df"))
    else:
        found = cut(found.join(small(dead), ["doc_id", "generation"], "left_anti"))
        df = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    last = known[-1] if known else -1
    size = _table(spark, path, "size", _SIZE, known).where(F.col("generation") == last)
    size = size.select("field", "n", F.try_divide("tokens", "n").alias("avgdl"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known_terms = cut(df.join(F.broadcast(size), "field").select("field", "term", idf.alias("idf"), "avgdl"))
    if fits(terms) and terms.schema["topic_id"].dataType.typeName() in ("long", "integer", "string"):
        uses = terms.groupBy("field", "term").agg(F.collect_list(F.struct("topic_id", "qtf")).alias("asked"))
        scored = hit_scores(found, known_terms.join(F.broadcast(uses), ["field", "term"]), k, k1, b)
    else:
        # a row per topic and term
        weighted = terms.join(known_terms, ["field", "term"]).select("topic_id", "field", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl")
        gain = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = found.join(weighted, ["field", "term"]).groupBy("field", "topic_id", "doc_id").agg(F.round(F.sum(gain), 6).alias("score"))
    run = top(scored, ["field", "topic_id"], [F.desc("score"), F.asc("doc_id")], k)
    return _filled(run, queries, live(spark, path), k) if fill else run


def _filled(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``run`` with score 0 for the smallest other doc_ids where a topic and field has fewer than ``k`` rows.

    What fills a list lies among the ``k`` smallest doc_ids: at most ``k`` numbers come to the driver.
    """
    first = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(k).collect()]
    run = cut(run)
    lists = queries.select("topic_id", "field").distinct()
    have = run.groupBy("topic_id", "field").agg(F.count("*").alias("have"))
    short = lists.join(have, ["topic_id", "field"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < k)
    ids = F.split(F.lit(",".join(map(str, first))), ",").cast("array<bigint>") if first else F.array().cast("array<bigint>")
    more = short.select("field", "topic_id", "have", F.explode(ids).alias("doc_id")).join(run, ["field", "topic_id", "doc_id"], "left_anti")
    more = top(more, ["field", "topic_id"], [F.asc("doc_id")], k, "nth").where(F.col("have") + F.col("nth") <= k)
    rest = more.select("field", "topic_id", "doc_id", F.lit(0.0).alias("score"), (F.col("have") + F.col("nth")).cast("int").alias("rank"))
    return run.unionByName(rest)


def field_weights(text: str) -> dict[str, float]:
    """Weights of the fields named in ``field=weight, ...``; unnamed fields keep their own."""
    out = dict(X.FIELD_WEIGHTS)
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, value = (x.strip() for x in part.partition("="))
        if name not in out:
            raise ValueError(f"no such field: {name}")
        try:
            out[name] = float(value)
        except ValueError:
            raise ValueError(f"the weight of {name} is no number: {value!r}") from None
        if not 0 <= out[name] < float("inf"):
            raise ValueError(f"the weight of {name} is negative or not finite")
    return out


def fielded_search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, field_k: int = 1000, weights: dict | None = None, fill: bool = True
) -> DataFrame:
    """topic_id, doc_id, score, n_runs, rank: the fields' runs fused by weighted reciprocal ranks."""
    weights = weights or X.FIELD_WEIGHTS
    run = search(spark, path, queries, max(k, field_k), fill)
    return fuse(run.withColumnRenamed("field", "source"), k, weights)
