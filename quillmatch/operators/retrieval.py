"""Lexical and dense retrieval, fusion and reranking, for all topics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.text import index_tokens
from quillmatch.operators.nearest import nearest, scan_counts, scan_scores

#: Query sides up to so many rows are sent to every task; larger ones are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, times: int = 1) -> bool:
    """Whether ``times`` as many rows as ``df`` has, and bytes (as JSON text), are few enough to be sent to every task."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return size["n"] * times <= BROADCAST_ROWS and (size["b"] or 0) * times <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and bytes are few."""
    return F.broadcast(df) if fits(df) else df


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1; prunes before the shuffle's sort."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def fields_of(text: Column) -> dict[str, Column]:
    """The indexed views of a document, by its lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    n = F.size(lines)
    return {
        "all": F.coalesce(text, F.lit("")),
        "condition_title": F.get(lines, F.lit(0)),
        "eligibility": F.get(lines, n - 1),
        "intervention": F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n"),
        "summary_description": F.array_join(F.slice(lines, 1, 3), "\n"),
    }


def postings(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, doc_id, tokens): one row per document and field."""
    views = fields_of(F.col("text"))
    cells = [F.struct(F.lit(f).alias("field"), index_tokens(views[f]).alias("tokens")) for f in fields or ["all"]]
    return docs.select("doc_id", F.explode(F.array(*cells)).alias("x")).select("x.field", "doc_id", "x.tokens")


def bm25(docs: DataFrame, topics: DataFrame, k: int, fields: list[str] | None = None, k1: float = X.K1, b: float = X.B) -> DataFrame:
    """(field, topic_id, doc_id, score, rank) of the best ``k`` documents that share a term.

    Where the query side is small (counted), its terms with their weights go to every task of the scan, which scores
    its documents in place and sends on the best ``k``.  Else, and where rows share an id, postings are joined and shuffled.
    """
    fields = fields or ["all"]
    terms = query_terms(topics)
    asked = terms.select("term").distinct()
    few = fits(asked, len(fields)) and fits(terms, len(fields))
    if few and docs.schema["doc_id"].dataType.typeName() in ("long", "integer") and not repeats(docs, "doc_id"):
        scored = scan_scores(tokenised(docs), lexicon(docs, terms, fields), pieces(fields), k, k1, b)
    else:
        scored = joined_scores(docs, terms, fields, k1, b)
    return top(scored, ["field", "topic_id"], [F.desc("score"), F.asc("doc_id")], k)


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether several rows share a key, or one has none."""
    return not rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()


#: The pieces of a text that make up each of its views: all lines belong to one piece, so that each is tokenised once.
PIECES = {
    "all": ("only", "first", "near", "rest", "low", "last"),
    "condition_title": ("only", "first"),
    "eligibility": ("only", "low", "last"),
    "intervention": ("near", "rest"),
    "summary_description": ("only", "first", "near", "low"),
}


def pieces(fields: list[str]) -> dict[str, tuple]:
    """The token columns of `tokenised` that each field consists of; no token reaches over the end of a line."""
    return {"all": ("text",)} if set(fields) == {"all"} else {f: PIECES[f] for f in fields}


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, the tokens of its whole text, and those of its pieces: a lone line, the first of several, those up to the
    third and behind it but for the last, and the last: ``low`` if it is the second or third."""
    rows = docs.select("doc_id", "text", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    n, line = F.size("lines"), lambda i: F.get("lines", i)
    joined = lambda start, length: F.array_join(F.slice("lines", F.lit(start), F.greatest(length, F.lit(0))), "\n")
    texts = {
        "text": F.col("text"),
        "only": F.when(n == 1, line(F.lit(0))),
        "first": F.when(n > 1, line(F.lit(0))),
        "near": joined(2, F.least(n - 2, F.lit(2))),
        "rest": joined(4, n - 4),
        "low": F.when((n > 1) & (n < 4), line(n - 1)),
        "last": F.when(n > 3, line(n - 1)),
    }
    return rows.select("doc_id", *[index_tokens(t).alias(name) for name, t in texts.items()])


def lexicon(docs: DataFrame, terms: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, idf, avgdl and asked (topic_id, qtf of each topic) of the query terms that documents hold; one scan."""
    asked = terms.agg(F.array_sort(F.collect_set("term")).alias("terms"))
    names = asked.select(F.posexplode("terms").alias("code", "term"))
    counts = scan_counts(tokenised(docs), asked, pieces(fields)).groupBy("field", "code").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
    every = lambda x: F.max(F.when(F.col("code") < 0, x)).over(W.partitionBy("field"))
    sized = counts.withColumns({"n": every(F.col("df")), "avgdl": every(F.col("tokens") / F.col("df"))}).where("code >= 0")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    uses = terms.groupBy("term").agg(F.collect_list(F.struct("topic_id", "qtf")).alias("asked"))
    return sized.join(F.broadcast(names), "code").join(F.broadcast(uses), "term").select("field", "term", idf.alias("idf"), "avgdl", "asked")


def joined_scores(docs: DataFrame, terms: DataFrame, fields: list[str], k1: float, b: float) -> DataFrame:
    """(field, topic_id, doc_id, score) of all documents that share a term, for query sides and ids of any kind."""
    index = postings(docs, fields)
    size = index.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    asked = terms.select("term").distinct()
    few = fits(asked, len(fields))  # holds for a row per field and term, too
    tf = (
        index.select("field", "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .join(F.broadcast(asked) if few else asked, "term")
        .groupBy("field", "term", "doc_id", "dl")
        .agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    known = df.join(F.broadcast(size), "field")
    weighted = (
        # a frequent term's postings stay where they are
        tf.join(F.broadcast(known) if few else known, ["field", "term"])
        .select("field", "term", "doc_id", weight.alias("w"))
        .join(small(terms), "term")
    )
    return weighted.groupBy("field", "topic_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))


def query_terms(topics: DataFrame) -> DataFrame:
    """topic_id, term, qtf."""
    terms = topics.select("topic_id", F.explode(index_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("topic_id", "term").agg(F.count("*").alias("qtf"))


def fuse(runs: DataFrame, k: int, weights: dict[str, float], rrf_k: int = X.RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of runs (source, topic_id, doc_id, rank)."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, float(max(w, 0.0))).otherwise(weight)
    used = runs.withColumn("w", weight).where("w > 0")
    fused = used.groupBy("topic_id", "doc_id").agg(
        F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 6).alias("score"), F.count("*").alias("n_runs")
    )
    return top(fused, ["topic_id"], [F.desc("score"), F.asc("doc_id")], k)


def fielded(docs: DataFrame, topics: DataFrame, k: int, field_k: int = 1000, weights: dict | None = None) -> DataFrame:
    """Per-field BM25 fused with weighted reciprocal ranks."""
    weights = weights or X.FIELD_WEIGHTS
    runs = bm25(docs, topics, field_k, list(weights)).withColumnRenamed("field", "source")
    return fuse(runs, k, weights)


def dense(vectors: DataFrame, queries: DataFrame, k: int, last: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine search of any number of queries; ties go to the smaller id, or the last.

    Each group of vectors and queries keeps its own best ``k`` before the shuffle.
    """
    return top(nearest(vectors, queries, k, last), ["query_id"], [F.desc("score"), F.desc("vec_id") if last else F.asc("vec_id")], k)


def lexical(docs: DataFrame, topics: DataFrame, k: int, mode: str = "fielded", terms: DataFrame | None = None) -> DataFrame:
    """topic_id, doc_id, score, rank: the lexical run by its mode; a single field's query takes the terms of ``terms``
    (topic_id, and the array terms) behind it."""
    if mode == "fielded":
        return fielded(docs, topics, k).select("topic_id", "doc_id", "score", "rank")
    if mode != "single":
        raise ValueError("a lexical run is fielded or single")
    if terms is not None:
        more = F.array_join(F.coalesce("terms", F.array().cast("array<string>")), " ")
        topics = topics.join(terms, "topic_id", "left").select("topic_id", F.concat_ws(" ", "text", F.when(more != "", more)).alias("text"))
    return bm25(docs, topics, k).select("topic_id", "doc_id", "score", "rank")


def mean_vectors(parts: DataFrame, normalise: bool = False) -> DataFrame:
    """(query_id, query): the mean of each query's vectors (query_id, embedding), place by place; equal lengths."""
    cells = parts.select("query_id", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("query"))
    if not normalise:
        return rows
    size = F.sqrt(F.aggregate("query", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("query_id", F.when(size > 0, F.transform("query", lambda x: x / size)).otherwise(F.col("query")).alias("query"))


def dense_run(vectors: DataFrame, queries: DataFrame, k: int, mode: str = "plain", answers: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, rank by mode: none (an empty run), the query's own vector, or its mean with ``answers``.

    ``answers``: query_id, embedding, the vectors of hypothetical answers; ``where`` filters ``vectors``.
    """
    if mode not in ("off", "plain", "hyde"):
        raise ValueError("a dense run is off, plain or hyde")
    if where is not None:
        vectors = vectors.where(where)
    if mode == "hyde" and answers is not None:
        own = queries.select("query_id", F.col("query").alias("embedding"))
        queries = mean_vectors(own.unionByName(answers.select("query_id", "embedding")))
    run = dense(vectors, queries, k)
    return run.where(F.lit(False)) if mode == "off" else run


def min_max(by: list[str], value: str) -> Column:
    """Value scaled to its group's range; equal values fall from 1 to 0 by their order."""
    w = W.partitionBy(*by)
    low, high, n = F.min(value).over(w), F.max(value).over(w), F.count("*").over(w)
    place = F.row_number().over(w.orderBy("rank", "doc_id")) - 1
    flat = F.when(n == 1, 1.0).otherwise(1 - place / (n - 1))
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(flat)


def blend(run: DataFrame, beta: float, k: int) -> DataFrame:
    """(1 - beta) * norm(rerank) + beta * norm(score): run has score, rerank, rank."""
    rows = run.withColumn("a", min_max(["topic_id"], "rerank")).withColumn("b", min_max(["topic_id"], "score"))
    rows = rows.withColumn("blended", F.round((1 - beta) * F.col("a") + beta * F.col("b"), 6)).withColumnRenamed("rank", "old_rank")
    return top(rows, ["topic_id"], [F.desc("blended"), F.asc("old_rank"), F.asc("doc_id")], k).select(
        "topic_id", "doc_id", "blended", "old_rank", "rank"
    )
