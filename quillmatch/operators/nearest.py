"""Best ``k`` of many scores, inside tasks: cosine search of all queries, and BM25 of all topics on a document scan.

Scores are compared as they are shown, at six places (halves go up, away from
zero), so ties are the ties of the output and the order given decides them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and queries that meet in one group, and scores and counted terms that are held at once.
PART_VECTORS, BLOCK_QUERIES, HELD_SCORES, HELD_HITS = 8192, 2048, 4_000_000, 200_000
#: Stands for a null score: below all others, as in a descending order.
NONE = -np.inf


def millionths(x: np.ndarray) -> np.ndarray:
    """Scores at six places, as whole numbers in doubles."""
    return np.trunc(x * 1e6 + np.copysign(0.5, x))


def rows_by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: (places, matrix) of the arrays of a list column; nulls are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out = {}
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = (at, flat[starts[at, None] + np.arange(n)])
    return out


def cosines(queries: dict, vectors: dict, rows: slice, n_vectors: int, n_rows: int) -> np.ndarray:
    """Cosines at six places of the queries at ``rows``; unlike lengths, nulls and zero vectors as DuckDB has them."""
    out = np.full((n_rows, n_vectors), NONE)
    for n, (at, q) in queries.items():
        here = (at >= rows.start) & (at < rows.start + n_rows)
        if n in vectors and here.any():
            places, v = vectors[n]
            q = q[here]
            with np.errstate(all="ignore"):
                x = (q @ v.T) / np.sqrt(np.einsum("ij,ij->i", q, q)[:, None] * np.einsum("ij,ij->i", v, v))
            x = millionths(x)
            x[np.isnan(x)] = np.inf  # NaN is the largest double
            out[np.ix_(at[here] - rows.start, places)] = x
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, last: bool = False) -> DataFrame:
    """(query_id, vec_id, score) of at least the best ``k`` vectors of every query; of ties the smaller ids, or the last.

    Vectors are dealt to parts and queries to blocks; each part meets each
    block in a group of its own and sends on ``k`` rows a query.
    """
    n, m = queries.count(), vectors.count()
    blocks, parts = max(1, -(-n // BLOCK_QUERIES)), max(1, -(-m // PART_VECTORS))
    whole = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c).cast("array<double>"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("vec_id", F.col("embedding"), dealt("vec_id", parts).alias("part"))
    v = v.select("vec_id", whole("embedding").alias("embedding"), "part", every(blocks).alias("block"))
    q = queries.select("query_id", whole("query").alias("query"), dealt("query_id", blocks).alias("block"), every(parts).alias("part"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        order = [("vec_id", "descending" if last else "ascending")]
        right = right.take(pc.sort_indices(right, sort_keys=order, null_placement="at_end" if last else "at_start"))
        size, few = right.num_rows, min(k, right.num_rows)
        asked, known = rows_by_length(left["query"]), rows_by_length(right["embedding"])
        step = max(1, HELD_SCORES // max(size, 1))
        picked, scores = [], []
        for start in range(0, left.num_rows if few else 0, step):
            rows = min(step, left.num_rows - start)
            x = cosines(asked, known, slice(start, start + rows), size, rows)
            # a score's key also holds its vector's place, so that no two are alike
            key = np.clip(x, -4e6, 4e6) * size + np.arange(size - 1, -1, -1)
            at = np.argpartition(key, size - few, axis=1)[:, size - few :]
            picked.append(at.ravel())
            scores.append(np.take_along_axis(x, at, 1).ravel())
        at, x = np.concatenate(picked or [np.zeros(0, np.int64)]), np.concatenate(scores or [np.zeros(0)])
        shown = np.where(x == np.inf, np.nan, x / 1e6)
        score = pa.array(shown, pa.float64(), mask=x == NONE)
        ids = left["query_id"].take(pa.array(np.repeat(np.arange(left.num_rows if few else 0), few)))
        return pa.table({"query_id": ids, "vec_id": right["vec_id"].take(pa.array(at)), "score": score})

    met = q.groupBy("part", "block").cogroup(v.groupBy("part", "block"))
    return met.applyInArrow(best, f"query_id {kind(queries, 'query_id')}, vec_id {kind(vectors, 'vec_id')}, score double")


def told(batch, names: list[str], known: pa.Array) -> dict[str, tuple]:
    """name: (lengths, row and code of each token of ``known``) of the token columns of a batch, each token looked up once."""
    out = {}
    for name in names:
        column = batch.column(name)
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.fill_null(pc.index_in(column.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[name] = (lengths, row[code >= 0], code[code >= 0].astype(np.int64))
    return out


def counted(parts: list[tuple], many: int) -> tuple:
    """(lengths, row, code, count) of the parts of a field taken together, ``many`` codes being known."""
    pairs = np.concatenate([row * many + code for _, row, code in parts])
    pairs, tf = np.unique(pairs, return_counts=True)
    row, code = np.divmod(pairs, max(many, 1))
    return sum(lengths for lengths, _, _ in parts), row, code, tf


class Scorer:
    """BM25 of all topics over batches of counted terms, and the best ``k`` of each field and topic so far."""

    def __init__(self, lexicon: list[dict], fields: list[str], k: int, k1: float, b: float):
        self.k, self.k1, self.b, self.fields = k, k1, b, {}
        topics = sorted({t["topic_id"] for x in lexicon for t in x["asked"]}, key=lambda t: (t is not None, t))
        self.topics, number = topics, {t: i for i, t in enumerate(topics)}
        names = sorted({x["term"] for x in lexicon})
        self.terms, code = pa.array(names, pa.string()), {t: i for i, t in enumerate(names)}
        for name in fields:
            rows = {code[x["term"]]: x for x in lexicon if x["field"] == name}
            if rows:
                uses = [sorted((number[t["topic_id"]], t["qtf"]) for t in rows[i]["asked"]) if i in rows else [] for i in range(len(names))]
                self.fields[name] = {
                    "idf": np.array([rows[i]["idf"] if i in rows else 0.0 for i in range(len(names))]),
                    "avgdl": next(iter(rows.values()))["avgdl"],
                    "ends": np.cumsum([0, *map(len, uses)]),
                    "topic": np.array([t for u in uses for t, _ in u], np.int64),
                    "qtf": np.array([n for u in uses for _, n in u], np.float64),
                    "least": np.zeros(len(topics)),
                    "best": tuple(np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64)),
                    "new": [],
                }

    def scores(self, f: dict, n: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(topic, document) at full places of ``n`` documents; 0 where they share no term.  ``length``: of each entry's field."""
        weight = f["idf"][term] * tf / (tf + self.k1 * (1 - self.b + self.b * length / f["avgdl"]))
        uses = f["ends"][term + 1] - f["ends"][term]
        row = np.repeat(np.arange(len(term)), uses)
        use = np.arange(len(row)) + np.repeat(f["ends"][term] - (np.cumsum(uses) - uses), uses)
        cell = f["topic"][use] * n + doc[row]
        total = np.bincount(cell, weights=f["qtf"][use] * weight[row], minlength=len(self.topics) * n)
        return total.reshape(len(self.topics), n)

    def add(self, name: str, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> None:
        """The documents ``ids``; ``doc`` and ``term`` are the places of an entry's document and term."""
        f = self.fields[name]
        x = self.scores(f, len(ids), doc, term, tf, length)
        shown = millionths(x)
        topic, doc = np.nonzero((x > 0) & (shown >= f["least"][:, None]))
        f["new"].append((topic, shown[topic, doc], ids[doc]))
        if sum(len(t) for t, _, _ in f["new"]) > max(HELD_SCORES // 4, len(f["best"][0])):
            self.settle(f)

    def settle(self, f: dict) -> None:
        topic, shown, ids = (np.concatenate(c) for c in zip(f["best"], *f["new"]))
        order = np.lexsort((ids, -shown, topic))
        topic, shown, ids = topic[order], shown[order], ids[order]
        first = np.searchsorted(topic, topic)
        place = np.arange(len(topic)) - first
        kept = place < self.k
        full = place == self.k - 1
        f["least"][topic[full]] = shown[full]
        f["best"], f["new"] = (topic[kept], shown[kept], ids[kept]), []

    def result(self, schema: pa.Schema):
        for name, f in self.fields.items():
            self.settle(f)
            topic, shown, ids = f["best"]
            topics = pa.array(self.topics, schema.field("topic_id").type).take(pa.array(topic))
            ids = pa.array(ids).cast(schema.field("doc_id").type)
            out = pa.record_batch([pa.array([name] * len(ids), pa.string()), topics, ids, pa.array(shown / 1e6)], schema=schema)
            yield from (out.slice(i, 10_000) for i in range(0, len(ids), 10_000))


def with_first(rows: DataFrame, value: DataFrame) -> DataFrame:
    """``rows`` with the only row of ``value`` beside the first row of each task, and nulls beside the others."""
    start = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return rows.withColumn("_start", start).join(F.broadcast(value.withColumn("_start", F.lit(True))), "_start", "left").drop("_start")


def pieces_of(fields: dict[str, tuple]) -> list[str]:
    return sorted({p for parts in fields.values() for p in parts})


def scan_counts(views: DataFrame, terms: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    """(field, code, df, tokens) of each task's documents: how many hold a term of ``terms``, the array of all that are
    asked for, at its place there; the code -1 has all documents of the field and its tokens.

    ``views``: token columns, each read once; ``fields`` names those of which a field is made.
    """
    pieces = pieces_of(fields)

    def count(batches):
        known, df, docs, tokens = None, {}, 0, dict.fromkeys(fields, 0)
        for batch in batches:
            if known is None and batch.num_rows:
                known = pa.array(batch.column("terms")[0].as_py() or [], pa.string())
                df = {f: np.zeros(len(known), np.int64) for f in fields}
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = told(piece, pieces, known)
                docs += piece.num_rows
                for f, parts in fields.items():
                    lengths, _, code, _ = counted([found[p] for p in parts], len(known))
                    tokens[f] += int(lengths.sum())
                    df[f] += np.bincount(code, minlength=len(known))
        for f in df:
            at = np.flatnonzero(df[f])
            code, n = np.concatenate([[-1], at]), np.concatenate([[docs], df[f][at]])
            every = pa.array(np.where(code < 0, tokens[f], 0), pa.int64())
            yield pa.record_batch([pa.array([f] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64()), every], names=["field", "code", "df", "tokens"])

    return with_first(views.select(*pieces), terms).mapInArrow(count, "field string, code int, df long, tokens long")


def scan_scores(views: DataFrame, lexicon: DataFrame, fields: dict[str, tuple], k: int, k1: float, b: float) -> DataFrame:
    """(field, topic_id, doc_id, score) of at least the best ``k`` documents of each topic and field, smaller ids first.

    ``views``: doc_id (whole numbers, none twice) and token columns, of which ``fields`` names those that make up each field.
    ``lexicon``: field, term, idf, avgdl, and asked: topic_id and qtf of its topics; it comes to each task with the first row,
    and the rows are scored where they are.
    """
    pieces = pieces_of(fields)
    whole = lexicon.agg(F.collect_list(F.struct("field", "term", "idf", "avgdl", "asked")).alias("lexicon"))
    schema, empty = _found(views, lexicon)

    def best(batches):
        scorer = None
        for batch in batches:
            if scorer is None and batch.num_rows:
                scorer = Scorer(batch.column("lexicon")[0].as_py() or [], list(fields), k, k1, b)
            step = max(1, min(256, HELD_SCORES // max(len(scorer.topics), 1))) if scorer else 1
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids, found = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), told(piece, pieces, scorer.terms)
                for f in scorer.fields:
                    lengths, row, code, tf = counted([found[p] for p in fields[f]], len(scorer.terms))
                    scorer.add(f, ids, row, code, tf, lengths[row])
        if scorer is not None:
            yield from scorer.result(empty)

    return with_first(views.select("doc_id", *pieces), whole).mapInArrow(best, schema)


def hit_scores(hits: DataFrame, lexicon: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(field, topic_id, doc_id, score) of at least the best ``k`` documents of each topic and field, from counted terms.

    ``hits``: field, term, doc_id, tf, dl, one row a field, term and document.  They are shuffled once, as numbers, so that those
    of a document meet in one task; ``lexicon`` as in `scan_scores`.
    """
    numbered = lexicon.select("field", "term").agg(F.array_sort(F.collect_set(F.struct("field", "term"))).alias("x"))
    names = numbered.select(F.posexplode("x").alias("code", "name")).select("code", "name.*")
    packed = F.shiftleft(F.col("tf").cast("long"), 32) + F.col("dl")
    rows = hits.join(F.broadcast(names), ["field", "term"]).select("doc_id", "code", packed.alias("counts"))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    # as text: the size of a nested column would be told anew for each of the many rows
    whole = lexicon.agg(F.to_json(F.collect_list(F.struct("field", "term", "idf", "avgdl", "asked"))).alias("lexicon"))
    schema, empty = _found(hits, lexicon)

    def best(batches):
        scorer, left = None, []
        for batch in batches:
            if scorer is None and batch.num_rows:
                lexicon = json.loads(batch.column("lexicon")[0].as_py() or "[]")
                for t in (t for x in lexicon for t in x["asked"]):
                    t.setdefault("topic_id", None)  # JSON leaves nulls out
                names = sorted({x["field"] for x in lexicon})
                scorer = Scorer(lexicon, names, k, k1, b)
                place = {t: i for i, t in enumerate(scorer.terms.to_pylist())}
                pairs = sorted((x["field"], x["term"]) for x in lexicon)
                field, term = np.array([names.index(f) for f, _ in pairs]), np.array([place[t] for _, t in pairs])
            left.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "code", "counts")])
            if sum(len(c[0]) for c in left) >= HELD_HITS:
                rows = [np.concatenate(c) for c in zip(*left)]
                last = np.searchsorted(rows[0], rows[0][-1])  # the last document may go on in the next batch
                meet(scorer, names, field, term, [c[:last] for c in rows])
                left = [[c[last:] for c in rows]]
        if scorer is not None:
            meet(scorer, names, field, term, [np.concatenate(c) for c in zip(*left)])
            yield from scorer.result(empty)

    def meet(scorer, names, field, term, rows):
        ids, doc = np.unique(rows[0], return_inverse=True)
        step = max(1, min(256, HELD_SCORES // max(len(scorer.topics), 1)))
        for at in range(0, len(ids), step):
            lo, hi = np.searchsorted(doc, (at, at + step))
            d, code, tf, dl = doc[lo:hi] - at, rows[1][lo:hi], rows[2][lo:hi] >> 32, rows[2][lo:hi] & 0xFFFFFFFF
            for i, f in enumerate(names):
                here = field[code] == i
                scorer.add(f, ids[at : at + step], d[here], term[code[here]], tf[here], dl[here])

    return with_first(rows, whole).mapInArrow(best, schema)


def _found(rows: DataFrame, lexicon: DataFrame) -> tuple[str, pa.Schema]:
    topic_type = lexicon.schema["asked"].dataType.elementType["topic_id"].dataType.simpleString()
    schema = f"field string, topic_id {topic_type}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"
    return schema, rows.sparkSession.createDataFrame([], schema).toArrow().schema
