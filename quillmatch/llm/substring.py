"""Repeated passages: windows of ``size`` words that start in two places.

Anchors are hashed only at word positions p with p mod ``PERIOD`` in a
difference cover: for any two windows some offset below the period puts both
on the cover, so equal windows share an aligned anchor of
``size - PERIOD + 1`` words.  Windows that hold a repeated anchor are extended
to full windows, hashed and counted; only those that start twice are removed.

Occurrences travel as packed arrays, one row per hash bucket and flush.  A task
settles what repeats inside its own flush and sends one marked occurrence of
it, so a passage that a third of all documents hold costs one entry a flush.

Defined cases: null or blank text has no words and the digest of the empty
string; a row that repeats counts as another place; the rows of an empty table
are none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import binary_column, buckets_for, documents, in_pieces, window_hashes, word_hashes

#: A perfect difference set: every residue mod 21 is a difference of two of these.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

FLUSH = 500_000
_PACK = "bucket int, hashes binary, owners binary, runs binary, places binary"
_FOUND = "bucket int, owners binary, runs binary, places binary"
_SEEN = np.uint32(1 << 31)


def _run_lengths(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, counts as 32-bit) of the runs of equal owners."""
    at = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, np.int64)
    return owners[at], np.diff(np.r_[at, len(owners)]).astype(np.uint32)


def _spread(row) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each entry of a packed row (owners, runs, places)."""
    owners, runs, places = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int64, np.uint32, np.uint32)))
    return np.repeat(owners, runs), places


def _emit(hashes: np.ndarray, owners: np.ndarray, places: np.ndarray, buckets: int):
    """Packed rows of one flush: repeats inside it are settled, the rest goes to buckets."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    repeated = (np.bincount(run) > 1)[run] if len(h) else np.zeros(0, bool)
    out = []
    local = order[repeated]
    if len(local):
        local = local[np.lexsort((places[local], owners[local]))]
        out.append((-1 - int(h[0] % np.uint64(buckets)), hashes[:0], owners[local], places[local].astype(np.uint32)))
    send = order[first]
    marks = np.where(repeated[first], _SEEN, np.uint32(0))
    where = (hashes[send] % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((owners[send], where))
    send, marks, where = send[by], marks[by], where[by]
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(where)]):
        part = send[a:b]
        out.append((int(where[a]), hashes[part], owners[part], places[part].astype(np.uint32) | marks[a:b]))
    runs = [_run_lengths(x[2]) for x in out]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in out], pa.int32()),
            binary_column([x[1] for x in out]),
            binary_column([x[0] for x in runs]),
            binary_column([x[1] for x in runs]),
            binary_column([x[3] for x in out]),
        ],
        names=["bucket", "hashes", "owners", "runs", "places"],
    )


def _packed(pieces, buckets: int):
    """Flushes of (hashes, owners, places) triples of bounded size."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= FLUSH:
            yield _emit(*(np.concatenate([x[i] for x in held]) for i in range(3)), buckets)
            held, n = [], 0
    if n:
        yield _emit(*(np.concatenate([x[i] for x in held]) for i in range(3)), buckets)


def _anchors(size: int, buckets: int):
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True

    def pieces(batches):
        for batch in batches:
            owner = batch.column(0).to_numpy()
            words, at = word_hashes(batch.column(1).to_pylist(), lower=False)
            runs = window_hashes(words, size - PERIOD + 1)
            doc = np.repeat(np.arange(len(owner)), np.diff(at))[: len(runs)]
            place = np.arange(len(runs)) - at[doc]
            inside = np.arange(len(runs)) + size - PERIOD + 1 <= at[doc + 1]
            long_enough = (at[doc + 1] - at[doc]) >= size
            use = np.flatnonzero(inside & long_enough & on_cover[place % PERIOD])
            yield runs[use], owner[doc[use]], place[use]

    return lambda batches: _packed(pieces(batches), buckets)


def _windows(size: int, buckets: int):
    """Full windows around repeated anchors, from rows (owner, text, marks)."""

    def pieces(batches):
        for batch in batches:
            owner = batch.column(0).to_numpy()
            words, at = word_hashes(batch.column(1).to_pylist(), lower=False)
            runs = window_hashes(words, size)
            cover = np.zeros(len(words) + 1, np.int64)
            for k, marks in enumerate(batch.column(2)):
                last = at[k + 1] - size
                p = np.frombuffer(marks.as_buffer(), np.uint32).astype(np.int64) + at[k]
                begin, end = np.maximum(p - PERIOD + 1, at[k]), np.minimum(p, last) + 1
                ok = begin < end
                np.add.at(cover, begin[ok], 1)
                np.add.at(cover, end[ok], -1)
            use = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            doc = np.searchsorted(at, use, side="right") - 1
            yield runs[use], owner[doc], use - at[doc]

    return lambda batches: _packed(pieces(batches), buckets)


def _repeats(buckets: int):
    """Places of a bucket's hashes that occur twice, packed by the owners' buckets."""

    def run(rows: pa.Table) -> pa.Table:
        own, at, hashes, settled = [], [], [], []
        for h, *rest in zip(*(rows.column(c) for c in ("hashes", "owners", "runs", "places"))):
            h = np.frombuffer(h.as_buffer(), np.uint64)
            o, p = _spread(rest)
            if len(h):
                hashes.append(h), own.append(o), at.append(p)
            else:
                settled.append((o, p))
        if hashes:
            h, o, p = np.concatenate(hashes), np.concatenate(own), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            h, o, p = h[order], o[order], p[order]
            group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            known = (p & _SEEN) > 0
            repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=known) > 0)
            hit = repeated[group] & ~known
            settled.append((o[hit], p[hit]))
        o, p = (np.concatenate([x[i] for x in settled]) for i in range(2))
        to = o % buckets
        order = np.lexsort((p, o, to))
        o, p, to = o[order], p[order], to[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        parts = [slice(a, b) for a, b in zip(cuts, np.r_[cuts[1:], len(to)])]
        runs = [_run_lengths(o[x]) for x in parts]
        return pa.table(
            {
                "bucket": pa.array(to[cuts], pa.int32()),
                "owners": binary_column([x[0] for x in runs]),
                "runs": binary_column([x[1] for x in runs]),
                "places": binary_column([p[x] for x in parts]),
            }
        )

    return run


def _by_owner(rows: pa.Table) -> pa.Table:
    """One row per owner with all its places."""
    spread = [_spread(x) for x in zip(*(rows.column(c) for c in ("owners", "runs", "places")))]
    o, p = (np.concatenate([x[i] for x in spread]) for i in range(2))
    order = np.lexsort((p, o))
    o, p = o[order], p[order]
    owners, counts = _run_lengths(o)
    ends = np.cumsum(counts, dtype=np.int64)
    return pa.table(
        {
            "owner": pa.array(owners, pa.int64()),
            "marks": binary_column([p[b - n : b] for b, n in zip(ends, counts.astype(np.int64))]),
        }
    )


def _marked(packed: DataFrame, buckets: int) -> DataFrame:
    """(owner, marks): the repeated places of each owner."""
    found = packed.groupBy("bucket").applyInArrow(_repeats(buckets), _FOUND)
    return found.groupBy("bucket").applyInArrow(_by_owner, "owner long, marks binary")


def _finish(size: int, with_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digests, texts, spans = [], [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                gone = np.zeros(len(words) + 1, np.int64)
                if marks.is_valid:
                    p = np.unique(np.frombuffer(marks.as_buffer(), np.uint32)).astype(np.int64)
                    gone[p] += 1
                    np.add.at(gone, p + size, -1)
                    gone = np.cumsum(gone) > 0
                    kept = [w for w, g in zip(words, gone) if not g]
                    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8)]))
                    spans.append(edge.tolist())
                else:
                    kept = words
                    spans.append([])
                whole = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(whole).hexdigest())
                if with_text:  # an untouched text stays as it is
                    texts.append(text if len(kept) == len(words) else whole.decode("utf-8", "surrogatepass"))
            columns = [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(pa.int32())),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """(owner, marks): starts of the windows whose words also start elsewhere.

    ``docs`` has owner, text and what its caller joins the result with: the same
    columns on both sides let Spark shuffle the texts once.
    """
    if size < PERIOD:
        raise ValueError(f"windows have {PERIOD} words or more")
    buckets = buckets_for(docs)
    anchors = _marked(docs.select("owner", "text").mapInArrow(in_pieces(_anchors(size, buckets)), _PACK), buckets)
    around = docs.join(anchors, "owner").select("owner", "text", "marks", *[c for c in docs.columns if c not in ("owner", "text")])
    return _marked(around.mapInArrow(in_pieces(_windows(size, buckets)), _PACK), buckets)


def remove_repeats(docs: DataFrame, size: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed_spans [, kept_text].

    ``removed_spans`` lists word positions begin, end, begin, end, ...  A text
    that keeps all its words is handed on unchanged as ``kept_text``.
    """
    rows = documents(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("owner"))
    marks = repeated_windows(rows, size)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<int>"
    return (
        rows.join(marks, "owner", "left")
        .select("doc_id", "text", "marks")
        .mapInArrow(in_pieces(_finish(size, with_text)), schema + (", kept_text string" if with_text else ""))
    )


def _rewriter(size: int):
    finish = _finish(size, with_text=True)

    def run(batches):
        for batch in batches:
            for done in finish([batch]):
                yield pa.RecordBatch.from_arrays([batch.column(0), done.column("kept_text")], names=["others", "text"])

    return run


def without_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` loses its repeated windows and
    ``n_chars``, if there, follows.  A null text stays null."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    rows = docs.select(
        others.alias("others"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("owner"),
    )
    marks = repeated_windows(rows, size)
    done = rows.join(marks, "owner", "left").select("others", "text", "marks")
    kind = docs.select(others.alias("others")).schema["others"].dataType.simpleString()
    done = done.mapInArrow(in_pieces(_rewriter(size)), f"others {kind}, text string")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[changed.get(c, F.col("others")[c]).alias(c) for c in docs.columns])
