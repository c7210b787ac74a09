"""Vector best-fit packing of tokenised documents into fixed-length sequences.

A map-only pass tokenises and cuts documents into pieces; only the pieces'
ids, lengths and checksums move on.  Pieces are dealt to groups of about
``group_rows`` and each group packs largest piece first: a sequence has
residual tokens, documents and attention cost (sum of squared lengths); of the
open sequences that fit a piece under all three, the one with the smallest
weighted residual norm afterwards takes it.  A second pass packs the
sequences that groups left open, as items of several pieces.

Defined cases: null or empty text is the end token alone; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import cut, documents, in_pieces

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Lower-cased Latin-1: letters, single digits, runs of anything else.
_UNITS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]"
    "|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
)
_PLAIN = re.compile("[\x21-\x7e¡-ÿ]+")
_LIMIT = 400_000


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordIds(dict):
    """Little-endian 32-bit ids of a word (bytes without separators), remembered.

    Words never share a token, so a document's ids are its words' ids joined.
    Latin-1 words take a short way through the vocabulary's own merges; all
    others, and those that may hold a control string, take the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.units: dict[str, bytes] = {}
        self.letters = _byte_alphabet()

    def unit(self, text: str) -> bytes:
        ids = self.units.get(text)
        if ids is None:
            shown = "".join([self.letters[b] for b in text.encode()])
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.units) >= _LIMIT:
                self.units.clear()
            self.units[text] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join([self.unit(u) for u in _UNITS.findall(text.lower())])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= _LIMIT:
            self.clear()
        self[word] = ids
        return ids


_LOADED: dict[str, WordIds] = {}


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches):
        ids_of = _LOADED.get(path)
        if ids_of is None:
            ids_of = _LOADED[path] = WordIds(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode("utf-8", "replace").split() if text else []
                ids = b"".join([*map(ids_of.__getitem__, words), end])
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def best_fit(items: np.ndarray, limits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bin number of each item; rows of ``items`` are demands, ``limits`` the capacity of a bin.

    Items come largest weighted demand first, ties in their given order.
    """
    demand = items / limits
    order = np.argsort(-(demand @ weights), kind="stable")
    room = np.empty((256, len(limits)))
    used, out = 0, np.empty(len(items), np.int64)
    live = np.zeros(0, np.int64)  # bins that may still take something
    least = items.min(axis=0) if len(items) else limits
    for i in order:
        best = -1
        if len(live):
            rest = room[live] - items[i]
            fits = np.flatnonzero((rest >= 0).all(axis=1))
            if len(fits):
                norm = ((rest[fits] / limits) ** 2) @ weights
                best = live[fits[np.argmin(norm)]]
        if best < 0:
            if used == len(room):
                room = np.concatenate([room, np.empty_like(room)])
            best, room[used] = used, limits
            live = np.append(live, used)
            used += 1
        room[best] -= items[i]
        out[i] = best
        if (room[best] < least).any():
            live = live[live != best]
    return out


def _packer(limits: tuple, weights: tuple):
    caps, w = np.array(limits, float), np.array(weights, float)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "docs", "item"], ascending=[False, False, True], kind="stable")
        bins = best_fit(rows[["tokens", "docs", "cost"]].to_numpy(float), caps, w)
        return pd.DataFrame({"item": rows["item"].to_numpy(), "bin": int(key[0]) * (1 << 32) + bins})

    return run


def _pack(items: DataFrame, limits: tuple, weights: tuple, group_rows: int) -> DataFrame:
    """(item, bin) for items(item, tokens, docs, cost)."""
    groups = max(1, -(-items.count() // group_rows))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_packer(limits, weights), "item long, bin long")


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    max_docs: int = 1024,
    max_cost: float | None = None,
    weights: tuple = (1.0, 0.05, 0.05),
    group_rows: int = 8192,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``max_docs`` pieces and ``max_cost`` summed squared lengths (a full
    sequence's by default) limit a sequence beside its ``capacity`` tokens.
    """
    limits = (float(capacity), float(max_docs), float(max_cost or capacity**2))
    pieces = documents(docs).mapInArrow(in_pieces(_cutter(vocabulary, end_id, capacity)), _PIECES)
    pieces = cut(pieces.withColumn("item", F.monotonically_increasing_id()))
    full = F.col("length") == capacity
    demand = pieces.where(~full).select(
        "item",
        F.col("length").cast("double").alias("tokens"),
        F.lit(1.0).alias("docs"),
        (F.col("length").cast("double") * F.col("length")).alias("cost"),
    )
    first = cut(_pack(demand, limits, weights, group_rows))
    bins = (
        demand.join(first, "item")
        .groupBy("bin")
        .agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.sum("cost").alias("cost"))
    )
    # what is left open by a twentieth or more is packed once more, sequence by sequence
    again = cut(bins.where(F.col("tokens") < 0.95 * capacity).withColumnRenamed("bin", "item"))
    second = _pack(again, limits, weights, group_rows).select(
        F.col("item").alias("bin"), (-1 - F.col("bin")).alias("joined")
    )
    placed = first.join(second, "bin", "left").select(
        "item", F.coalesce("joined", F.col("bin") * 2).alias("sequence_id")
    )
    out = pieces.join(placed, "item", "left").withColumn(
        "sequence_id", F.coalesce("sequence_id", F.col("item") * 2 + 1)
    )
    return out.selectExpr(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "sequence_id",
        "coalesce(sum(length) over (partition by sequence_id order by length desc, item"
        " rows between unbounded preceding and 1 preceding), 0) as offset",
    )
