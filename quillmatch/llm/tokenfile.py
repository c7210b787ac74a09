"""Token-id files: frequency-ranked ids in bytes of variable number, control bytes apart.

Writing: a map-only pass tokenises, one aggregate counts every id (at most as
many rows as the vocabulary has), and ids become ranks, so that the frequent
ones take one byte.  Documents are dealt to files by ranges of doc_id; within
a file, consecutive documents fill blocks of about ``block_ids`` ids.

Format, a folder of two Parquet tables:

* ``ranks``: rank, id, count; rank 0 is the most frequent id, ties by id.
* ``blocks``: part (files in ascending doc_id), block (in a part), before (ids
  of the part in front of the block), doc_ids, lengths (ids per document),
  ``control`` and ``data``.  A control byte holds the byte counts less one of
  four ranks, two bits each, the first in the lowest bits; ``data`` holds the
  ranks' low bytes, little-endian, without gaps.

Reading looks each control byte up in a table of the 16 byte places of its
four ranks and scatters ``data`` there in one step.

Defined cases: null or empty text is the end id alone; null doc_ids come first;
repeated rows are written each, in any order among themselves; an empty table
gives no block and no rank; very long texts are whole, a block holds one
document at least; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import cut, documents, in_pieces, shared_folder
from quillmatch.llm.packing import WordIds

#: The splitting rules under which words never share a token.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: Byte places in use, four for each of a control byte's four ranks.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
PLACES = (np.arange(4) < _SIZES[:, :, None]).reshape(256, 16)

_BLOCK = (
    "part int, block int, before long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    places = PLACES[control].reshape(-1)[: 4 * len(ranks)]
    return control.tobytes(), ranks.view(np.uint8)[places].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of ``encode``'s result."""
    places = PLACES[np.frombuffer(control, np.uint8)].reshape(-1)[: 4 * n]
    out = np.zeros(4 * n, np.uint8)
    out[places] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


_LOADED: dict = {}


def tokenizer(path: str):
    """text -> little-endian 32-bit ids; word by word where the file's rules allow it."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        words = WordIds(path)
        if all(rules.get(k) == v for k, v in WORDWISE.items()):
            _LOADED[path] = lambda text: b"".join(map(words.__getitem__, text.encode("utf-8", "replace").split()))
        else:
            _LOADED[path] = lambda text: np.array(
                words.whole.encode(text, add_special_tokens=False).ids, "<u4"
            ).tobytes()
    return _LOADED[path]


def _ids(path: str, end_id: int, width: str):
    def run(batches):
        ids_of, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [
                np.frombuffer(ids_of(text or "") + end, "<u4").astype(width).tobytes()
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _counter(width: str):
    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            if len(found) > len(counts):
                counts, found = found, counts
            counts[: len(found)] += found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    return run


def _blocks(book: np.ndarray, width: str, block_ids: int):
    """Consecutive documents (part, doc_id, ids) to rows of ``_BLOCK``."""
    rank_of = np.zeros(int(book.max()) + 1 if len(book) else 1, np.uint32)
    rank_of[book] = np.arange(len(book), dtype=np.uint32)

    def run(batches):
        part, block, before, docs, parts, held = 0, 0, 0, [], [], 0

        def flush():
            control, data = encode(rank_of[np.frombuffer(b"".join(parts), width)])
            size = np.dtype(width).itemsize
            values = (part, block, before, held, docs, [len(p) // size for p in parts], control, data)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            names = [c.split()[0] for c in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for part, doc, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // np.dtype(width).itemsize
                if held >= block_ids:
                    yield flush()
                    block, before, docs, parts, held = block + 1, before + held, [], [], 0
        if parts:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, block_ids: int = 1 << 18, file_bytes: int = 32 << 20
) -> None:
    """Write all texts of ``docs`` as token files into the new ``folder``, about ``file_bytes`` of ids a file."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()])
    width = "<u2" if largest < 1 << 16 else "<u4"
    ids = cut(documents(docs).mapInArrow(in_pieces(_ids(vocabulary, end_id, width)), "doc_id long, ids binary"))
    # at most one row per id of the vocabulary
    counted = ids.select("ids").mapInArrow(in_pieces(_counter(width)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(((r["n"], r["id"]) for r in counted.collect()), key=lambda x: (-x[0], x[1]))
    ranks = [(k, i, n) for k, (n, i) in enumerate(found)]
    spark.createDataFrame(ranks, "rank long, id long, count long").coalesce(1).write.parquet(f"{folder}/ranks")
    files = max(1, -(-sum(n for n, _ in found) * np.dtype(width).itemsize // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("uid").asc()]
    listed = ids.withColumn("uid", F.monotonically_increasing_id())
    in_order = listed.repartitionByRange(int(files), *order).sortWithinPartitions(*order)
    book = np.array([i for _, i in found], np.int64)
    in_order.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(
        in_pieces(_blocks(book, width, block_ids)), _BLOCK
    ).write.parquet(f"{folder}/blocks")


def _reader(book: np.ndarray, with_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = book[decode(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - np.array(row["lengths"], np.int64)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + (row["start"] + row["before"]), pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) the little-endian 32-bit ids of every document."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    ranks = spark.read.schema("rank long, id long, count long").parquet(f"{folder}/ranks")
    book = np.array([r["id"] for r in ranks.orderBy("rank").select("id").collect()], "<u4")
    # one row per file
    starts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr(
        "part", "sum(n) over (order by part) - n as start"
    )
    rows = blocks.join(F.broadcast(starts), "part").select("start", "before", "n_ids", "doc_ids", "lengths", "control", "data")
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(in_pieces(_reader(book, with_ids), 8), kinds)


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` into a folder of their own in the shared folder and read the files back, without the ids."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, folder, vocabulary, end_id)
    return read_tokens(spark, folder, with_ids=False)
