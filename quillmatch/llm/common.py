"""Shared pieces of the training-data operators.

Words are the runs of bytes outside {0x20, 0x09-0x0D}; ``bytes.split()`` cuts
at exactly these six bytes.  Word and shingle identities are 64-bit hashes.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Complement of the six separator characters, for Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial window hash


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder is set only on a
    single machine (``local`` masters) that configures none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quill-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    # shuffles that only led up to this are garbage now; Spark drops them when the JVM notices
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file bytes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many hash buckets keep one bucket's share of ``df`` near ``bytes_each``."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return int(min(max(floor, input_bytes(df) // bytes_each), 1_000_000))


def documents(df: DataFrame) -> DataFrame:
    """Only the two columns that the operators need, so that others cannot clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit word."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def in_pieces(run, rows: int = 512):
    """``run`` over slices of the Arrow batches, so that its arrays stay small."""

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return lambda batches: run(sliced(batches))


def word_hashes(texts: list, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text's first word and the end)."""
    parts = [np.zeros(0, np.uint64)]
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        offsets[i + 1] = offsets[i]
        if text is not None:
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
            words = (raw.lower() if lower else raw).split()
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            offsets[i + 1] += len(words)
    return np.concatenate(parts), offsets


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries, by binary composition:
    the hash of a run of a+b is hash(a) * base**b + hash(b)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, length, rest = None, 0, h, 1, size
        while rest:
            if rest & 1:
                if out is None:
                    out, done = power, length
                else:
                    step = np.uint64(pow(_BASE, length, 1 << 64))
                    m = len(h) - done - length + 1
                    out, done = out[:m] * step + power[done : done + m], done + length
            rest >>= 1
            if rest:
                step = np.uint64(pow(_BASE, length, 1 << 64))
                m = len(power) - length
                power, length = power[: max(m, 0)] * step + power[length:], length * 2
        return mix(out[:n] + np.uint64(size))


def binary_column(parts: list) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())
