"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

from quillmatch.llm.resample import importance_resample

DOCS = "doc_id long, text string"


def brute(docs, target, buckets=10_000, longest=1, percent=10, least=20, seed=2024):
    def words(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)

    def hashed(w):
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(x.encode()) % buckets for x in runs]

    own, aim = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in hashed(words(text)):
            own[b] += 1
    for text in target:
        for b in hashed(words(text)):
            aim[b] += 1
    s, t = sum(own), sum(aim)
    gain = [math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(own, aim)]
    rows = []
    for i, text in docs:
        found = hashed(words(text))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=str)


def run(spark, docs, target, **options):
    got = importance_resample(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t,) for t in target], "text string"), **options
    )
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    book = ["Alpha", "beta2", "Äther", "naïve", "x-y", "日本", "OMEGA", "zeta", "1st"]
    return [" ".join(rng.choice(book) + str(rng.randrange(6)) for _ in range(rng.randrange(12, 60))) for _ in range(n)]


def test_random_documents(spark):
    docs, target = list(enumerate(texts(400, 1))), texts(30, 2)
    want = brute(docs, target)
    assert run(spark, docs, target) == want and sum(r[4] is not None for r in want) > 20


def test_runs_of_words_and_other_shares(spark):
    docs, target = list(enumerate(texts(150, 3))), texts(20, 4)
    options = dict(buckets=97, longest=3, percent=100, seed=5)
    assert run(spark, docs, target, min_words=30, **options) == brute(docs, target, least=30, **options)
    assert run(spark, docs, target, percent=0) == brute(docs, target, percent=0)


def test_ties_and_odd_rows(spark):
    same = "one two three four five " * 5
    docs = [(7, same)] * 40 + [(1, None), (2, ""), (None, same), (None, "  "), (3, "--- !!!"), (4, "Word " * 50_000), (-5, same)]
    docs += [(i, same) for i in range(100, 140)]
    assert run(spark, docs, ["one two"]) == brute(docs, ["one two"])
    assert run(spark, docs, [None, ""], percent=50) == brute(docs, [], percent=50)


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    docs = list(enumerate(texts(30, 6)))
    assert run(spark, docs, []) == brute(docs, [])


def test_clashing_columns(spark):
    docs = list(enumerate(texts(60, 7)))
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as words", "2 as buckets", "3 as score", "4 as uid", "5 as rank", "6 as able")
    aim = spark.createDataFrame([("alpha1",)], "text string").selectExpr("*", "1 as doc_id", "2 as bucket")
    assert sorted(map(tuple, importance_resample(df, aim).collect()), key=str) == brute(docs, ["alpha1"])
