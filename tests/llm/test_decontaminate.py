"""SimHash blocks decide which windows are verified."""

import random

from quillmatch.llm.decontaminate import RUN, contamination, fingerprints, lane_width, matches, search
from pyspark.sql import functions as F


def say(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_rolling_fingerprints(spark):
    rng = random.Random(4)
    g = [rng.getrandbits(64) - (1 << 63) for _ in range(RUN + 40)] + [7] * 30
    df = spark.createDataFrame([(g, 41), (g[:9], 9), ([5], 1)], "g array<long>, m int")
    for width in (16, 32):
        for r in df.select("g", "m", fingerprints("g", "m", width).alias("prints")).collect():
            assert len(r.prints) == len(r.g) - r.m + 1
            for i, found in enumerate(r.prints):
                part = r.g[i : i + r.m]
                want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > r.m)
                assert found % (1 << 64) == want


def test_blocks_reject_and_lose_nothing(spark):
    rng = random.Random(5)
    items = [(i, " ".join(say(rng, 20 + i))) for i in range(30)]
    docs = []
    for i, text in items:
        w = text.split()
        docs.append((i, " ".join(say(rng, 300) + w + say(rng, 300))))
        w[len(w) // 2] = "other"  # four or five shingles differ
        docs.append((100 + i, " ".join(say(rng, 50) + w)))
        docs.append((200 + i, " ".join(say(rng, 30) + w[: len(w) // 2] + say(rng, 30))))
    df = spark.createDataFrame(docs, "uid long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    _, windows, close = search(df, bench)
    looked_at = windows.select(F.sum(F.size("g") - F.col("m") + 1)).first()[0]
    passed = close.select("uid", "n", "lo", "at").distinct().count()
    assert 0 < passed < looked_at / 2
    got = {(r.uid, r.item_id) for r in matches(df, bench).collect()}
    assert {(i, i) for i, _ in items} <= got
    # one word replaced: m - 5 of m shingles are shared, so 100 (m - 5) >= 80 (m + 5)
    assert {x for x in got if 100 <= x[0] < 200} == {(100 + i, i) for i, t in items if len(t.split()) - 4 >= 45}


def test_very_long_item(spark):
    rng = random.Random(6)
    long = say(rng, 20_000)
    assert lane_width(20_000) == 32 and lane_width(50) == 16
    items = [(1, " ".join(long)), (2, " ".join(say(rng, 30))), (2, " ".join(long[50:90]))]
    docs = [(1, " ".join(say(rng, 40) + long + say(rng, 40))), (2, " ".join(long[:17_000])), (3, " ".join(long[:12_000])), (4, None)]
    got = contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {r.doc_id: r.item_ids for r in got.collect()} == {1: [1, 2], 2: [1, 2], 3: [2], 4: []}
