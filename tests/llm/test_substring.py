import hashlib
import random

import brute
import pytest
from quillmatch.llm import substring
from quillmatch.llm.substring import remove_repeats


def check(df, rows, size=35):
    want = []
    for (doc, text), gone in zip(rows, brute.removed_words(rows, size).values()):
        w = brute.words(text)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def test_cover():
    pairs = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert pairs == set(range(substring.PERIOD))


@pytest.mark.parametrize("flush", [50, 1_000_000])
def test_planted(spark, monkeypatch, flush):
    monkeypatch.setattr(substring, "FLUSH", flush)
    rng = random.Random(flush)
    fill = lambda n: " ".join(f"u{rng.random()}" for _ in range(n))
    shared = [f"s{i}" for i in range(90)]
    rows = []
    for k in range(120):  # matches of 30 to 60 words at all alignments, overlapping each other
        n = rng.randrange(30, 61)
        a = rng.randrange(0, 90 - n + 1)
        rows.append((k, f"{fill(rng.randrange(0, 40))} {' '.join(shared[a : a + n])}\n{fill(rng.randrange(0, 9))}"))
    rows += [(200, "la " * 100), (201, None), (202, ""), (203, " \t"), (204, fill(35)), (205, "é " * 34)]
    rows += [(206, fill(50))] * 2 + [(None, fill(60)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as owner", "2 as marks", "3 as places")
    want = check(df, rows)
    assert sum(x[2] for x in want) > 1000


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
