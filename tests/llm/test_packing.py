import os
import zlib

import numpy as np
import pytest
from quillmatch.llm.packing import best_fit, pack

path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df, rows, capacity=4096):
    ids = dict(zip([r[0] for r in rows], whole([r[1] for r in rows])))
    out = df.toPandas()
    for doc, part in out.groupby("doc_id"):
        own = ids[doc]
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(-(-len(own) // capacity)))
        for r in part.itertuples():
            want = own[r.start : r.start + r.length]
            assert len(want) == r.length and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert part.length.sum() == len(own) and (part.length[:-1] == capacity).all()
    assert set(out.doc_id) == set(ids)
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]]
        assert seq.length.sum() <= capacity
    return out


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = check(pack(docs, path), [(r.doc_id, r.text) for r in docs.collect()])
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


def test_odd_texts(spark):
    odd = [
        "", None, " ", "Don't  STOP<|endoftext|>here", "x<|startoftext|>", "ÀÉ Straße ΣΑΣ. İx ﬁ e\u0301", "a\u00a0b \u0085 c\x1cd",
        "1234 ½²x __a__ 's'S'LL ªº", "日本語 テキスト", "emoji 😀!!", "µ×÷ ¿qué?", "\x00\x01 \x7f", "word " * 5000, "\u0130 \u212b",
    ]
    rows = list(enumerate(odd))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item", "2 as bin", "'x' as length")
    check(pack(df, path), rows)
    check(pack(df, path, capacity=7), rows, 7)


def test_empty_and_groups(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    rows = [(i, "a " * (i % 50)) for i in range(400)]
    out = check(pack(spark.createDataFrame(rows, "doc_id long, text string"), path, capacity=64, group_rows=20), rows, 64)
    assert out.sequence_id.nunique() <= 1.08 * out.length.sum() / 64 + 2


def test_best_fit_limits():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 100, 500).astype(float)
    items = np.c_[size, np.ones(500), size**2]
    limits = np.array([200.0, 5, 20000])
    bins = best_fit(items, limits, np.array([1.0, 0.1, 0.1]))
    for k in range(bins.max() + 1):
        assert (items[bins == k].sum(axis=0) <= limits).all() and (bins == k).any()


def test_every_limit_can_bind(spark):
    """Sequences stay under the cost and the document limit, and these decide how many there are."""
    rows = [(i, "a " * 19) for i in range(120)]  # 20 tokens with the end id, a cost of 400
    df = spark.createDataFrame(rows, "doc_id long, text string")
    free = check(pack(df, path, capacity=400), rows, 400)
    assert free.groupby("sequence_id").length.sum().max() == 400 and free.sequence_id.nunique() == 6
    costly = check(pack(df, path, capacity=400, max_cost=2000.0), rows, 400)
    cost = costly.assign(c=costly.length**2).groupby("sequence_id").c.sum()
    assert cost.max() == 2000 and len(cost) == 24
    few = check(pack(df, path, capacity=400, max_docs=3), rows, 400)
    assert few.groupby("sequence_id").size().max() == 3 and few.sequence_id.nunique() == 40


def test_short_texts_share_one_sequence(spark):
    rows = [(i % 4000, None if i % 2 else "") for i in range(4096)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), path, max_docs=4096).toPandas()
    assert got.sequence_id.nunique() == 1 and sorted(got.offset) == list(range(4096)) and (got.length == 1).all()
