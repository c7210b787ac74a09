"""Token files: exact round trips, order, ranks and coding."""

import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillmatch.llm.tokenfile import decode, encode, read_tokens, token_digests, write_tokens

path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def whole(texts, file=path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.sampled_from([255, 256, 65535, 65536, 2**24 - 1, 2**24])), max_size=40))
def test_code(ranks):
    control, data = encode(np.array(ranks, np.uint32))
    assert decode(control, data, len(ranks)).tolist() == ranks
    sizes = [max(1, -(-r.bit_length() // 8)) for r in ranks]
    assert len(control) == -(-len(ranks) // 4) and len(data) == sum(sizes)
    assert data == b"".join(r.to_bytes(4, "little")[:n] for r, n in zip(ranks, sizes))
    assert [control[k // 4] >> 2 * (k % 4) & 3 for k in range(len(ranks))] == [n - 1 for n in sizes]


def check(got, rows):
    """``got`` holds every row's ids, start counted in ascending doc_id order."""
    want = sorted((r[0] is not None, r[0] or 0, ids) for r, ids in zip(rows, whole([r[1] for r in rows])))
    got = sorted(got, key=lambda r: r.start)
    place = 0
    for r, (known, doc, _) in zip(got, want):
        assert (r.doc_id is not None, r.doc_id or 0) == (known, doc) and r.start == place
        place += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) == sorted(
        [(doc if known else None, len(ids), crc(ids)) for known, doc, ids in want], key=lambda x: (x[0] is not None, x[0] or 0, x[1:])
    )


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(token_digests(docs, path).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_in_small_blocks(spark, tmp_path):
    odd = [
        "", None, " ", "Don't  STOP<|endoftext|>here", "ÀÉ Straße ΣΑΣ. İx ﬁ é", "a b \u0085 c\x1cd", "1234 ½²x __a__ 's'S'LL",
        "日本語 テキスト", "emoji 😀!!", "\x00\x01 \x7f", "word " * 40_000,
    ]
    rows = [(3 * i % 11, t) for i, t in enumerate(odd)] + [(4, "twice"), (4, "twice"), (4, "other"), (None, "no id"), (-9, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as uid", "'x' as ids", "3 as start")
    folder = str(tmp_path / "tokens")
    write_tokens(df, folder, path, block_ids=50, file_bytes=400)
    got = read_tokens(spark, folder).collect()
    check(got, rows)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
    blocks, ranks = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert blocks.select("part").distinct().count() > 1 and blocks.count() > 5
    assert all(a["count"] >= b["count"] for a, b in zip(ranks, ranks[1:])) and [r["rank"] for r in ranks] == list(range(len(ranks)))
    assert sum(r["count"] for r in ranks) == sum(r.n_tokens for r in got)


def test_empty(spark):
    assert token_digests(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_other_vocabulary(spark, tmp_path):
    """A file with other splitting rules goes through the whole tokenizer."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    assert "normalizer" in json.load(open(file))
    rows = [(1, "Two  words, one\nline"), (2, " It's 1234")]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), file)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_tokens(spark, str(tmp_path / "t")).collect()}
    assert got == dict(zip([1, 2], whole([t for _, t in rows], file)))
