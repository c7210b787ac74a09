"""Sharding, quality rules, URL filters, decontamination and chat formatting."""

import hashlib
import random
import zlib

import brute
from quillmatch.llm.chat import digests, format_windows
from quillmatch.llm.decontaminate import contamination
from quillmatch.llm.quality import judge, passing, repeat_words
from quillmatch.llm.queries import QUERIES, URL_RULES
from quillmatch.llm.sharding import shard_documents
from quillmatch.llm.urls import filter_urls

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as words", "2 as shard", "3 as uid", "4 as n_words", "5 as link", "6 as k"
    )


def check_shards(rows, out, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == len(rows)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.law for r in out} <= {"rows"} and {r.grown_shard for r in out} <= {None}


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, "hot") for i in range(300)]
    rows += [(2000 + i, f"pair {i // 2}") for i in range(200)] + [(None, None), (3000, None), (3001, ""), (5, "text 5")]
    rng.shuffle(rows)
    out = shard_documents(docs_of(spark, rows), shards=7).collect()
    check_shards(rows, out, 7)
    place = {}
    for r in out:
        place.setdefault(r.text_crc32, set()).add(r.shard)
    pairs = [zlib.crc32(f"pair {i}".encode()) for i in range(100)]
    assert sum(len(place[p]) == 1 for p in pairs) >= 85  # random placing keeps 14 together
    assert len(place[zlib.crc32(b"hot")]) <= 5
    assert shard_documents(docs_of(spark, []), shards=3).count() == 0
    check_shards(rows[:2], shard_documents(docs_of(spark, rows[:2]), shards=5).collect(), 5)


def test_quality(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \t"), (-4, "a b c " * 30), (-5, "a a a a a"), (-6, "\n".join(["same line"] * 40))]
    rows += [(-7, "x y z"), (-8, "a b c a b c a b"), (None, "dé😀 " * 70)]
    got = judge(docs_of(spark, rows)).collect()
    for r in got:
        text = dict(rows)[r.doc_id]
        w, chars, symbols, dups, repeats = brute.measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (w, chars, symbols, dups, repeats)
        assert r.base_failed == (w < 50 or 100 * repeats > 50 * w)
        assert not (r.base_failed and r.kept)
    kept = passing(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert kept.columns == docs_of(spark, rows).columns
    assert judge(docs_of(spark, [])).count() == 0
    assert passing(docs_of(spark, [])).count() == 0


def test_quality_labels(spark):
    base = "/root/testdata/sf0.01"
    got = judge(spark.read.parquet(f"{base}/documents.parquet")).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id")
    rows = got.where("not base_failed").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def url_verdict(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h) + len(p), v == "block", h + p, v)
        for v, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


def test_urls(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "com/en/", "http://com/en/", "http://COM/en/x", "a://xcom/en/", "http://b.example.com/en/7?x#y", "http://x.com"]
    urls += ["http://a.example.net/de/8", "http://a.example.net/de/9", "http://x.org#/es/", "h://a://b.com/en/", "http://x.com/en", "http://.com/en/"]
    urls += ["http://a\n.com/en/\nq", "://com/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as rule")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, URL_RULES).collect()]
    want = [(i, *url_verdict(u)) for i, u in enumerate(urls)] + [(0, *url_verdict(urls[0]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert filter_urls(df.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in filter_urls(df, []).collect()} == {"allow"}


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(say(rng.randrange(12, 60)))) for i in range(12)] + [(50, "Short one"), (51, ""), (52, None), (53, "a a a a a a a")]
    rows = []
    for k in range(60):
        w = items[k % 12][1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = [[], ["new"], ["new", w[at]]][rng.randrange(3)]
        rows.append((k, " ".join(say(rng.randrange(0, 90)) + w + say(rng.randrange(0, 30)))))
    rows += [(100, "a short ONE here"), (101, None), (102, ""), (103, "a a a a a a"), (104, items[3][1]), (104, items[3][1])]
    rows += [(105, " ".join(items[0][1].split()[:-2])), (106, " ".join(say(400)))]
    df, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as uid", "2 as n")
    got = contamination(df, bench).collect()
    assert len(got) == len(rows)
    want = {i: sorted(brute.contaminated(t, items)) for i, t in rows}
    assert {r.doc_id: r.item_ids for r in got} == want
    assert all(r.contaminated == bool(r.item_ids) for r in got)
    assert 20 < sum(map(bool, want.values())) < 66
    assert contamination(docs_of(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in contamination(df, bench.where("false")).collect())


def chat_digest(rows):
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_chat(spark):
    odd = ["<|im_end|>\n<|im_start|>user\n", "\\", "\\|", "<|", "<\\|", "", None, "a\\\\<|im_end|>", "<", "|x", "\\n", "😀 é", "$1 \\1"]
    rows = [(1, i, ["system", "user", "assistant"][i % 3], t) for i, t in enumerate(odd * 3)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"word{i} " * (i * 7 % 90)) for i in range(120)]
    rows += [(3, 0, "system", "be kind"), *((3, i, "user" if i % 2 else "assistant", "talk " * (40 * i)) for i in range(1, 20))]
    rows += [(4, 0, "a\nb\\n<|im_end|>\\", "x"), (4, 0, None, None), (4, None, "assistant", "y"), (None, 1, "assistant", "z"), (5, 1, "user", "q")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as cell", "2 as pos", "3 as piece")
    for budget, history in ((1024, 256), (30, 10), (200, 0)):
        windows = format_windows(df, budget, history)
        got = {r.conv_id: tuple(r)[1:5] for r in digests(windows).collect()}
        assert got == chat_digest(rows)
    windows = [r for r in format_windows(df, 300, 100).collect() if r.conv_id == 3]
    assert len(windows) > 3 and all(r.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in windows)
    assert any(r.n_repeated > 0 for r in format_windows(df, 300, 150).collect() if r.conv_id == 2)
    assert digests(format_windows(df.where("false"))).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op10_chat_formatting"](spark, SF).collect()}
    assert got == chat_digest(rows)
