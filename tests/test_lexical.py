"""The saved lexical index against BM25 written plainly, through additions, changes and removals."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from quillmatch.functions import fixed as X
from quillmatch.operators import lexical as L


def views():
    return {"all": F.col("text"), "title": F.col("title")}


def tokens(text):
    return [t for t in re.findall(r"\w{2,}", (text or "").lower()) if t not in X.INDEX_STOPWORDS]


def plain(docs, queries, k, fill=False):
    """{(field, topic): [(doc, score)]} for docs {id: {field: text}} and queries {(field, topic): text}."""
    out = {}
    for (field, topic), text in queries.items():
        bags = {i: tokens(d[field]) for i, d in docs.items()}
        mean = sum(map(len, bags.values())) / max(len(bags), 1)
        scores = {}
        for term in tokens(text):
            df = sum(term in b for b in bags.values())
            for i, b in bags.items():
                tf = b.count(term)
                if tf:
                    idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf / (tf + X.K1 * (1 - X.B + X.B * len(b) / mean))
        ranked = sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))
        if fill:
            ranked += [(i, 0.0) for i in sorted(docs) if i not in scores]
        if ranked:
            out[field, topic] = ranked[:k]
    return out


def got(run):
    out = {}
    for r in sorted(run.collect(), key=lambda r: r["rank"]):
        out.setdefault((r.field, r.topic_id), []).append((r.doc_id, r.score))
        assert len(out[r.field, r.topic_id]) == r["rank"]
    return out


def near(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert [x[0] for x in a[key]] == [x[0] for x in b[key]], key
        assert all(abs(x[1] - y[1]) < 2e-6 for x, y in zip(a[key], b[key]))


def frame(spark, docs):
    return spark.createDataFrame([(i, d["all"], d["title"]) for i, d in docs.items()], "doc_id long, text string, title string")


def asked(spark, queries):
    return spark.createDataFrame([(t, f, x) for (f, t), x in queries.items()], "topic_id long, field string, text string")


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)] + ["common"] * 30
    text = lambda m: " ".join(rng.choice(words) for _ in range(rng.randrange(m)))
    return {i: {"all": text(60), "title": text(5)} for i in range(n)}


QUERIES = {("all", 1): "word1 word2 common common", ("title", 1): "word3 common", ("all", 2): "unknown the", ("title", 3): "word7", ("all", 4): None}


def test_additions_changes_and_removals(spark, tmp_path):
    path, docs = str(tmp_path / "index"), corpus(80, 1)
    docs[80], docs[81] = {"all": None, "title": None}, {"all": "the of", "title": ""}
    L.add(frame(spark, docs), path, views(), block_rows=200)
    assert spark.read.parquet(f"{path}/postings").select("block").distinct().count() > 3
    near(got(L.search(spark, path, asked(spark, QUERIES), 30, fill=True)), plain(docs, QUERIES, 30, True))
    # more documents, then changed and removed ones
    more = {i + 100: d for i, d in corpus(30, 2).items()}
    docs |= more
    L.add(frame(spark, more), path, views(), block_rows=200)
    near(got(L.search(spark, path, asked(spark, QUERIES), 10)), plain(docs, QUERIES, 10))
    changed = {i: {"all": d["title"], "title": d["all"]} for i, d in list(docs.items())[5:15]}
    docs |= changed
    for i in (1, 2, 101):
        del docs[i]
    L.add(frame(spark, changed), path, views(), spark.createDataFrame([(1,), (2,), (101,), (999,)], "doc_id long"))
    near(got(L.search(spark, path, asked(spark, QUERIES), 200, fill=True)), plain(docs, QUERIES, 200, True))
    assert L.live(spark, path).count() == len(docs)


def test_update_reads_only_what_changed(spark, tmp_path):
    path, docs = str(tmp_path / "index"), corpus(40, 3)
    assert L.update(frame(spark, docs), path, views()) == (40, 0, 0)
    assert L.update(frame(spark, docs), path, views()) == (0, 40, 0)
    assert L.generations(spark, path) == [0]
    docs[3] = {"all": "word1 fresh", "title": "word7"}
    docs[50] = {"all": "word2", "title": "word7 word7"}
    del docs[7]
    assert L.update(frame(spark, docs), path, views()) == (2, 38, 1)
    assert {r.doc_id for r in spark.read.parquet(f"{path}/postings").where("generation = 1").collect()} == {3, 50}
    near(got(L.search(spark, path, asked(spark, QUERIES), 10)), plain(docs, QUERIES, 10))


def test_an_addition_that_died_is_not_there(spark, tmp_path):
    from quillmatch.sources import folders

    path, docs = str(tmp_path / "index"), corpus(20, 4)
    L.add(frame(spark, docs), path, views())
    L.add(frame(spark, {99: {"all": "word1", "title": "word7"}}), path, views())
    folders.remove(spark, f"{path}/size/generation=1")
    near(got(L.search(spark, path, asked(spark, QUERIES), 10)), plain(docs, QUERIES, 10))
    assert L.add(frame(spark, {98: {"all": "word1", "title": "x"}}), path, views()) == 1
    assert {r.doc_id for r in L.live(spark, path).collect()} == {*docs, 98}


def test_search_reads_the_blocks_of_its_terms(spark, tmp_path):
    path, docs = str(tmp_path / "index"), corpus(300, 5)
    L.add(frame(spark, docs), path, views(), block_rows=100)
    terms = L.asked_terms(asked(spark, {("all", 1): "word3"}))
    found, _ = L.hits(spark, path, terms)
    index = spark.read.parquet(f"{path}/postings")
    blocks = {r.block for r in index.where("term = 'word3' and field = 'all'").select("block").distinct().collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    named = re.search(r"PartitionFilters: \[[^\]]*block#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert {int(b) for b in (named[1] or named[2]).split(",")} == blocks
    assert len(blocks) < index.select("block").distinct().count() / 2
    assert found.count() == sum("word3" in tokens(d["all"]) for d in docs.values())


def test_odd_input(spark, tmp_path):
    path = str(tmp_path / "index")
    assert L.search(spark, path, asked(spark, QUERIES), 5).count() == 0
    with pytest.raises(ValueError):
        L.add(spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "doc_id long, text string, title string"), path, views())
    L.add(frame(spark, {}), path, views())
    assert L.search(spark, path, asked(spark, QUERIES), 5, fill=True).count() == 0
    L.add(frame(spark, {5: {"all": "word1 " * 30_000, "title": None}}), path, views())
    assert got(L.search(spark, path, asked(spark, {("all", 1): "word1"}), 5)) == {("all", 1): [(5, round(math.log(1 + 0.5 / 1.5) * 30_000 / (30_000 + X.K1), 6))]}


def test_weights():
    assert L.field_weights("all=2,eligibility = 0") == X.FIELD_WEIGHTS | {"all": 2.0, "eligibility": 0.0}
    assert L.field_weights("") == X.FIELD_WEIGHTS
    for bad in ("title=1", "all=x", "all=-1", "all=inf", "all"):
        with pytest.raises(ValueError):
            L.field_weights(bad)


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["x"],)], "t array<string>")
    rows = [{r.term: r.tf for r in x.c} for x in df.select(L.counted(F.col("t")).alias("c")).collect()]
    assert rows == [{"a": 1, "b": 3}, {}, {"x": 1}]
