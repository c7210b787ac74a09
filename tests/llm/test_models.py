import random

import numpy as np
from pyspark.sql import functions as F
from quillmatch.llm import toxicity, weaklabels

SF = "/root/testdata/sf0.01"


def test_weak_label_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = weaklabels.quality_scores(docs).select("doc_id", "kept").join(labels, "doc_id").toPandas()
    assert got.kept[got.quality == 1].mean() >= 0.98
    assert got.kept[got.quality == 0].mean() <= 0.25


def test_em_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(6000) < 0.8
    catch = np.array([0.7, 0.5, 0.6])
    bad_vote = np.where(good[:, None], rng.random((6000, 3)) < 0.03, rng.random((6000, 3)) < catch)
    prior, hit, caught = weaklabels.estimate(np.where(bad_vote, 0, 1))
    assert abs(prior - 0.8) < 0.07 and (np.abs(caught - catch) < 0.1).all() and (np.abs(hit - 0.97) < 0.03).all()


def test_em_by_brute_force():
    """Counted patterns give what all rows give; the answer is a fixed point of plainly written EM; accuracies move."""
    rng = np.random.default_rng(7)
    families = ["a", "a", "b", "b", None]
    kind = rng.choice(3, p=[0.8, 0.1, 0.1], size=5000)
    chance = np.array([[0.03, 0.0, 0.01, 0.02, 0.15], [0.9, 0.7, 0.02, 0.02, 0.3], [0.02, 0.05, 0.8, 0.75, 0.1]])
    v = (rng.random((5000, 5)) >= chance[kind]).astype(int)
    v[rng.random((5000, 5)) < 0.1] = -1
    shares, bad = weaklabels.mixture(v, families=families)
    patterns, n = np.unique(v, axis=0, return_counts=True)
    assert np.allclose(weaklabels.mixture(patterns, n, families)[1], bad, atol=1e-4)
    assert np.abs(shares - [0.8, 0.1, 0.1]).max() < 0.03 and np.abs(bad - chance).max() < 0.12
    prior, hit, catch = weaklabels.estimate(patterns, n, families)
    assert 0.75 < prior < 0.85 and 0.8 < hit[4] < 0.9 and (hit[:4] > 0.95).all() and len(set(catch.round(3))) == 5
    weight = {}
    for row, k in zip(patterns.tolist(), n):
        like = []
        for c in range(3):
            p = shares[c]
            for j, x in enumerate(row):
                p *= bad[c][j] if x == 0 else 1 - bad[c][j] if x == 1 else 1.0
            like.append(p)
        weight[tuple(row)] = [x / sum(like) * k for x in like]
        assert abs(weaklabels.posterior(np.array([row]), shares, bad)[0] - like[0] / sum(like)) < 1e-9
    member = [None, "a", "b"]
    for c in range(3):
        for j in range(5):
            expected = 0.05 if c == 0 else 0.7 if families[j] == member[c] else 0.1
            said = sum(w[c] for row, w in weight.items() if row[j] == 0)
            voted = sum(w[c] for row, w in weight.items() if row[j] >= 0)
            assert abs((said + 10 * expected) / (voted + 10) - bad[c][j]) < 1e-3
    m = len(weaklabels.LABELLERS)
    assert (weaklabels.decode([0, 3**m - 1, 5]) == np.array([[-1] * m, [1] * m, [1, 0] + [-1] * (m - 2)])).all()


def test_em_overrules_lone_votes(spark):
    """On the real texts the posterior is no rule of any single vote, and it is right where it departs from one."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id", "left").select("text", "quality").toPandas().drop_duplicates("text")
    v = weaklabels.votes(rows.text.tolist())
    patterns, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    good = weaklabels.posterior(patterns, *weaklabels.mixture(patterns, n, weaklabels.FAMILIES))[back.ravel()] >= 0.5
    said_bad, quality = (v == 0).sum(axis=1), rows.quality.to_numpy()
    overruled = good & (said_bad > 0)
    assert overruled.sum() > 100 and (quality[overruled & (quality >= 0)] == 1).mean() > 0.9
    assert (~good & (said_bad == 1)).sum() > 20  # not every lone vote is overruled
    assert good[quality == 1].mean() > (said_bad == 0)[quality == 1].mean() + 0.03
    assert good[quality == 1].mean() > 0.99 and good[quality == 0].mean() < 0.02


def test_sample_keeps_its_size(spark):
    """The smallest 64-bit hashes of different texts, as many as asked for however large the table is."""
    texts = spark.range(40_000).selectExpr("concat('text ', id % 30000) as text").unionAll(spark.createDataFrame([(None,), ("",)], "text string"))
    seen = texts.select(weaklabels._place(F.col("text")).alias("place")).distinct()
    got = [r.text for r in weaklabels.sampled(texts, seen, 700).collect()]
    places = {r.place: r.text for r in texts.select("text", weaklabels._place(F.col("text")).alias("place")).distinct().collect()}
    assert len(got) == len(set(got)) == 700 and got == [places[p] or "" for p in sorted(places)[:700]]
    assert weaklabels.sampled(texts, seen, 99_999).count() == 30_001


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.severity(docs, labels.where("doc_id % 3 <> 0")).withColumnRenamed("toxic", "flag")
    rows = got.join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    flag = rows["flag"]
    assert flag[rows.label == 1].mean() >= 0.6 and flag[rows.label == 0].mean() <= 0.03


def test_ordinal_order():
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(200)], k=60)) for _ in range(900)]
    toxic = np.arange(900) % 5 == 0
    for i in np.flatnonzero(toxic):
        texts[i] += " vile" * rng.randrange(1, 4) + " foul" * rng.randrange(0, 4)
    slot, value, at = toxicity.features(texts)
    grade = toxicity.grades(slot, value, at, toxic)
    assert set(grade) == set(range(toxicity.GRADES))
    w, theta = toxicity.fit(*toxicity.only(toxicity.telling_slots(slot, at, toxic), slot, value, at), grade)
    assert (np.diff(theta) >= 0).all()
    p = toxicity.predict(w, theta, ["plain words", "vile", "vile vile foul foul", "vile vile vile foul foul foul"])
    assert np.allclose(p.sum(axis=1), 1)
    expected = p @ np.arange(toxicity.GRADES)
    assert (np.diff(expected) > 0).all() and expected[0] < 0.3 < 1.5 < expected[-1]


def test_edges(spark):
    rows = [(1, None), (None, "some words here"), (2, ""), (2, ""), (3, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as quality", "2 as toxic", "3 as severity")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert {r.toxic for r in toxicity.severity(df, labels).collect()} == {False}
    got = weaklabels.quality_scores(df).collect()
    assert len(got) == 5 and not any(r.kept for r in got if r.doc_id in (1, 2))
    none = df.where("false")
    assert weaklabels.quality_scores(none).count() == 0 and toxicity.severity(none, labels).count() == 0


def test_toxicity_sample_is_bounded_by_order(spark):
    """Any number of labels leaves as many ids as asked for, the ones with the smallest hashes; texts count once."""
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('text ', id div 3) as text").unionAll(spark.createDataFrame([(5, "other"), (None, "x"), (9001, None)], "doc_id long, text string"))
    labels = spark.range(9002).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").unionAll(spark.createDataFrame([(4, 1), (7, None), (None, 1)], "doc_id long, toxic int"))
    rows = toxicity.labelled(docs, labels, 600).collect()
    ids = [r.doc_id for r in spark.range(9002).selectExpr("id as doc_id").orderBy(F.xxhash64("doc_id")).limit(600).collect()]
    want = {}
    for i in ids:
        texts = [f"text {i // 3}"] * (i < 9000) + ["other"] * (i == 5) + [""] * (i == 9001)
        for t in texts:
            want[t] = want.get(t, False) or i % 2 == 1 or i == 4
    assert {r.text: r.toxic for r in rows} == want and len(rows) == len(want)
    assert toxicity.labelled(docs, labels, 10**9 // 10**4).count() == 3002


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, ("vile " * 4 if k % 3 == 0 else "") + f"plain words number {k}") for k in range(60)] + [(100, None), (101, " "), (102, "vile " * 50_000), (None, "vile vile vile vile"), (3, "vile " * 4 + "plain words number 3")], "doc_id long, text string")
    got = toxicity.severity(docs.selectExpr("*", "1 as toxic", "'x' as grade"), labels).collect()
    flags = [(r.doc_id, r.toxic) for r in got]
    assert len(got) == 65 and dict(f for f in flags if f[0] in (100, 101, 102)) == {100: False, 101: False, 102: True}
    assert all(t == (i % 3 == 0) for i, t in flags if i is not None and i < 60) and (None, True) in flags
    assert toxicity.severity(docs.limit(0), labels).count() == 0
    assert not any(r.toxic or r.grade for r in toxicity.severity(docs, labels.limit(0)).collect())
