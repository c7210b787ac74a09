"""The simplex against one written plainly, weights on a fixture, and sliding windows."""

import math
import random

from pyspark.sql import functions as F
from quillmatch.functions import fixed as X
from quillmatch.operators import calibration as K
from quillmatch.operators import eligibility as E
from quillmatch.operators import ranking as G


def plain_simplex(f, start, rounds, xtol=1e-3, ftol=1e-3):
    """The textbook method, one evaluation at a time, for a minimum of ``-f``."""
    n = len(start)
    points = [list(start)]
    for k in range(n):
        p = list(start)
        p[k] = p[k] * 1.05 if p[k] else 0.00025
        points.append(p)
    cost = lambda p: -f(tuple(p))
    costs = [cost(p) for p in points]
    for _ in range(rounds):
        order = sorted(range(n + 1), key=lambda i: costs[i])
        points, costs = [points[i] for i in order], [costs[i] for i in order]
        if max(abs(x - y) for p in points[1:] for x, y in zip(p, points[0])) <= xtol and max(c - costs[0] for c in costs[1:]) <= ftol:
            break
        mid = [sum(p[k] for p in points[:-1]) / n for k in range(n)]
        at = lambda t: [m + t * (m - w) for m, w in zip(mid, points[-1])]
        back = at(1)
        if cost(back) < costs[0]:
            far = at(2)
            points[-1] = far if cost(far) < cost(back) else back
        elif cost(back) < costs[-2]:
            points[-1] = back
        else:
            half = at(0.5) if cost(back) < costs[-1] else at(-0.5)
            bound = cost(back) if cost(back) < costs[-1] else costs[-1]
            fine = cost(half) <= bound if cost(back) < costs[-1] else cost(half) < bound
            if fine:
                points[-1] = half
            else:
                points = [points[0]] + [[b + 0.5 * (x - b) for x, b in zip(p, points[0])] for p in points[1:]]
        costs = [cost(p) for p in points]
    k = min(range(n + 1), key=lambda i: costs[i])
    return tuple(points[k]), -costs[k]


def test_simplex_equals_the_plain_one():
    targets = [
        lambda p: -sum((x - k) ** 2 for k, x in enumerate(p)),
        lambda p: -(100 * (p[1] - p[0] ** 2) ** 2 + (1 - p[0]) ** 2) - abs(p[2]),
        lambda p: round(math.sin(p[0]) * math.cos(p[1]) - 0.1 * abs(p[2] - 1), 4),
    ]
    for f in targets:
        for start in ((1.0, 0.3, 0.0), (-1.2, 1.0, 2.0)):
            got = K.simplex(lambda ps, f=f: [f(p) for p in ps], start, 120)
            point, value = plain_simplex(f, start, 120)
            assert abs(got.value - value) < 1e-12 and all(abs(a - b) < 1e-9 for a, b in zip(got.point, point))
            assert got.history == sorted(got.history) and got.value >= f(start)


ROW = "topic_id long, doc_id long, grade int, elig double, status_bonus double, phase_score double, recency double, geography double, prior double, fraction_nei double, avg_confidence double, exc_met long, mandatory_failed boolean"


def fixture(seed=5):
    rng = random.Random(seed)
    rows = []
    for t in range(6):
        for d in range(25):
            good = rng.random()
            # grades follow phase and recency, which the default weights hardly count
            rows.append((t, d, 2 if good > 0.8 else 1 if good > 0.6 else 0, rng.random(), rng.random(), good, good, rng.random(), rng.random(), rng.random(), rng.random(), int(rng.random() < 0.1), False))
    return rows


def plain_ndcg(rows, point):
    w = K.weights_of(point)
    total, topics = 0.0, sorted({r[0] for r in rows})
    for t in topics:
        scored = []
        for _, d, g, elig, status, phase, recency, geo, prior, nei, sure, hit, failed in (r for r in rows if r[0] == t):
            base = w["eligibility"] * elig + w["recruiting"] * status + w["phase"] * phase + w["recency"] * recency + w["geography"] * geo + w["retrieval"] * prior - w["nei"] * nei
            base *= w["blend"] * sure + 1 - w["blend"]
            scored.append((-round(-1 + w["veto_tie"] * prior if hit or failed else base, 9), d, g))
        dcg = lambda gs: sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(gs[:10]))
        ideal = dcg(sorted((g for *_, g in scored), reverse=True))
        total += dcg([g for *_, g in sorted(scored)]) / ideal if ideal else 0.0
    return round(total / len(topics), 9)


def test_seven_weights_on_a_fixture(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, ROW)
    start = tuple(X.SCORE_WEIGHTS[n] for n in K.FITTED)
    points = [start, (0.1, 0.1, 1.0, 1.0, 0.0, 0.0, 1.7), (1.0,) * 7]
    scores = [E.trial_score("benchmark", False, K.weights_of(p)) for p in points]
    assert all(abs(a - b) < 1e-8 for a, b in zip(K.ndcg(df, scores), [plain_ndcg(rows, p) for p in points]))
    found = K.calibrate(df, rounds=12)
    assert len(found.point) == 7 and found.history == sorted(found.history) and found.value > found.history[0]
    point, value = plain_simplex(lambda p: plain_ndcg(rows, p), start, 12)
    assert abs(found.value - value) < 1e-8 and all(abs(a - b) < 1e-6 for a, b in zip(found.point, point))
    assert 0 <= K.shares(found)["blend"] <= 1
    assert K.calibrate(df.where("topic_id > 99"), rounds=3).point == start


def plain_windows(ranked, k, window, step):
    """``ranked``: (doc, score) in order; windows from the back until one starts at the head."""
    pool, end = list(ranked[:k]), len(ranked[:k])
    while True:
        start = max(0, end - window)
        pool[start:end] = sorted(pool[start:end], key=lambda x: (x[1] is None, -(x[1] or 0)))
        if start == 0:
            return [d for d, _ in pool]
        end -= step


def test_listwise_windows(spark):
    rng = random.Random(8)
    runs = {t: [(d, rng.choice([None, *[round(rng.random(), 1) for _ in range(9)]])) for d in rng.sample(range(1000), n)] for t, n in enumerate([0, 1, 7, 20, 21, 30, 35, 100, 130])}
    df = spark.createDataFrame([(t, d, k + 1, s) for t, run in runs.items() for k, (d, s) in enumerate(run)], "topic_id long, doc_id long, rank int, s double")
    for k, window, step in ((100, 20, 10), (30, 5, 5), (50, 4, 1)):
        got = {}
        for r in sorted(G.listwise_windows(df, F.col("s"), k, window, step).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.topic_id, []).append(r.doc_id)
        assert got == {t: plain_windows(run, k, window, step) for t, run in runs.items() if run}
