"""Score weights that maximise mean NDCG@10, found by a downhill simplex whose points are scored together.

The search itself is a handful of numbers on the driver.  What it asks of the
data is one aggregate a round: the rows are scored under all points that the
round may need (reflection, expansion, both contractions) at once, each topic's
first ten are taken per point, and one row per point comes back.  Only a
shrinking round needs a second aggregate, for all of its new points.

Defined cases: no rows leave the start as it is; a topic without relevant
documents counts as 0; ties of scores go to the smaller doc_id; the blend is
held between 0 and 1; equal points keep their order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.operators import eligibility as E
from quillmatch.operators.evaluation import gain
from quillmatch.operators.lineage import cut
from quillmatch.operators.retrieval import top

#: The weights that are fitted, in the order of a point's numbers.
FITTED = ("eligibility", "recruiting", "phase", "recency", "geography", "nei", "blend")

Points = list[tuple[float, ...]]


class Found(NamedTuple):
    point: tuple[float, ...]
    value: float
    rounds: int
    #: The best value after each round.
    history: list[float]
    #: The value of the point it started from.
    start: float


def simplex(values: Callable[[Points], list[float]], start: tuple, rounds: int = 200, xtol: float = 1e-3, ftol: float = 1e-3) -> Found:
    """The point near ``start`` with the largest value; ``values`` scores a list of points at once."""
    size = len(start)
    corners = [tuple(start)]
    for k in range(size):
        step = list(start)
        step[k] = step[k] * 1.05 if step[k] else 0.00025
        corners.append(tuple(step))
    rated = list(zip(values(corners), corners))
    first = rated[0][0]
    rated.sort(key=lambda x: -x[0])
    history = [rated[0][0]]
    for done in range(rounds):
        best, worst = rated[0], rated[-1]
        near = max(abs(a - b) for _, p in rated[1:] for a, b in zip(p, best[1]))
        if near <= xtol and max(best[0] - v for v, _ in rated[1:]) <= ftol:
            return Found(best[1], best[0], done, history, first)
        middle = [sum(p[k] for _, p in rated[:-1]) / size for k in range(size)]
        along = lambda t: tuple(m + t * (m - w) for m, w in zip(middle, worst[1]))  # noqa: E731, B023
        tried = [along(1.0), along(2.0), along(0.5), along(-0.5)]
        back, far, outside, inside = zip(values(tried), tried)
        if back[0] > best[0]:
            new = far if far[0] > back[0] else back
        elif back[0] > rated[-2][0]:
            new = back
        elif back[0] > worst[0]:
            new = outside if outside[0] >= back[0] else None
        else:
            new = inside if inside[0] > worst[0] else None
        if new is not None:
            rated[-1] = new
        else:
            drawn = [tuple(b + 0.5 * (x - b) for x, b in zip(p, best[1])) for _, p in rated[1:]]
            rated = [best, *zip(values(drawn), drawn)]
        rated.sort(key=lambda x: -x[0])
        history.append(rated[0][0])
    return Found(rated[0][1], rated[0][0], rounds, history, first)


def weights_of(point: tuple) -> dict[str, float]:
    """All score weights with a point's numbers in place."""
    found = dict(zip(FITTED, point))
    return X.SCORE_WEIGHTS | found | {"blend": min(max(found["blend"], 0.0), 1.0)}


def ndcg(rows: DataFrame, scores: list[Column]) -> list[float]:
    """Mean NDCG@10 over the topics of ``rows`` (topic_id, doc_id, grade) under each of ``scores``; one job."""
    cells = [F.struct(F.lit(k).alias("place"), F.round(s, 9).alias("score")) for k, s in enumerate(scores)]
    scored = rows.select("topic_id", "doc_id", "grade", F.inline(F.array(*cells)))
    first = top(scored, ["place", "topic_id"], [F.desc("score"), F.asc("doc_id")], 10)
    got = first.groupBy("place", "topic_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = top(rows.select("topic_id", "doc_id", "grade"), ["topic_id"], [F.desc("grade"), F.asc("doc_id")], 10)
    ideal = best.groupBy("topic_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).alias("ideal"))
    share = F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))
    means = {r.place: r.mean for r in got.join(ideal, "topic_id").groupBy("place").agg(F.avg(share).alias("mean")).collect()}
    return [round(means.get(k, 0.0), 9) for k in range(len(scores))]


def calibrate(rows: DataFrame, mode: str = "benchmark", soft_veto: bool = False, start: tuple | None = None, rounds: int = 200) -> Found:
    """The fitted weights, as a point in the order of ``FITTED``.

    ``rows``: topic_id, doc_id, grade and the columns that `eligibility.trial_score` reads.
    """
    start = start or tuple(X.SCORE_WEIGHTS[name] for name in FITTED)
    kept = cut(rows)

    def values(points: Points) -> list[float]:
        return ndcg(kept, [E.trial_score(mode, soft_veto, weights_of(p)) for p in points])

    return simplex(values, start, rounds)


def shares(found: Found) -> dict[str, float]:
    """The weights that were found, by name."""
    return {k: v for k, v in weights_of(found.point).items() if k in FITTED}
