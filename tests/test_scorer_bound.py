"""What a task holds to score documents depends on topics and ``k``, not on the documents it scans."""

import numpy as np
from quillmatch.operators import nearest as N


def test_held_scores_are_bounded(monkeypatch):
    monkeypatch.setattr(N, "HELD_SCORES", 4000)
    lexicon = [{"field": "all", "term": "a", "idf": 1.0, "avgdl": 4.0, "asked": [{"topic_id": t, "qtf": 1} for t in range(5)]}]
    scorer, n, most = N.Scorer(lexicon, ["all"], 3, 0.9, 0.4), 100, 0
    for at in range(0, 20_000, n):
        tf = 1 + (np.arange(at, at + n) % 50)
        scorer.add("all", np.arange(at, at + n), np.arange(n), np.zeros(n, np.int64), tf, 60 - tf)
        f = scorer.fields["all"]
        most = max(most, len(f["best"][0]) + sum(len(t) for t, _, _ in f["new"]))
    scorer.settle(f)
    assert most <= 4000 // 4 + 3 * 5 + 5 * n
    assert f["best"][2].tolist() == [49, 99, 149] * 5
