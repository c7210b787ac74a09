"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression.

P(grade <= k | x) = sigmoid(threshold_k - w.x) with one weight vector for all
ordered thresholds.  Features are counts of hashed words and word beginnings: severity of a text
is what it says at worst and how often, not the share of it, so counts are
capped and not scaled to the text's length.  Training grades come from the
labels: 0 for a text that isn't toxic; a toxic text is graded 1 to
``GRADES - 1`` by how many occurrences it has of the words that set labelled
toxic texts apart.

The model is fitted on the driver from at most ``fit_rows`` labelled rows, the
ones with the smallest hash of their id; everything is scored by executors.

Defined cases: null or blank text scores as no words; labels that are null are
ignored; without usable labels of both kinds every text gets grade 0; an empty
table gives no rows; repeated rows are scored each and count once in the fit;
very long texts are scored whole, each word's count capped; of equally likely
grades the lower one is given; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import binary_column, documents, in_pieces, mix

SLOTS = 1 << 18
GRADES = 4
#: Count of a word in a text beyond which it counts no more.
CAP = 3.0
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]+")


def _tokens(text) -> list[str]:
    """Words without outer punctuation, and their first four and five characters: endings vary."""
    words = _PUNCTUATION.sub(" ", text).lower().split() if text else []
    return words + ["4" + w[:4] for w in words if len(w) > 4] + ["5" + w[:5] for w in words if len(w) > 5]


def features(texts: list, together: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, capped count, offsets) of each text's hashed tokens."""
    slots, values, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
    for i in range(0, len(texts), together):  # so that no array holds the words of all texts
        tokens = [_tokens(t) for t in texts[i : i + together]]
        n = np.array([len(t) for t in tokens])
        flat = itertools.chain.from_iterable(tokens)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, n.sum())
        slot = (mix(hashes) % np.uint64(SLOTS)).astype(np.int64)
        key, count = np.unique(np.repeat(np.arange(len(n)), n) * SLOTS + slot, return_counts=True)
        slots.append((key % SLOTS).astype(np.int32))
        values.append(np.minimum(count, CAP).astype(np.float32))
        sizes += np.diff(np.searchsorted(key, np.arange(len(n) + 1) * SLOTS)).tolist()
    return np.concatenate(slots), np.concatenate(values), np.cumsum([0, *sizes])


def only(keep: np.ndarray, slot, value, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features whose slot is kept."""
    hit = keep[slot]
    return slot[hit], value[hit].astype(float), np.r_[0, np.cumsum(hit)][at]


def _sums(weights, slot, value, at):
    run = np.r_[0.0, np.cumsum(weights[slot] * value)]
    return run[at[1:]] - run[at[:-1]]


def telling_slots(slot, at, toxic: np.ndarray, share: float = 0.05, sigmas: float = 2.5) -> np.ndarray:
    """Slots whose words are in toxic texts surely more often than in others.

    A word must be in ``share`` of the toxic texts (and six), and its log ratio of
    smoothed document rates must exceed 1 and ``sigmas`` standard errors.
    """
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bad = np.bincount(slot, weights=toxic[doc], minlength=SLOTS)
    good = np.bincount(slot, weights=~toxic[doc], minlength=SLOTS)
    n_bad, n_good = toxic.sum(), (~toxic).sum()
    ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return (bad >= max(6, share * n_bad)) & (ratio > np.maximum(1, sigmas * error))


def grades(slot, value, at, toxic: np.ndarray) -> np.ndarray:
    """0 for texts that aren't toxic, else 1 .. GRADES - 1 by occurrences of telling words."""
    n = _sums(np.ones(SLOTS), *only(telling_slots(slot, at, toxic), slot, value, at))
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        edges = np.quantile(n[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
        out[toxic] = 1 + np.searchsorted(edges, n[toxic], side="left")
    return out


def fit(slot, value, at, grade: np.ndarray, rounds: int = 600, rate: float = 0.5, decay: float = 1e-5):
    """(weights, thresholds) that maximise the penalised likelihood, by Adagrad on all rows."""
    cuts = GRADES - 1
    share = np.clip(np.array([(grade <= k).mean() for k in range(cuts)]), 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(cuts) * 1e-3)
    w = np.zeros(SLOTS)
    doc = np.repeat(np.arange(len(grade)), np.diff(at))
    weight = np.where(grade > 0, max(1.0, 0.25 * (grade == 0).sum() / max(1, (grade > 0).sum())), 1.0)
    weight = weight / weight.sum()
    gw, gt = np.full(SLOTS, 1e-8), np.full(cuts, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    rows = np.arange(len(grade))
    for _ in range(rounds):
        score = _sums(w, slot, value, at)
        upto = np.c_[np.zeros(len(grade)), sigmoid(theta[None, :] - score[:, None]), np.ones(len(grade))]
        high, low = upto[rows, grade + 1], upto[rows, grade]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        d_score = weight * (d_high - d_low) / p  # of -log p
        grad_w = np.bincount(slot, weights=d_score[doc] * value, minlength=SLOTS) + decay * w
        grad_t = np.bincount(np.minimum(grade, cuts - 1), weights=-weight * (d_high / p) * (grade < cuts), minlength=cuts)
        grad_t += np.bincount(np.maximum(grade - 1, 0), weights=weight * (d_low / p) * (grade > 0), minlength=cuts)
        gw += grad_w**2
        gt += grad_t**2
        w -= rate * grad_w / np.sqrt(gw)
        theta = np.maximum.accumulate(theta - rate * grad_t / np.sqrt(gt))
    return w, theta


def predict(w, theta, texts: list) -> np.ndarray:
    """Probabilities of the grades, one row per text."""
    score = _sums(w, *features(texts))
    upto = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -35, 35)))
    return np.diff(np.c_[np.zeros(len(texts)), upto, np.ones(len(texts))], axis=1)


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic): ``fit_rows`` different texts at most, of the ``fit_rows`` labelled ids with the smallest hashes.

    Both bounds are limits of an order, so they hold at any size; an id labelled twice is toxic if any label says so.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    known = known.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = documents(docs).join(F.broadcast(known), "doc_id")  # at most ``fit_rows`` ids
    # copies are no further evidence
    texts = rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))
    return texts.orderBy(F.xxhash64("text"), "text").limit(fit_rows)


def _featurer(batches):
    for batch in batches:
        slot, value, at = features(batch.column(0).to_pylist())
        cut_up = [binary_column([x[a:b] for a, b in zip(at, at[1:])]) for x in (slot, value)]
        yield pa.RecordBatch.from_arrays([*cut_up, batch.column(1)], names=["slot", "value", "toxic"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000):
    """(weights, thresholds) or None, from at most ``fit_rows`` labelled documents, whose features come to the driver."""
    few = labelled(docs, labels, fit_rows)
    rows = few.mapInArrow(in_pieces(_featurer), "slot binary, value binary, toxic boolean").collect()
    toxic = np.array([r["toxic"] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    at = np.cumsum([0, *[len(r["slot"]) // 4 for r in rows]])
    slot = np.frombuffer(b"".join([r["slot"] for r in rows]), np.int32)
    value = np.frombuffer(b"".join([r["value"] for r in rows]), np.float32)
    grade = grades(slot, value, at, toxic)
    return fit(*only(telling_slots(slot, at, toxic), slot, value, at), grade)


def _scorer(model, cutoff: float):
    def run(batches):
        for batch in batches:
            if model is None:
                p = np.tile([1.0] + [0.0] * (GRADES - 1), (batch.num_rows, 1))
            else:
                p = predict(model.value[0], model.value[1], batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(p @ np.arange(GRADES)),
                    pa.array(p.argmax(axis=1), pa.int32()),
                    pa.array(1 - p[:, 0] >= cutoff, pa.bool_()),
                ],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    return run


def severity(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000, cutoff: float = 0.25) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), toxic: one row per document.

    ``toxic``: a grade above 0 has a probability of ``cutoff`` or more.
    """
    model = train(docs, labels, fit_rows)
    if model is not None:  # SLOTS and GRADES bound its size
        model = docs.sparkSession.sparkContext.broadcast(model)
    return documents(docs).mapInArrow(
        in_pieces(_scorer(model, cutoff)), "doc_id long, severity double, grade int, toxic boolean"
    )
