"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on a document.  Heuristics
that look at one kind of junk from different sides form a family; some belong
to none, since what they see (few words, open line ends) is often harmless.
The patterns of votes of all different texts are counted, and expectation
maximisation over these counts estimates each heuristic's accuracy on good
documents and on each kind of bad ones, and the share of all kinds (no labels
are read).  It starts neutral: a kind's weight is the share of its family that
votes bad.  What votes say together decides, so that a lone bad vote that its
family doesn't share is overruled, and a family's agreement outweighs the many
good votes of heuristics that look at something else.  The posterior of good is
the soft target of a logistic scorer over hashed features, fitted on a bounded
sample of different texts, which scores every document.

Defined cases: null or blank text has no words and is rejected; an empty table
gives no rows; repeated rows are scored each and count once in the fit; very
long texts take part whole (their features are bounded by the slots); ties of
equal sample hashes go by the text; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import cut, documents, in_pieces, mix, word_hashes

SLOTS = 1 << 16
#: Votes that the priors of an accuracy are worth.
WEIGHT = 10.0
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: Every byte's class: X capital, x other letter, 9 digit, itself otherwise.
_CLASSES = bytes(
    88 if i in _UPPER else 120 if i in _LETTERS else 57 if 48 <= i < 58 else i for i in range(256)
)

#: name, family (None: no kind of junk of its own), bad from, good up to; between the bounds it abstains.
LABELLERS = (
    ("symbols", "symbols", 0.10, 0.02),
    ("symbol_words", "symbols", 0.06, 0.01),
    ("shouts", "shouting", 0.20, 0.02),
    ("shouting_words", "shouting", 0.10, 0.02),
    ("capitals", "capitals", 0.40, 0.12),
    ("capital_words", "capitals", 0.25, 0.10),
    ("repeated_lines", "repeats", 0.40, 0.05),
    ("top_line", "repeats", 0.25, 0.15),
    ("repeated_words", "monotony", 0.60, 0.45),
    ("top_word", "monotony", 0.20, 0.10),
    ("open_lines", None, 0.90, 0.50),
    ("few_words", None, 0.90, 0.50),
)
FAMILIES = [x[1] for x in LABELLERS]
_SYMBOL_WORD = re.compile(r"\S*[#*$%&|<>]\S*")


def measure(texts: list) -> np.ndarray:
    """One row of measures per text, in the order of LABELLERS: shares of words, letters or lines."""
    out = np.zeros((len(texts), len(LABELLERS)))
    for i, text in enumerate(texts):
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            out[i, -2:] = 1
            continue
        raw = text.encode("utf-8", "surrogatepass")
        lines = [x for x in text.split("\n") if x.strip()]
        often, line = Counter(words), Counter(lines).most_common(1)[0][1]
        letters = len(raw) - len(raw.translate(None, _LETTERS))
        symbols = sum(map(text.count, "#*$%&|<>"))
        out[i] = (
            symbols / n,
            len(_SYMBOL_WORD.findall(text)) / n if symbols else 0.0,
            text.count("!") / n,
            sum(x.endswith("!") for x in words) / n if "!" in text else 0.0,
            (len(raw) - len(raw.translate(None, _UPPER))) / max(letters, 1),
            sum(len(x) > 1 and x.isupper() for x in words) / n,
            1 - len(set(lines)) / len(lines),
            line / len(lines) if line > 1 else 0.0,
            1 - len(often) / n,
            often.most_common(1)[0][1] / n if n >= 10 else 0.0,
            sum(not x.rstrip().endswith((".", "!", "?", ":", "。")) for x in lines) / len(lines),
            1.0 if n < 20 else 0.0,
        )
    return out


def votes(texts: list) -> np.ndarray:
    """1 good, 0 bad, -1 abstains: one column per labeller."""
    m = measure(texts)
    bad = np.array([x[2] for x in LABELLERS])
    good = np.array([x[3] for x in LABELLERS])
    return np.where(m >= bad, 0, np.where(m <= good, 1, -1))


def mixture(
    v: np.ndarray, n: np.ndarray | None = None, families: list | None = None, rounds: int = 500
) -> tuple[np.ndarray, np.ndarray]:
    """(shares, P(votes bad | class)) by EM over vote patterns ``v`` seen ``n`` times: good first, then a class per family.

    Kinds of junk exclude each other: a bad document gets good votes from most
    labellers, so one bad class for all would break the independence that EM
    rests on.  ``families`` names each labeller's family or None; without it all
    are one family.  Starts from the share of each family's votes that are bad;
    Beta priors weigh ten votes a class.
    """
    n = np.ones(len(v)) if n is None else np.asarray(n, float)
    m, total = v.shape[1], n.sum()
    families = ["bad"] * m if families is None else families
    kinds = sorted({f for f in families if f is not None})
    member = np.array([[f == k for f in families] for k in kinds])
    said_good, said_bad, voted = v == 1, v == 0, v >= 0
    share = (said_bad @ member.T) / np.maximum(voted @ member.T, 1)
    r = np.hstack([1 - share.max(axis=1, keepdims=True) + 0.01, share + 0.01 / len(kinds)])
    r /= r.sum(axis=1, keepdims=True)
    expected = np.vstack([np.full(m, 0.05), np.where(member, 0.7, 0.1)])
    for _ in range(rounds):
        w = r * n[:, None]
        shares = (w.sum(axis=0) + 1) / (total + len(kinds) + 1)
        bad = (w.T @ said_bad + WEIGHT * expected) / (w.T @ voted + WEIGHT)
        new = _responsibilities(said_good, said_bad, shares, bad)
        if np.abs(new - r).max(initial=0.0) < 1e-6:
            break
        r = new
    return shares, bad


def _responsibilities(said_good, said_bad, shares, bad):
    z = np.log(shares) + said_bad @ np.log(bad).T + said_good @ np.log1p(-bad).T
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def estimate(v: np.ndarray, n: np.ndarray | None = None, families: list | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of good, P(votes good | good), P(votes bad | bad)) from `mixture`."""
    shares, bad = mixture(v, n, families)
    return shares[0], 1 - bad[0], shares[1:] @ bad[1:] / shares[1:].sum()


def posterior(v: np.ndarray, shares: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """P(good) of each row of votes."""
    return _responsibilities(v == 1, v == 0, shares, bad)[:, 0]


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, value, offsets): hashed word shapes by the root of their share, and
    each measure's tenth as a feature of its own."""
    shapes = [None if t is None else t.encode("utf-8", "surrogatepass").translate(_CLASSES) for t in texts]
    hashes, at = word_hashes(shapes, lower=False)
    slot = (mix(hashes) % np.uint64(SLOTS)).astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * SLOTS + slot, return_counts=True)
    total = np.maximum(np.diff(at), 1)
    tenth = np.minimum(measure(texts) * 10, 20).astype(np.uint64)
    bins = (mix(tenth + np.arange(1, len(LABELLERS) + 1, dtype=np.uint64) * np.uint64(1 << 20)) % np.uint64(SLOTS)).astype(np.int64)
    doc = np.r_[key // SLOTS, np.repeat(np.arange(len(texts)), len(LABELLERS))]
    slot = np.r_[key % SLOTS, bins.ravel()]
    value = np.r_[np.sqrt(count / total[key // SLOTS]), np.ones(bins.size)]
    order = np.argsort(doc, kind="stable")
    return slot[order], value[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))


def fit(slot, value, at, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5):
    """(weights, bias) of a logistic scorer on soft targets, by Adagrad on all rows."""
    w, b = np.zeros(SLOTS), 0.0
    gw, gb = np.full(SLOTS, 1e-8), 1e-8
    doc = np.repeat(np.arange(len(target)), np.diff(at))
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(_sums(w, slot, value, at) + b, -35, 35))) - target
        error /= len(target)
        grad, grad_b = np.bincount(slot, weights=error[doc] * value, minlength=SLOTS) + decay * w, error.sum()
        gw, gb = gw + grad**2, gb + grad_b**2
        w, b = w - rate * grad / np.sqrt(gw), b - rate * grad_b / np.sqrt(gb)
    return w, b


def _sums(weights, slot, value, at):
    run = np.r_[0.0, np.cumsum(weights[slot] * value)]
    return run[at[1:]] - run[at[:-1]]


def _voter(batches):
    """The hash of each text, its place in the sample's order, and its vote pattern in base three."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        code = (votes(texts) + 1) @ (3 ** np.arange(len(LABELLERS)))
        said = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        columns = [pa.array(np.array(said, np.uint64).view(np.int64)), batch.column(1), pa.array(code, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "place", "pattern"])


def _featurer(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        slot, value, at = features(texts)
        code = (votes(texts) + 1) @ (3 ** np.arange(len(LABELLERS)))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (slot.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([*lists, pa.array(code, pa.int32())], names=["slot", "value", "pattern"])


def decode(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def sampled(texts: DataFrame, seen: DataFrame, fit_rows: int) -> DataFrame:
    """The ``fit_rows`` different texts with the smallest 64-bit hashes; ``seen`` has each text's ``place`` once.

    The hash that closes the sample is found among narrow rows first (each task keeps its own smallest), so that
    only the sample's texts move, whatever the table's size.
    """
    last = seen.select("place").orderBy("place").limit(fit_rows).agg(F.max("place")).first()[0]
    few = texts.select(F.coalesce("text", F.lit("")).alias("text")).where(_place(F.col("text")) <= F.lit(last))
    return few.distinct().orderBy(_place(F.col("text")), "text").limit(fit_rows)


def _place(text):
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(11))


def train(docs: DataFrame, fit_rows: int = 5_000):
    """(weights, bias, `mixture`), or None without documents.

    The accuracies come from the vote patterns (at most three to the power of the labellers) of all different
    texts; the scorer from ``fit_rows`` of them at most, by the smallest hashes.
    """
    texts = documents(docs).select("text")
    voted = texts.select("text", _place(F.col("text")).alias("place")).mapInArrow(in_pieces(_voter), "h long, place long, pattern int")
    seen = voted.groupBy("h").agg(F.min("place").alias("place"), F.min("pattern").alias("pattern"))
    seen = cut(seen)  # narrow: read for the counts and for the sample's last hash
    counts = seen.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not counts:
        return None
    v, n = decode([r["pattern"] for r in counts]), np.array([r["n"] for r in counts], float)
    em = mixture(v, n, FAMILIES)
    few = sampled(texts, seen, fit_rows)
    rows = few.mapInArrow(in_pieces(_featurer), "slot array<int>, value array<double>, pattern int").collect()
    at = np.cumsum([0, *[len(r["slot"]) for r in rows]])
    slot = np.concatenate([np.zeros(0, np.int64), *[np.array(r["slot"], np.int64) for r in rows]])
    value = np.concatenate([np.zeros(0), *[np.array(r["value"], float) for r in rows]])
    return *fit(slot, value, at, posterior(decode([r["pattern"] for r in rows]), *em)), em


def _scorer(model, cutoff: float):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            slot, value, at = features(texts)
            w, b, _ = model.value
            p = 1 / (1 + np.exp(-np.clip(_sums(w, slot, value, at) + b, -35, 35)))
            said = np.array([bool(t and t.split()) for t in texts], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(said, p, 0.0)), pa.array((p >= cutoff) & said, pa.bool_())],
                names=["doc_id", "quality", "kept"],
            )

    return run


def quality_scores(docs: DataFrame, fit_rows: int = 5_000, cutoff: float = 0.5) -> DataFrame:
    """doc_id, quality (probability of good), kept: one row per document."""
    model = train(docs, fit_rows)
    schema = "doc_id long, quality double, kept boolean"
    if model is None:
        return documents(docs).selectExpr("doc_id", "0.0D as quality", "false as kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bounds its size
    return documents(docs).mapInArrow(in_pieces(_scorer(shared, cutoff)), schema)
