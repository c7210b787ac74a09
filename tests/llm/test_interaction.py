"""The interaction audit against filters that are really applied, order by order."""

import random
from itertools import permutations

from quillmatch.llm.interaction import interaction_audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    known = [x for x in labels if x[0] is not None]
    good, toxic = {i for i, q, _ in known if q == 1}, {i for i, _, t in known if t == 1}
    failing = []
    for i, text, lang in docs:
        text = text or ""
        words = text.encode().split()
        failed = set()
        if len(words) < 100:
            failed.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            failed.add("C")
        if set(text) & set("#$%&*|"):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            failed.add("E")
        failing.append((lang or "", failed, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failing}:
        rows = [r for r in failing if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(rows)
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(share[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    got = interaction_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got}
    assert len(out) == len(got)
    return out


def test_random_documents(spark):
    rng = random.Random(3)
    base = [
        " ".join(rng.choice(["a", "b%i", "Big", "LOUD", "x#", "w"]) .replace("%i", str(rng.randrange(400))) for _ in range(rng.choice([3, 90, 120, 200])))
        for _ in range(25)
    ]
    base += [" ".join(f"w{k}" for k in range(n)) for n in (99, 100, 101, 400)]
    docs = [(i, rng.choice(base), rng.choice(["en", "de", "", None])) for i in rng.sample(range(10_000), 220)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i, *_ in docs[::2]]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    long = "Wörter und mehr " * 60_000
    docs = [
        (1, None, "en"), (2, "", "de"), (2, "", "fr"), (5, "A B C", "en"), (5, "A B C", "en"), (5, "A B C", "de"), (6, "A B C", None),
        (None, "A B C", "en"), (None, "A B C", "en"), (9, long, "en"), (10, long, "en"), (-3, "ok", "xx"), (7, " \t\n", "en"),
    ]
    labels = [(5, 0, 1), (5, 1, 0), (None, 1, 1), (10, None, 1), (77, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_one_text_and_empty(spark):
    docs = [(i, "same text", "en" if i % 3 else "de") for i in range(600)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], []) == {}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a #", "en")], DOCS).selectExpr("*", "1 as mask", "2 as m", "3 as digest", "'x' as part", "9 as good")
    labels = spark.createDataFrame([(1, 1, 1)], LABELS).selectExpr("*", "1 as text", "2 as part", "3 as n")
    rows = interaction_audit(docs, labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r.part, r.removed, r.good_lost, r.toxic_lost) for r in rows] == [("en", 1, 1, 1)]
