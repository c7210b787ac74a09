"""Near dedup of rows that share an id."""

from quillmatch.llm.minhash import one_of_each


def say(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(7, say(f"hot{k}x")) for k in range(30)]  # one id, unlike texts
    rows += [(7, None), (7, "too short")]
    rows += [(1, say("a")), (2, say("a")), (2, say("b"))]  # A has a copy elsewhere, B is alone
    rows += [(3, say("c")), (3, say("c")), (3, say("c") + " end")]  # like texts of one id
    rows += [(4, say("d")), (5, say("d")), (None, say("d"))]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, mark long")
    out = one_of_each(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(x for x in got if x[0] == 7 and x[1]) == sorted(r for r in rows if r[0] == 7 and r[1])
    assert (7, None) in got
    texts = [t for i, t in got if i is not None and i != 7]
    assert texts.count(say("a")) == 1 and texts.count(say("b")) == 1
    assert sum(t.startswith("c0 ") for t in texts) == 1
    assert (4, say("d")) in got and (None, say("d")) in got
    assert len(got) == 32 + 2 + 1 + 2


def test_clashing_columns(spark):
    from quillmatch.llm.decontaminate import uncontaminated

    rows = [(1, say("a")), (2, say("a")), (2, say("b")), (3, say("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as own", "1 as nth", "2 as mixed", "3 as uid", "4 as again", "5 as k")
    out = one_of_each(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == sorted({t for _, t in rows})
    items = spark.createDataFrame([(9, say("c"))], "item_id long, text string")
    left = uncontaminated(df, items)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {1, 2}
