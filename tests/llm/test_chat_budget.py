"""Windows of a conversation keep the budget."""

import duckdb
from quillmatch.llm import oracle
from quillmatch.llm.chat import digests, format_windows

TURNS = [
    (1, [("system", 6)] + [("user" if i % 2 else "assistant", 7 + i * 5 % 40) for i in range(60)]),
    (2, [("user", 90), ("assistant", 30), ("user", 10), ("assistant", 300), ("user", 10)]),
    (3, [("system", 40), ("user", 70), ("assistant", 20), ("assistant", 100), ("user", 5)]),
    (4, [("system", 130), ("user", 50), ("assistant", 200), ("user", 20)]),
    (5, [("user", 50), ("assistant", 50)]),
]


def cost(piece):
    return len(piece.split("\n", 1)[1].strip(" ").split()) + 4


def test_windows_keep_the_budget(spark):
    rows = [(c, i, role, f"c{c}t{i} " + "w " * (n - 5)) for c, turns in TURNS for i, (role, n) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = sorted(format_windows(df, 100, 30).collect(), key=lambda r: (r.conv_id, r.window))
    seen = {}
    for r in windows:
        pieces = r.formatted.split("<|im_end|>\n")[:-1]
        assert len(pieces) == r.n_repeated + r.n_turns
        own, repeated = [cost(p) for p in pieces[r.n_repeated :]], [p for p in pieces[: r.n_repeated] if "|>system" not in p]
        assert sum(map(cost, pieces)) <= 100 or (len(own) == 1 and own[0] > 100 and not repeated)
        assert sum(map(cost, repeated)) <= 30
        seen.setdefault(r.conv_id, []).extend(own)
    assert seen == {c: [n for _, n in turns] for c, turns in TURNS}
    assert [r.n_turns for r in windows if r.conv_id == 2] == [1, 2, 1, 1]
    assert [r.n_turns for r in windows if r.conv_id == 5] == [2]
    assert any(r.n_repeated > 1 for r in windows if r.conv_id == 1)
    targets = sum(r.loss_chars for r in digests(format_windows(df, 100, 30)).collect())
    assert targets == sum(len(t) for _, _, role, t in rows if role == "assistant")


def test_system_turn_wherever_it_stands(spark):
    turns = [("user", 30), ("system", 20), ("assistant", 40), ("user", 30), ("assistant", 30), ("system", 10), ("user", 60)]
    rows = [(1, i, role, f"t{i} " + "w " * (n - 5)) for i, (role, n) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = sorted(format_windows(df, 100, 30).collect(), key=lambda r: r.window)
    assert [r.n_turns for r in windows] == [3, 3, 1]  # 30+20+40; 20+30+30+10; 20+10+60
    assert all(r.formatted.startswith("<|im_start|>system\nt1 ") for r in windows[1:])
    assert all(r.formatted.count("\nt1 ") == 1 for r in windows)


def test_sql_at_budgets_that_split(spark):
    """The contract's SQL against the query's form, where conversations take several windows."""
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(10**6 + c, i, role, f"c{c}t{i} " + "w " * (n - 5)) for c, turns in TURNS for i, (role, n) in enumerate(turns)]
    df = df.unionByName(spark.createDataFrame(odd + [(7, None, None, None)], df.schema))
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], df.schema)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    for budget, history in ((100, 30), (60, 0), (1024, 256)):
        got = sorted(tuple(r) for r in digests(format_windows(df.unionByName(probe), budget, history)).collect())
        want = sorted(con.execute(oracle.chat(budget, history)).fetchall())
        assert got == want
