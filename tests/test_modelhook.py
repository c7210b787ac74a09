"""Lenient JSON against a plain scanner, and the model hook with stub callables."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillmatch.functions.lenient import lenient_json, lenient_object
from quillmatch.operators import modelhook as H

FIELDS = [H.Field("decision", choices=("met", "not_met", "NEI")), H.Field("confidence", "double", low=0.0, high=1.0), H.Field("note", required=False)]


def plain(text):
    """The first object of ``text``, repaired, as a parsed value; character by character."""
    if text is None or "{" not in text:
        return None
    out, inside, depth, k = [], False, 0, text.index("{")
    while k < len(text):
        c = text[k]
        if c == "\\":
            after = text[k + 1 : k + 2]
            out.append("\\" + after if after and after in '"\\/bfnrtu' else "\\\\")
            k += 2 if after and after in '"\\/bfnrtu' else 1
            continue
        if c == '"':
            inside = not inside
        elif inside and ord(c) < 32:
            c = f"\\u{ord(c):04x}"
        elif not inside and c in "{}":
            depth += 1 if c == "{" else -1
        out.append(c)
        k += 1
        if depth == 0 and c == "}" and not inside:
            try:
                return json.loads("".join(out), parse_constant=lambda x: 1 / 0)
            except (ValueError, ZeroDivisionError):
                return None
    return None


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("k", lenient_object(F.col("t")).alias("o"), F.to_json(lenient_json(F.col("t"))).alias("j")).collect()
    return [(r.o, None if r.j is None else json.loads(r.j)) for r in sorted(got, key=lambda r: r.k)]


CASES = [
    r'{"evidence_quote": "ECOG \> 1 noted", "decision": "NEI"}',
    '{"question_text": "line one\nline two", "priority": "medium"}',
    '```json\n{"a": {"b": "}{", "c": [1, {"d": null}]}}\n```', 'Sure! 5" tall: {"a": "say \\"hi\\""} and {"b": 2}', '{"a": 1', '{"a": "x}', "no object", "", None,
    '{"a": "\\\\_ \\_ \\\\\\_ tab\there \u0001"}', '{"u": "\\u00e9 \\q"}', "{}", '{"a": 1,}', '{"é": "日本 😀 \\/"}', '{"a": "ends in \\\\"} "', '{"k": "' + "x" * 200_000 + '\n"}',
    '{"deep": ' + '{"d": ' * 60 + "1" + "}" * 61,
]


def test_cases(spark):
    got = read(spark, CASES)
    assert [g[1] for g in got] == [plain(t) for t in CASES]
    assert got[0][1]["evidence_quote"] == r"ECOG \> 1 noted" and got[1][1]["question_text"] == "line one\nline two"
    assert got[11][0] == "{}" and got[2][1] == {"a": {"b": "}{", "c": [1, {"d": None}]}}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from('{}"\\ab:,\n\t\x01 1[]u/'), max_size=25), min_size=40, max_size=40), st.lists(st.dictionaries(st.text(max_size=5), st.text(max_size=12), max_size=3), min_size=5, max_size=5))
def test_random_texts(spark, noise, objects):
    clean = lambda t: t.encode("utf-8", "ignore").decode().replace("\ufdd0", "").replace("\ufdd1", "")
    raw = [clean(json.dumps(o, ensure_ascii=False)) for o in objects]
    texts = noise + ['{"a": "' + n.replace('"', "") + '"} x' for n in noise] + raw
    assert [g[1] for g in read(spark, texts)] == [plain(t) for t in texts]
    assert [g[0] for g in read(spark, raw)] == raw


def stub_in(folder):
    """A callable that answers by the prompt's first word and writes down what it was asked."""
    folder = str(folder)

    def respond(requests):
        import json
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(requests, f)
        out = []
        for r in requests:
            kind = r["prompt"].split()[0]
            again = "was refused" in r["prompt"]
            if kind == "crash":
                raise RuntimeError("model is down")
            if kind == "never" or kind == "second" and not again:
                out.append('{"decision": "perhaps", "confidence": 3}')
            else:
                out.append('Here: {"decision": "met", "confidence": "0.5", "note": "a\nb"}')
        return out

    return respond


def asked_in(folder):
    return [r for name in os.listdir(folder) for r in json.load(open(os.path.join(folder, name)))]


def run(spark, stub, rows, memo, **options):
    df = spark.createDataFrame(rows, "id long, prompt string, system string")
    return {r.id: r for r in H.ask(df, stub, FIELDS, memo, "test", batch=1, tasks=2, **options).collect()}


def test_one_call_per_key_over_two_runs(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    stub, memo = stub_in(calls), str(tmp_path / "memo")
    rows = [(1, "good a", None), (2, "good a", None), (3, "good a", "be brief"), (4, "second b", None), (5, "never c", None), (6, None, None)] + [(k, "good hot", None) for k in range(10, 60)]
    rows[5] = (6, "good", None)
    got = run(spark, stub, rows, memo)
    assert got[1].key == got[2].key != got[3].key and len({got[k].key for k in range(10, 60)}) == 1
    assert (got[1].answer.decision, got[1].answer.confidence, got[1].answer.note, got[1].attempts, got[1].error) == ("met", 0.5, "a\nb", 1, None)
    assert got[4].answer.decision == "met" and got[4].attempts == 2
    assert got[5].answer is None and got[5].attempts == 2
    assert got[5].error == "decision: not one of met, not_met, NEI; confidence: above 1.0"
    asked = asked_in(calls)
    # six keys once, the two that were invalid at first twice
    assert len(asked) == 6 + 2
    again = [r for r in asked if "was refused" in r["prompt"]]
    assert len(again) == 2 and all("not one of" in r["prompt"] and not r["json_mode"] and r["max_tokens"] == 4096 for r in again)
    assert all(r["json_mode"] and r["max_tokens"] == 2048 for r in asked if r not in again)
    assert [r["system"] for r in asked].count("be brief") == 1 and None in [r["system"] for r in asked]
    second = run(spark, stub, rows + [(99, "good new", None)], memo)
    more = [r for r in asked_in(calls) if r not in asked]
    assert [r["prompt"].split()[1] for r in more if r["prompt"].startswith("good")] == ["new"]
    assert len(asked_in(calls)) == len(asked) + 1 + 2  # the new one, and the never valid one twice more
    assert {k: v.answer for k, v in second.items() if k != 99} == {k: v.answer for k, v in got.items()}
    assert H.clear(spark, memo, "test") == 6 and H.clear(spark, memo, "test") == 0
    run(spark, stub, rows[:1], memo)
    assert len(asked_in(calls)) == len(asked) + 4


def test_failures_and_odd_input(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    stub, memo = stub_in(calls), str(tmp_path / "memo")
    got = run(spark, stub, [(1, "crash", None), (2, "good", None)], memo, retries=2)
    assert got[1].answer is None and got[1].error == "RuntimeError: model is down" and got[1].attempts == 3 and got[2].attempts == 1
    assert run(spark, stub, [], memo) == {}
    with pytest.raises(ValueError):
        H.ask(spark.createDataFrame([("a", "b")], "prompt string, answer string"), stub, FIELDS, memo, "test")
    with pytest.raises(ValueError):
        H.saved(spark, memo, "../up")
    assert H.saved(spark, memo, "test").count() == 1 and H.saved(spark, memo, "test", max_age=0).count() == 0


def test_memo_meets_requests_in_an_anti_join(spark, tmp_path):
    calls, memo = tmp_path / "calls", str(tmp_path / "memo")
    calls.mkdir()
    run(spark, stub_in(calls), [(1, "good", None)], memo)
    df = spark.createDataFrame([("k", "p", None)], "key string, prompt string, system string")
    plan = H.unanswered(df, H.saved(spark, memo, "test"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_field_problems(spark):
    texts = ['{"decision": "met", "confidence": 0.2}', '{"decision": null, "confidence": "x"}', "[]", '{"decision": ["met"], "confidence": -1}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", H.problems(lenient_json(F.col("t")), FIELDS).alias("p"))
    got = [r.p for r in sorted(df.collect())]
    assert got[0] is None and got[1] == "decision: missing; confidence: not a double" and got[2] == "no JSON object"
    assert got[3].startswith("decision: not") and got[3].endswith("confidence: below 0.0")
