"""A batch hook for model calls: typed answers from any callable, behind a memo table.

Requests are keyed by a digest of everything that may change their answer.
Keys that the memo holds are left out by an anti-join, equal requests are asked
once, and what comes back is read leniently and checked field by field.  Only
invalid answers are asked again, with what was wrong.  Every round of calls is
appended to the memo before it is read, so no call is repeated by a later
action on the result, and a run that dies resumes with what it has saved.

Defined cases: a null prompt is empty; an answer that stays invalid is null
with its last ``error`` and isn't remembered as an answer, so the next run asks
again; an exception of the callable makes its whole batch invalid; repeated
requests all get the one answer; empty requests call nothing; columns named
like the result's are refused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import fixed as X
from quillmatch.functions.lenient import lenient_json
from quillmatch.sources import folders

#: Prompt and system are kept of invalid answers only, for the next try.
LOG = (
    "key string, run string, attempt int, ok boolean, text string, answer string, error string,"
    " prompt string, system string, at timestamp"
)
_SAID = "key string, prompt string, system string, text string, failed string"
_RESULT = ("key", "answer", "attempts", "error")


class Field(NamedTuple):
    """One field of an answer: its SQL type and what values it may take."""

    name: str
    kind: str = "string"
    required: bool = True
    choices: tuple = ()
    low: float | None = None
    high: float | None = None

    def value(self, v: Column) -> Column:
        return F.try_variant_get(v, f"$.{self.name}", self.kind)

    def problem(self, v: Column) -> Column:
        """What is wrong with this field of the VARIANT ``v``, or null."""
        there = F.try_variant_get(v, f"$.{self.name}", "string").isNotNull()
        value = self.value(v)
        bad = F.when(there & value.isNull(), F.lit(f"{self.name}: not a {self.kind}"))
        if self.required:
            bad = F.when(~there, F.lit(f"{self.name}: missing")).otherwise(bad)
        if self.choices:
            told = f"{self.name}: not one of {', '.join(map(str, self.choices))}"
            bad = F.coalesce(bad, F.when(~value.isin(*self.choices), F.lit(told)))
        if self.low is not None:
            bad = F.coalesce(bad, F.when(value < self.low, F.lit(f"{self.name}: below {self.low}")))
        if self.high is not None:
            bad = F.coalesce(bad, F.when(value > self.high, F.lit(f"{self.name}: above {self.high}")))
        return bad


def problems(v: Column, fields: list[Field]) -> Column:
    """All that is wrong with ``v``, joined by ``; ``, or null."""
    found = F.concat_ws("; ", *[f.problem(v) for f in fields])
    return F.when(v.isNull(), F.lit("no JSON object")).when(found != "", found)


def request_key(namespace: str, parts: list[Column], settings: str) -> Column:
    """SHA-256 of the namespace, the settings and the parts as one JSON list of strings and nulls."""
    listed = F.array(F.lit(namespace), F.lit(settings), *[p.cast("string") for p in parts])
    return F.sha2(F.to_json(listed), 256)


def _folder(memo: str, namespace: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", namespace):
        raise ValueError("a namespace is made of letters, digits, _ and -")
    return f"{memo}/{namespace}"


def saved(spark: SparkSession, memo: str, namespace: str, max_age: int | None = None) -> DataFrame:
    """key, answer (JSON), attempt: the first valid answer of each key, not older than ``max_age`` seconds."""
    folder = _folder(memo, namespace)
    if not folders.exists(spark, folder):
        return spark.createDataFrame([], "key string, answer string, attempt int")
    rows = spark.read.schema(LOG).parquet(folder).where("ok")
    if max_age is not None:
        rows = rows.where(F.col("at") >= F.current_timestamp() - F.make_interval(secs=F.lit(max_age)))
    first = rows.groupBy("key").agg(F.min_by(F.struct("answer", "attempt"), F.struct("at", "run")).alias("a"))
    return first.select("key", "a.answer", "a.attempt")


def clear(spark: SparkSession, memo: str, namespace: str) -> int:
    """Forget a namespace; how many answers it held."""
    n = saved(spark, memo, namespace).count()
    folders.remove(spark, _folder(memo, namespace))
    return n


def attempt_request(attempt: int, max_tokens: int, reasoning: bool) -> dict:
    """JSON mode only for the first attempt of a model that doesn't reason; later attempts get more tokens."""
    if attempt == 0:
        return {"json_mode": not reasoning, "max_tokens": max_tokens}
    return {"json_mode": False, "max_tokens": max(2 * max_tokens, max_tokens + 512)}


def attempt_prompt(prompt: Column, error: Column) -> Column:
    told = F.concat(F.lit(X.RETRY_OPENING), error, F.lit(X.RETRY_CLOSING))
    return F.concat(prompt, F.lit(X.JSON_INSTRUCTION), F.coalesce(told, F.lit("")))


def unanswered(requests: DataFrame, known: DataFrame) -> DataFrame:
    """One request of each key that the memo doesn't hold: key, prompt, system, error."""
    one = requests.select("key", "prompt", "system").dropDuplicates(["key"])
    return one.join(known.select("key"), "key", "left_anti").withColumn("error", F.lit(None).cast("string"))


def _caller(respond: Callable[[list[dict]], list[str]], shape: dict, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                systems = part["system"].astype(object).where(part["system"].notna(), None)
                asked = [{"prompt": p, "system": s, **shape} for p, s in zip(part["asked"], systems)]
                try:
                    said, failed = list(respond(asked)), None
                    if len(said) != len(asked):
                        said, failed = [None] * len(asked), f"{len(said)} answers to {len(asked)} requests"
                except Exception as e:  # a model's failure is an invalid answer, to be asked again
                    said, failed = [None] * len(asked), f"{type(e).__name__}: {e}"
                out = part[["key", "prompt", "system"]].copy()
                yield out.assign(text=pd.Series(said, out.index, dtype=object), failed=failed)

    return run


def ask(
    requests: DataFrame,
    respond: Callable[[list[dict]], list[str]],
    fields: list[Field],
    memo: str,
    namespace: str,
    model: str = "",
    retries: int = 1,
    max_tokens: int = 2048,
    reasoning: bool = False,
    max_age: int | None = None,
    batch: int = 32,
    tasks: int | None = None,
) -> DataFrame:
    """``requests`` (prompt, and system if it has one) with key, answer, attempts and error.

    ``respond`` takes a list of requests (prompt, system, max_tokens, json_mode) and returns as many texts; it runs in
    ``tasks`` tasks, ``batch`` requests a call.
    """
    clash = [c for c in _RESULT if c in requests.columns]
    if clash:
        raise ValueError(f"requests have columns of the result: {clash}")
    spark, folder, run = requests.sparkSession, _folder(memo, namespace), uuid.uuid4().hex
    system = F.col("system").cast("string") if "system" in requests.columns else F.lit(None).cast("string")
    prompt = F.coalesce(F.col("prompt").cast("string"), F.lit(""))
    settings = f"{model}|{retries}|{max_tokens}|{reasoning}|{fields}"
    keyed = requests.withColumn("key", request_key(namespace, [prompt, system], settings))
    known = saved(spark, memo, namespace, max_age)
    todo = unanswered(keyed.select("key", prompt.alias("prompt"), system.alias("system")), known)
    for attempt in range(retries + 1):
        asked = todo.select("key", "prompt", "system", attempt_prompt(F.col("prompt"), F.col("error")).alias("asked"))
        asked = asked.repartition(tasks or spark.sparkContext.defaultParallelism, "key")
        shape = attempt_request(attempt, max_tokens, reasoning)
        said = asked.mapInPandas(_caller(respond, shape, batch), _SAID)
        read = said.withColumn("v", lenient_json(F.col("text")))
        wrong = F.coalesce("failed", problems(F.col("v"), fields))
        read.select(
            "key",
            F.lit(run).alias("run"),
            F.lit(attempt + 1).alias("attempt"),
            wrong.isNull().alias("ok"),
            "text",
            F.when(wrong.isNull(), F.to_json("v")).alias("answer"),
            wrong.alias("error"),
            F.when(wrong.isNotNull(), F.col("prompt")).alias("prompt"),
            F.when(wrong.isNotNull(), F.col("system")).alias("system"),
            F.current_timestamp().alias("at"),
        ).write.mode("append").parquet(folder)
        mine = spark.read.schema(LOG).parquet(folder).where((F.col("run") == run) & ~F.col("ok"))
        todo = mine.where(F.col("attempt") == attempt + 1).select("key", "prompt", "system", "error")
        if todo.isEmpty():
            break
    got = saved(spark, memo, namespace, max_age).withColumn("v", F.try_parse_json("answer"))
    typed = F.struct(*[f.value(F.col("v")).alias(f.name) for f in fields])
    got = got.select("key", typed.alias("answer"), F.col("attempt").alias("attempts"))
    lost = mine.groupBy("key").agg(F.max("attempt").alias("tried"), F.max_by("error", "attempt").alias("error"))
    # a key that was asked in vain now may have been answered by another run meanwhile
    return (
        keyed.join(got, "key", "left")
        .join(lost, "key", "left")
        .select(
            *requests.columns,
            "key",
            "answer",
            F.coalesce("attempts", "tried").alias("attempts"),
            F.when(F.col("answer").isNull(), F.col("error")).alias("error"),
        )
    )
