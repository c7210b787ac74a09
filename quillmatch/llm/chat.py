"""Chat formatting in budgeted windows, with built-in functions only.

A fold over a conversation's turn tokens fills windows greedily: the system
turn, the history and the new turns of a window have at most ``budget`` tokens
together.  Each window that starts after the first system turn, wherever that
stands, repeats it first, followed by the last new turns of the window before, as many as fit ``history`` tokens and leave room for
the window's first new turn; where that turn fits the budget, but not beside
the system turn, the window goes without it.  Only assistant turns that are new
in a window are under its loss mask, so every target counts once.

A turn reads ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.  Inside roles
and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line
break becomes ``\\n``), which `read_back` undoes; no text can hold a mark.

Defined cases: null role or text is empty; turns of equal number are ordered by
role and text; a null ``conv_id`` is a conversation of its own; repeated rows
are turns each; a turn longer than the budget is never cut and is the only new turn
of its window, the one kind that exceeds the budget; an empty table has no
windows; other columns are ignored.  A conversation is held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a line break is an "n" after an odd run of backslashes
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def token_count(text: Column) -> Column:
    """Words, and four for marks and role."""
    return F.size(F.split(F.trim(text), r"\s+")) + 4


def _turn(t: Column, i: Column) -> Column:
    head, body = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")), escape(t["text"])
    return F.struct(
        (i + 1).alias("pos"),
        t["role"].alias("role"),
        head.alias("head"),
        body.alias("body"),
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        token_count(t["text"]).cast("long").alias("tokens"),
    )


def _spans(budget: int, history: int) -> Column:
    """Windows of ``turns`` as (start, stop, system, history): places of the new turns, whether the
    system turn goes first, how many turns before ``start`` are repeated."""
    set_by = F.coalesce("system.tokens", F.lit(0))

    def span(s, stop):
        return F.struct(s["start"], stop.alias("stop"), s["system"], s["history"])

    def opened(s, t):
        said = F.col("system").isNotNull() & (F.col("system.pos") < t["pos"])
        system = said & ((set_by + t["tokens"] <= budget) | ((t["tokens"] > budget) & (set_by <= budget)))
        room = F.least(F.lit(history), budget - t["tokens"] - F.when(system, set_by).otherwise(0))
        # history reaches back to the system turn at most, so that this is not repeated twice
        begin = F.when(said, F.greatest(s["start"], F.col("system.pos") + 1)).otherwise(s["start"])
        # the last turns first, until one does not fit
        recent = F.aggregate(
            F.reverse(F.slice("turns", begin, F.greatest(t["pos"] - begin, F.lit(0)))),
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("open")),
            lambda h, x: F.when(
                h["open"] & (h["used"] + x["tokens"] <= room),
                F.struct((h["n"] + 1).alias("n"), (h["used"] + x["tokens"]).alias("used"), h["open"]),
            ).otherwise(F.struct(h["n"], h["used"], F.lit(False).alias("open"))),
        )
        states = F.transform(
            F.array(recent),
            lambda h: F.struct(
                F.concat(s["done"], F.array(span(s, t["pos"] - 1))).alias("done"),
                t["pos"].alias("start"),
                system.alias("system"),
                h["n"].alias("history"),
                (t["tokens"] + h["used"] + F.when(system, set_by).otherwise(0)).alias("used"),
            ),
        )
        return F.get(states, F.lit(0))

    def step(s, t):
        more = F.struct(s["done"], s["start"], s["system"], s["history"], (s["used"] + t["tokens"]).alias("used"))
        return F.when((t["pos"] == 1) | (s["used"] + t["tokens"] <= budget), more).otherwise(opened(s, t))

    start = F.struct(
        F.array().cast("array<struct<start:int,stop:int,system:boolean,history:int>>").alias("done"),
        F.lit(1).alias("start"),
        F.lit(False).alias("system"),
        F.lit(0).alias("history"),
        F.lit(0).cast("long").alias("used"),
    )
    return F.aggregate("turns", start, step, lambda s: F.concat(s["done"], F.array(span(s, F.size("turns")))))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, window, formatted, n_repeated, n_turns, loss_spans.

    ``n_repeated`` of the window's turns stand in an earlier window already;
    ``n_turns`` are new; ``loss_spans`` are (begin, length) in characters.
    """
    if history >= budget:
        raise ValueError("the history must be shorter than the budget")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # sorted arrays put null turns first, then go by role and text
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select("conv_id", F.transform("turns", _turn).alias("turns"))
    talks = talks.withColumn("system", F.get(F.filter("turns", lambda t: t["role"] == "system"), F.lit(0)))
    talks = talks.withColumn("spans", _spans(budget, history))
    windows = F.transform(
        "spans",
        lambda s: F.struct(
            F.when(s["system"], F.array(F.col("system.piece"))).otherwise(F.array().cast("array<string>")).alias("system"),
            F.slice("turns", s["start"] - s["history"], s["history"]).alias("recent"),
            F.slice("turns", s["start"], s["stop"] - s["start"] + 1).alias("turns"),
        ),
    )
    cells = talks.select("conv_id", F.posexplode(windows).alias("window", "x"))
    cells = cells.select(
        "conv_id", "window", "x.turns", F.concat("x.system", F.transform("x.recent", lambda t: t["piece"])).alias("repeated")
    )
    cells = cells.withColumn("prefix", F.array_join("repeated", ""))
    none = F.array().cast("array<struct<begin:int,length:int>>")
    masked = F.aggregate(
        "turns",
        F.struct(F.length("prefix").alias("at"), none.alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + F.length(t["head"])).alias("begin"), F.length(t["body"]).alias("length"))),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return cells.select(
        "conv_id",
        "window",
        F.concat("prefix", F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.size("repeated").alias("n_repeated"),
        F.size("turns").alias("n_turns"),
        masked.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the new turns), targets: parsed from ``formatted``."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    head = r"(?s)^<\|im_start\|>([^\n]*)\n.*$"
    return windows.select(
        "conv_id",
        "window",
        F.transform(
            F.slice(parts, F.col("n_repeated") + 1, F.col("n_turns")),
            lambda x: F.struct(
                unescape_role(F.regexp_extract(x, head, 1)).alias("role"),
                unescape(F.regexp_replace(x, r"(?s)^<\|im_start\|>[^\n]*\n", "")).alias("text"),
            ),
        ).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int"))),
        ).alias("targets"),
        F.length("formatted").cast("long").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """Counts and digests of what can be read back, one row per conversation."""
    whole = read_back(windows).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias(
            "said"
        ),
        F.array_join("targets", "").alias("learned"),
        "chars",
    )
    grouped = whole.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "learned"))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("all", lambda x: x["said"]), "")
    learned = F.array_join(F.transform("all", lambda x: x["learned"]), "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
