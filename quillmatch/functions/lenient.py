"""Strict JSON out of what a model said, with built-in functions only.

The text from its first ``{`` on is cut at the quotes that open or close a
string, so that every second piece lies in a string.  Pieces in strings get
their stray backslashes and raw control characters escaped; the others are cut
at braces, and a fold over all pieces finds where the first object closes.
Valid JSON passes unchanged.

Defined cases: null, no ``{``, an object or string that never closes: null;
text before and after the object, code fences among it, is left out; the two
noncharacters that mark escapes while this works are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.functions.text import once

#: Stand for an escaped backslash and an escaped quote.
_PAIR, _QUOTE = "\ufdd0", "\ufdd1"
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _in_string(piece: Column) -> Column:
    def controls(p: Column) -> Column:
        out = p
        for code in range(32):
            out = _swap(out, chr(code), _SHORT.get(chr(code), f"\\u{code:04x}"))
        return F.when(p.rlike(r"[\x00-\x1f]"), out).otherwise(p)

    return once(F.regexp_replace(piece, r"\\(?![/bfnrtu])", _PAIR), controls)


def lenient_object(text: Column) -> Column:
    """The first object in ``text`` as strict JSON text, or null."""
    body = F.regexp_extract(F.translate(text, _PAIR + _QUOTE, ""), r"(?s)\{.*", 0)
    marked = _swap(_swap(body, "\\\\", _PAIR), '\\"', _QUOTE)
    pieces = F.flatten(
        F.transform(
            F.split(marked, '"', -1),
            lambda p, i: F.when(i % 2 == 1, F.array(F.concat(F.lit('"'), _in_string(p), F.lit('"')))).otherwise(
                F.regexp_extract_all(p, F.lit("[{}]|[^{}]+"), 0)
            ),
        )
    )

    def closes(tokens: Column) -> Column:
        def step(a: Column, t: Column) -> Column:
            depth = a["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
            end = F.when((a["end"] == 0) & (t == "}") & (depth == 0), a["at"] + 1).otherwise(a["end"])
            return F.struct((a["at"] + 1).alias("at"), depth.alias("depth"), end.alias("end"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))
        end = F.aggregate(tokens, start, step, lambda a: a["end"])
        return F.when(end > 0, F.array_join(F.slice(tokens, F.lit(1), end), ""))

    found = once(pieces, closes)
    return F.when(body != "", _swap(_swap(found, _PAIR, "\\\\"), _QUOTE, '\\"'))


def lenient_json(text: Column) -> Column:
    """The first object in ``text`` as a VARIANT; null where it isn't JSON even then, or a key stands twice."""
    return F.try_parse_json(lenient_object(text))
