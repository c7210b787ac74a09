"""Profiles out of what a model said about a patient: typed, with bad list items dropped one by one.

The answer is a VARIANT, so every field is read at its own type.  An item of a
list that is no object (no text, in a list of texts), lacks a required field
or has one of a wrong type goes alone; the other items stay.  A wrong type or range at the top makes the whole answer
invalid, and the profile holds the topic and its text only.

Values convert as in a lax schema: numbers may come as numeric text, whole
numbers as fractions without remainder, truth values as usual words, dates as
ISO text; text fields take text only.

Defined cases: no JSON, null lists and unknown fields; null or missing lists
are empty; a sex other than male and female, whatever its case, is unknown.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.functions.text import once


class Typed(NamedTuple):
    name: str
    kind: str
    required: bool = False


def _of(kind: str, *names: str) -> list[Typed]:
    return [Typed(n, kind) for n in names]


#: The items of each list, and the pregnancy object.
ITEMS = {
    "biomarkers": [Typed("name", "string", True), Typed("status", "string", True), *_of("string", "value", "method")],
    "prior_treatments": [
        Typed("name", "string", True), *_of("string", "category"), Typed("line", "int"), *_of("string", "response"),
        *_of("date", "ended_on"), Typed("ongoing", "boolean", True),
    ],
    "comorbidities": [Typed("name", "string", True), Typed("active", "boolean"), Typed("onset", "date"), Typed("note", "string")],
    "labs": [Typed("name", "string", True), Typed("value", "double"), Typed("units", "string"), Typed("measured_on", "date"), Typed("note", "string")],
}
PREGNANCY = [*_of("boolean", "pregnant", "breastfeeding", "childbearing_potential"), Typed("contraception", "string")]
TOP = [
    Typed("age_years", "double"), *_of("string", "primary_diagnosis", "primary_diagnosis_stage"), *_of("int", "ecog", "karnofsky"),
    *_of("string", "location", "free_text_residual"),
]
RANGES = {"ecog": (0, 5), "karnofsky": (0, 100)}

_TRUE, _FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
_NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column, name: str) -> Column:
    """The type of a field: ``VOID`` for JSON null, null if it is missing."""
    return F.schema_of_variant(_part(v, name))


def _read(v: Column, name: str) -> Column:
    """A field's type, its text and its number, each looked up once."""
    part = lambda p: F.struct(
        F.schema_of_variant(p).alias("kind"),
        F.try_variant_get(p, "$", "string").alias("text"),
        F.try_variant_get(p, "$", "double").alias("number"),
        F.try_variant_get(p, "$", "boolean").alias("truth"),
    )
    return once(_part(v, name), part)


def _value(x: Column, kind: str) -> Column:
    """What `_read` found, at the wanted type; null where it is missing, null or of another type."""
    text, is_text, is_flag = x["text"], x["kind"] == "STRING", x["kind"] == "BOOLEAN"
    number = F.when(is_flag, x["truth"].cast("double")).when(x["kind"].rlike(_NUMERIC) | is_text, x["number"])
    if kind == "string":
        return F.when(is_text, text)
    if kind == "double":
        return F.when(~F.isnan(number), number)
    if kind == "int":
        return F.when(number == F.floor(number), number.cast("int"))
    if kind == "boolean":
        word = F.lower(text)
        truth = F.when(word.isin(*_TRUE), True).when(word.isin(*_FALSE), False)
        plain = F.when(is_flag, x["truth"]).when(is_text, truth)
        return F.coalesce(plain, F.when(number == 1, True).when(number == 0, False))
    return F.when(is_text & text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _checked(v: Column, field: Typed) -> Column:
    """struct(ok, value) of one field of the object ``v``."""

    def judge(x: Column) -> Column:
        def verdict(value: Column) -> Column:
            given, missing = value.isNotNull(), x["kind"].isNull()
            # a flag that must be one if it is there has a default
            absent = missing if field.kind == "boolean" and field.required else missing | (x["kind"] == "VOID")
            fine = given if field.required and field.kind != "boolean" else given | absent
            if field.required and field.kind == "boolean":
                value = F.coalesce(value, F.lit(False))
            return F.struct(F.coalesce(fine, F.lit(False)).alias("ok"), value.alias("value"))

        return once(_value(x, field.kind), verdict)

    return once(_read(v, field.name), judge)


def checked(v: Column, fields: list[Typed]) -> Column:
    """struct(ok, value) of an object: whether every field is usable, and all of them at their types."""

    def together(x: Column) -> Column:
        ok = F.schema_of_variant(v).startswith("OBJECT")
        for f in fields:
            ok = ok & x[f.name]["ok"]
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.struct(*[x[f.name]["value"].alias(f.name) for f in fields]).alias("value"))

    return once(F.struct(*[_checked(v, f).alias(f.name) for f in fields]), together)


def _list(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def items(v: Column, name: str) -> Column:
    """The valid items of the list ``name``, typed."""
    judged = F.transform(_list(v, name), lambda x: checked(x, ITEMS[name]))
    return F.transform(F.filter(judged, lambda x: x["ok"]), lambda x: x["value"])


def _usable(v: Column, top: Column, pregnancy: Column) -> Column:
    """Whether the answer as a whole can be used: an object whose fields have usable types and ranges."""
    fine = top["ok"]
    for name, (low, high) in RANGES.items():
        n = top["value"][name]
        fine = fine & (n.isNull() | n.between(low, high))
    for name in (*ITEMS, "secondary_diagnoses"):
        kind = _kind(v, name)
        fine = fine & F.coalesce((kind == "VOID") | kind.startswith("ARRAY"), F.lit(True))
    sex, told = _kind(v, "sex"), _kind(v, "pregnancy")
    fine = fine & F.coalesce(sex.isin("VOID", "STRING"), F.lit(True)) & (F.coalesce(told == "VOID", F.lit(True)) | pregnancy["ok"])
    return F.coalesce(fine, F.lit(False))


def profile(v: Column, topic_id: Column, raw_text: Column) -> Column:
    """The profile of a model's answer ``v`` (VARIANT) on ``raw_text``: a struct, ``extracted`` tells whether it was usable."""

    def read(v: Column) -> Column:
        texts = F.filter(_list(v, "secondary_diagnoses"), lambda x: F.schema_of_variant(x) == "STRING")
        return F.struct(
            v.alias("v"),
            checked(v, TOP).alias("top"),
            checked(_part(v, "pregnancy"), PREGNANCY).alias("pregnancy"),
            F.lower(F.try_variant_get(v, "$.sex", "string")).alias("sex"),
            F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")).alias("secondary_diagnoses"),
            *[items(v, name).alias(name) for name in ITEMS],
        )

    def assembled(x: Column) -> Column:
        def kept(ok: Column) -> Column:
            told = F.coalesce(_kind(x["v"], "pregnancy") != "OBJECT<>", F.lit(False)) & x["pregnancy"]["ok"]
            only = lambda name: F.filter(x[name], lambda _: ok).alias(name)
            return F.struct(
                topic_id.alias("topic_id"),
                raw_text.alias("raw_text"),
                ok.alias("extracted"),
                F.coalesce(F.when(ok & x["sex"].isin("male", "female"), x["sex"]), F.lit("unknown")).alias("sex"),
                *[F.when(ok, x["top"]["value"][f.name]).alias(f.name) for f in TOP],
                only("secondary_diagnoses"),
                *map(only, ITEMS),
                F.when(ok & told, x["pregnancy"]["value"]).alias("pregnancy"),
            )

        return once(_usable(x["v"], x["top"], x["pregnancy"]), kept)

    return once(once(v, read), assembled)
