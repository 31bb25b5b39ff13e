"""Whether a parsed answer is a record of the schema: every field at any depth, with the first faults by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.record_schema import CHOICES, DEFAULTS, NULLABLE_LISTS, RECORD, REQUIRED, kind_of

# Texts that stand for truth values, and numbers as text.
TRUTHS = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")
NUMBER = r"(?U)^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
WHOLE = r"(?U)^\s*[-+]?\d+(\.0*)?\s*$"
REASONS = {
    "text": "not a text", "money": "not a number", "number": "not a number", "int": "not a whole number", "bool": "not true or false", "list": "not a list", "object": "not an object",
} | {f"choice:{p}": "not one of " + ", ".join(c) for p, c in CHOICES.items()}
FIRST = 5


def _ask(path: str | Column, kind: str, optional: bool, required: Column, v: Column) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(path.alias("path"), F.lit(kind).alias("kind"), F.lit(optional).alias("optional"), required.alias("required"), v.alias("v"))


def _asked(v: Column, kind: T.StructType, path: str | Column, pattern: str) -> Column:
    """array<struct<path, kind, optional, required, v>>: what is to be looked at inside an object, in the order of the schema."""
    parts = []
    for f in kind.fields:
        below = f"{pattern}.{f.name}" if pattern else f.name
        at = (f"{path}.{f.name}" if path else f.name) if isinstance(path, str) else F.concat(path, F.lit(f".{f.name}"))
        x, name = F.try_variant_get(v, f"$.{f.name}", "variant"), kind_of(f.dataType)
        # Fields with a default, lists and objects may be absent, but not null.
        optional = below in NULLABLE_LISTS or not (name in ("list", "object") or below in DEFAULTS or below in REQUIRED)
        required = F.schema_of_variant(v).startswith("OBJECT") if below in REQUIRED else F.lit(False)
        parts.append(F.array(_ask(at, f"choice:{below}" if below in CHOICES else name, optional, required, x)))
        if isinstance(f.dataType, T.StructType):
            parts.append(_asked(x, f.dataType, at, below))
        elif isinstance(f.dataType, T.ArrayType):
            elements = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
            parts.append(F.flatten(F.transform(elements, _element(f.dataType.elementType, at, below + "[]"))))
    return F.concat(*parts)


def _element(kind: T.DataType, path: str | Column, pattern: str):
    path = F.lit(path) if isinstance(path, str) else path

    def one(x: Column, i: Column) -> Column:
        at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        own = F.array(_ask(at, kind_of(kind), False, F.lit(False), x))
        return F.concat(own, _asked(x, kind, at, pattern)) if isinstance(kind, T.StructType) else own

    return one


def _fits(e: Column) -> Column:
    """Whether a JSON value is of the kind; numbers may be given as text, truth values also as 0 and 1."""
    kind, v = e["kind"], e["v"]
    said, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = said.isin("BIGINT", "DOUBLE", "FLOAT") | said.startswith("DECIMAL")
    chosen = F.lit(False)
    for p, choices in CHOICES.items():
        chosen = chosen | ((kind == f"choice:{p}") & text.isin(*choices))
    return (
        F.when(kind == "text", said == "STRING").when(kind == "money", number | ((said == "STRING") & text.rlike(NUMBER)))
        .when(kind == "number", number | (said == "BOOLEAN") | ((said == "STRING") & text.rlike(NUMBER)))
        .when(kind == "int", (said == "BOOLEAN") | ((number | (said == "STRING")) & text.rlike(WHOLE)))
        .when(kind == "bool", (said == "BOOLEAN") | (number & text.rlike(r"^[01](\.0*)?$")) | ((said == "STRING") & F.lower(text).isin(*TRUTHS)))
        .when(kind == "list", said.startswith("ARRAY")).when(kind == "object", said.startswith("OBJECT")).otherwise((said == "STRING") & chosen)
    )


def _found(answer: Column, kind: T.StructType) -> Column:
    """array<struct<path, reason>> of the fields that don't fit, in the order of the schema; null for a null answer."""
    def wrong(e: Column) -> Column:
        absent = e["v"].isNull()
        null = e["optional"] & (F.schema_of_variant(e["v"]) == "VOID")
        return F.when(absent, e["required"]).otherwise(~(null | _fits(e)))

    def said(e: Column) -> Column:
        reason = F.lit(None).cast("string")
        for k, text in REASONS.items():
            reason = F.when(e["kind"] == k, F.lit(text)).otherwise(reason)
        return F.struct(e["path"].alias("path"), F.when(e["v"].isNull(), F.lit("missing")).otherwise(reason).alias("reason"))

    found = F.transform(F.filter(_asked(answer, kind, "", ""), wrong), said)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(REASONS["object"]).alias("reason")))
    return F.when(answer.isNotNull(), F.when(F.schema_of_variant(answer).startswith("OBJECT"), found).otherwise(whole))


def faults(answer: Column, kind: T.StructType = RECORD) -> Column:
    """array<string>: `path: what is wrong` of every field of an answer (a variant) that doesn't fit the schema, in its order.

    Fields that the schema doesn't have don't matter; absent ones take their defaults, if they have one. Below a value that
    is no object or list nothing more is looked at. Null for a null answer; an answer that is no object has one fault.
    """
    return F.transform(_found(answer, kind), lambda f: F.concat_ws(": ", f["path"], f["reason"]))


def first_faults(answer: Column, most: int = FIRST) -> Column:
    """The first `most` faults as one text, `what is wrong: path, path; ...`, by what comes first; null where there is none."""
    def grouped(s: Column) -> Column:
        few = s["few"]
        reasons = F.array_distinct(F.transform(few, lambda f: f["reason"]))
        of = lambda r: F.array_join(F.transform(F.filter(few, lambda f: f["reason"] == r), lambda f: f["path"]), ", ")
        return F.when(F.size(few) > 0, F.array_join(F.transform(reasons, lambda r: F.concat_ws(": ", r, F.nullif(of(r), F.lit("")))), "; "))

    few = F.slice(_found(answer, RECORD), 1, most)
    return F.get(F.transform(F.array(F.struct(few.alias("few"))), grouped), F.lit(0))
