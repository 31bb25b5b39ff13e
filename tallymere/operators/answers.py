"""From a model's answer as text to a record: the object is cut out, mended, parsed and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.readers import LABEL
from .record_checks import first_faults

# What stands between marks of code, if anything does.
FENCED = r"(?sU)```(?:json)?\s*(.*?)```"
#: Signs that change the state of the scan, each alone, and the runs between them.
PIECE = r'[\\"{}]|[^\\"{}]+'


def _object_length(text: Column) -> Column:
    """Length of the object that opens at the first character of text; null where it never closes.

    Braces inside strings don't count, nor quotes after a backslash inside them. One fold over the pieces of the text,
    linear in its length.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        live = ~s["quoted"]
        depth = s["depth"] + F.when(live & (piece == "{"), 1).when(live & (piece == "}"), -1).otherwise(0)
        at = s["at"] + F.length(piece)
        quoted = F.when((piece == '"') & ~s["escaped"], live).otherwise(s["quoted"])
        escaped = s["quoted"] & ~s["escaped"] & (piece == "\\")
        end = F.when((s["end"] == 0) & live & (piece == "}") & (depth == 0), at).otherwise(s["end"])
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), at.alias("at"), end.alias("end"))

    return F.nullif(F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), start, step, lambda s: s["end"]), F.lit(0))


def with_blob(rows, text: str = "text"):
    """rows with `blob`, the answer's JSON object without trailing commas, or `blob_error`, why there is none.

    Null and blank answers, answers without an object and objects cut short are told apart. Commas before a closing
    bracket go inside strings too.
    """
    whole = F.col(text)
    fenced = F.when(F.regexp_like(whole, F.lit(FENCED)), F.regexp_extract(whole, FENCED, 1)).otherwise(whole)
    opened = rows.withColumn("_inner", fenced).withColumn("_open", F.when(F.instr("_inner", "{") > 0, F.expr("substring(_inner, instr(_inner, '{'))")))
    sized = opened.withColumn("_size", _object_length(F.col("_open")))
    error = (
        F.when(whole.isNull() | ~F.regexp_like(whole, F.lit(r"(?U)\S")), "empty answer").when(F.col("_open").isNull(), "no object in the answer")
        .when(F.col("_size").isNull(), "the object is cut short")
    )
    cut = F.regexp_replace(F.expr("substring(_open, 1, _size)"), r"(?U),\s*([}\]])", "$1")
    return sized.withColumn("blob_error", error).withColumn("blob", F.when(F.col("blob_error").isNull(), cut)).drop("_inner", "_open", "_size")


def with_record(rows, text: str = "text"):
    """with_blob's rows and `record` (fields as text; a bare number keeps its value, not its trailing zeros) or `error`, why
    there is none: no object, no JSON (an object that names a key twice is none), or the first five fields that don't fit the schema."""
    parsed = with_blob(rows, text).withColumn("_answer", F.try_parse_json("blob"))
    wrong = first_faults(F.col("_answer"))
    error = F.when(F.col("blob_error").isNotNull(), F.col("blob_error")).when(F.col("_answer").isNull(), "invalid JSON").otherwise(wrong)
    read = parsed.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), F.from_json("blob", LABEL, {"allowSingleQuotes": "false"})))
    return read.drop("_answer", "blob_error")


def has_content(record: Column | str = "record") -> Column:
    """Whether a record says anything that was read from the document; flags and the reader's own remarks don't count."""
    r = F.col(record) if isinstance(record, str) else record
    texts = [r[p][f] for p, names in (("merchant", "name branch address tax_id phone"), ("buyer", "name tax_id"), ("receipt", "number date date_raw time currency cashier terminal"),
                                      ("totals", "subtotal tax discount total tender change"), ("payment", "method card_last4")) for f in names.split()]
    filled = F.size(r["line_items"]) > 0
    for t in texts:
        filled = F.coalesce(filled, F.lit(False)) | F.coalesce(strip(t) != "", F.lit(False))
    return filled
