"""What a model is asked: prompts as columns over documents, the schema it is to fill, and hashes that tell versions apart."""

from __future__ import annotations

import hashlib
import json
from dataclasses import astuple, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank, strip
from ..sources.record_schema import CHOICES, DEFAULTS, NULLABLE_LISTS, RECORD, REQUIRED, kind_of


@dataclass(frozen=True)
class Templates:
    """The texts of one version; names in braces are filled in by document."""

    version: str = "1"
    system: str = "You transcribe purchase documents. Write what is printed, never what would fit; leave out what can't be read."
    triage: str = "Say what kind of document this is, how it was printed, how legible it is and about how many lines it lists. Answer in JSON."
    extraction: str = "Transcribe this document into the schema.{hints}{examples}\nPrint: {print}. Lines: about {lines}. Seen on the image: {issues}.{handwriting}\nAnswer in JSON."
    hints: str = "\nIt seems to come from {merchant}. Known of its documents:\n{lines}\nWhere the image says otherwise, the image is right."
    examples: str = "\nChecked transcriptions of {n} other document(s) of this merchant:"
    example: str = "\nExample {k}:\n{record}"
    handwriting: str = "\nIt is written by hand: leave out a number with any doubtful digit, and name its field as ambiguous."
    repair: str = "This was read before:\n{record}\nThese checks failed:\n{findings}\nLook again and mend only what was misread; never change a number to make sums work. Answer in JSON."


def _filled(template: str, **values: Column) -> Column:
    """The template with its names replaced, in one pass over its parts, so that braces inside values stay as they are."""
    parts: list[Column] = []
    while template:
        found = min((template.find("{" + n + "}"), n) for n in values if "{" + n + "}" in template) if any("{" + n + "}" in template for n in values) else None
        if found is None:
            parts.append(F.lit(template))
            break
        at, name = found
        parts += [F.lit(template[:at])] if at else []
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        template = template[at + len(name) + 2 :]
    return F.concat(*parts)


def extraction_prompt(
    print_type: Column, lines: Column, issues: Column, handwritten: Column, merchant: Column | None = None, hints: Column | None = None, examples: Column | None = None, t: Templates = Templates(),
) -> Column:
    """The request to transcribe: what triage saw, hints of the merchant (array of texts) and checked examples (array of JSON).

    What isn't known is said to be unknown; without hints, examples or handwriting their parts are left out.
    """
    empty, none = F.lit(""), F.array().cast("array<string>")
    known = F.coalesce(hints, none) if hints is not None else none
    hint_lines = F.array_join(F.transform(known, lambda h: F.concat(F.lit("- "), h)), "\n")
    shots = F.coalesce(examples, none) if examples is not None else none
    shown = F.array_join(F.transform(shots, lambda x, i: _filled(t.example, k=i + 1, record=x)), "")
    return _filled(
        t.extraction, hints=F.when(F.size(known) > 0, _filled(t.hints, merchant=empty if merchant is None else merchant, lines=hint_lines)).otherwise(empty),
        examples=F.when(F.size(shots) > 0, F.concat(_filled(t.examples, n=F.size(shots)), shown)).otherwise(empty), print=F.coalesce(print_type, F.lit("unknown")), lines=F.coalesce(lines.cast("string"), F.lit("unknown")),
        issues=F.when(F.size(issues) > 0, F.array_join(issues, ", ")).otherwise(F.lit("nothing")), handwriting=F.when(F.coalesce(handwritten, F.lit(False)), F.lit(t.handwriting)).otherwise(empty),
    )


def repair_prompt(record: Column, findings: Column, t: Templates = Templates()) -> Column:
    """The request to look again: the record with its nulls, so that what was left out is seen, and the findings as text."""
    said = F.when(blank(findings), "(none)").otherwise(strip(findings))
    return _filled(t.repair, record=F.to_json(record, {"ignoreNullFields": "false"}), findings=said)


def prompt_hash(text: Column) -> Column:
    """Sixteen hex digits that tell a prompt."""
    return F.left(F.sha2(text, 256), F.lit(16))


def attempt_hash(pass_name: Column, extraction: Column, previous: Column, findings: Column, t: Templates = Templates()) -> Column:
    """The hash of what was asked in an attempt: a repair shows the attempt before it, every other pass the document's own request."""
    return prompt_hash(F.when(pass_name == "repair", repair_prompt(previous, findings, t)).otherwise(extraction))


def tool_schema(kind: T.StructType = RECORD, pattern: str = "") -> dict:
    """The JSON schema of a record, from its types: what may be null, the choices, and the fields that must be there."""
    names = {"text": "string", "money": ["number", "string"], "number": "number", "int": "integer", "bool": "boolean"}
    properties = {}
    for f in kind.fields:
        below = f"{pattern}.{f.name}" if pattern else f.name
        of = kind_of(f.dataType)
        if of == "object":
            properties[f.name] = tool_schema(f.dataType, below)
            continue
        if of == "list":
            element = f.dataType.elementType
            items = tool_schema(element, below + "[]") if isinstance(element, T.StructType) else {"type": names[kind_of(element)]}
            properties[f.name] = {"type": ["array", "null"] if below in NULLABLE_LISTS else "array", "items": items}
            continue
        given = names[of] if isinstance(names[of], list) else [names[of]]
        free = below not in DEFAULTS and below not in REQUIRED
        properties[f.name] = {"type": [*given, "null"] if free else given[0] if len(given) == 1 else given} | ({"enum": list(CHOICES[below])} if below in CHOICES else {}) | ({"default": DEFAULTS[below]} if below in DEFAULTS else {})
    required = [n for n in properties if (f"{pattern}.{n}" if pattern else n) in REQUIRED]
    return {"type": "object", "properties": properties} | ({"required": required} if required else {})


def bundle_hash(t: Templates = Templates(), kind: T.StructType = RECORD) -> str:
    """One hash over all texts of a version and the schema; it changes whenever any of them does."""
    whole = "\x00".join([*astuple(t), json.dumps(tool_schema(kind), sort_keys=True)])
    return hashlib.sha256(whole.encode()).hexdigest()[:16]


def rung_identity(model_id: Column, use_tools: Column, t: Templates = Templates()) -> Column:
    """struct(prompt_version, bundle_hash, model_id, use_tools): what ran, as runs are told apart by."""
    return F.struct(F.lit(t.version).alias("prompt_version"), F.lit(bundle_hash(t)).alias("bundle_hash"), model_id.alias("model_id"), use_tools.alias("use_tools"))
