"""The schema of a record as types, and what types can't say: choices, defaults, fields that must be there."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 4)
_TEXT, _BOOL, _INT = T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


_MODIFIER = _struct(label=_TEXT, amount=MONEY)
_BAND = _struct(label=_TEXT, base=MONEY, rate=MONEY, amount=MONEY)
ITEM = _struct(
    position=_INT, description_raw=_TEXT, sku=_TEXT, qty=MONEY, unit=_TEXT, unit_price=MONEY, line_total=MONEY,
    modifiers=T.ArrayType(_MODIFIER), bbox=T.ArrayType(T.DoubleType()), is_template_row=_BOOL,
)
RECORD = _struct(
    merchant=_struct(name=_TEXT, branch=_TEXT, address=_TEXT, tax_id=_TEXT, phone=_TEXT),
    buyer=_struct(name=_TEXT, tax_id=_TEXT),
    receipt=_struct(number=_TEXT, date=_TEXT, date_raw=_TEXT, time=_TEXT, currency=_TEXT, decimal_convention=_TEXT, cashier=_TEXT, terminal=_TEXT),
    line_items=T.ArrayType(ITEM),
    totals=_struct(subtotal=MONEY, tax=MONEY, tax_breakdown=T.ArrayType(_BAND), discount=MONEY, total=MONEY, tender=MONEY, change=MONEY, prices_include_tax=_BOOL),
    payment=_struct(method=_TEXT, card_last4=_TEXT),
    meta=_struct(
        is_handwritten=_BOOL, is_refund=_BOOL, legibility=_TEXT, ambiguous_fields=T.ArrayType(_TEXT), unreadable_regions=T.ArrayType(_TEXT),
        receipt_is_inconsistent=_BOOL, notes=_TEXT,
    ),
)

# What some fields may say, what they say unless something is given, and those without a default.
CHOICES = {"meta.legibility": ("good", "fair", "poor", "unreadable"), "receipt.decimal_convention": ("point", "comma")}
DEFAULTS = {
    "receipt.decimal_convention": "point", "line_items[].position": 0, "line_items[].description_raw": "", "line_items[].is_template_row": False,
    "meta.is_handwritten": False, "meta.is_refund": False, "meta.legibility": "good", "meta.receipt_is_inconsistent": False,
}
REQUIRED = ("line_items[].modifiers[].label",)
#: Lists that may be null; all others are empty instead.
NULLABLE_LISTS = ("line_items[].bbox",)


def kind_of(kind: T.DataType) -> str:
    """text, money, number, int, bool, list or object."""
    for of, name in ((T.StringType, "text"), (T.DecimalType, "money"), (T.DoubleType, "number"), (T.IntegerType, "int"), (T.BooleanType, "bool"), (T.ArrayType, "list")):
        if isinstance(kind, of):
            return name
    return "object"
