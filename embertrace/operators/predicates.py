"""Detection predicates: one Column per rule condition.

Every comparison is on lower-cased text and the answer is two-valued: a NULL field gives the
condition's ``allow_null``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace.functions.text import basename, contains_any, hex_value
from embertrace.rules.model import FIELD_OPERATORS, Condition, Rule


def _ends_with_any(text: Column, suffixes) -> Column:
    return reduce(or_, [F.endswith(text, F.lit(s)) for s in dict.fromkeys(suffixes)])


def bits_any_set(number: Column, masks) -> Column:
    """Does the parsed number hold all bits of any mask? A number that did not parse does not."""
    hit = F.lit(False)
    for mask in masks:
        try:
            wanted = int(mask.strip(), 16)
        except ValueError:
            continue  # a mask that is not hex never matches
        if not 0 <= wanted < 1 << 60:
            raise ValueError(f"Access mask {mask!r} is outside 0..2^60.")
        hit = hit | (number.bitwiseAND(F.lit(wanted).cast("bigint")) == wanted)
    return F.coalesce(hit, F.lit(False))


# text Column, lower-cased operand(s) -> boolean Column
PREDICATES = {
    "equals": lambda t, v: t == v,
    "not_equals": lambda t, v: t != v,
    "contains": lambda t, v: F.contains(t, F.lit(v)),
    "not_contains": lambda t, v: ~F.contains(t, F.lit(v)),
    "contains_any": contains_any,
    "not_contains_any": lambda t, vs: (t == "") | ~contains_any(t, vs),
    "bits_any_set": lambda t, vs: bits_any_set(hex_value(t), vs),
    "starts_with": lambda t, v: F.startswith(t, F.lit(v)),
    "ends_with": lambda t, v: F.endswith(t, F.lit(v)),
    "not_ends_with": lambda t, v: ~F.endswith(t, F.lit(v)),
    "ends_with_any": _ends_with_any,
    "not_ends_with_any": lambda t, vs: ~_ends_with_any(t, vs),
    "same_basename": lambda t, other: basename(t) == basename(other),
    "not_same_basename": lambda t, other: basename(t) != basename(other),
}


def lower_text(field: str) -> Column:
    return F.lower(F.col(field).cast("string"))


def condition_column(cond: Condition, columns: list[str], lowered: dict[str, str] | None = None) -> Column:
    """A condition as a non-null boolean. A field the frame does not have counts as NULL.

    ``lowered`` names columns that already hold a field's lower-cased text, or (under
    ``<field> as hex``) its number.
    """
    if cond.field not in columns:
        return F.lit(cond.allow_null)
    ready = (lowered or {}).get(cond.field)
    text = F.col(ready) if ready else lower_text(cond.field)
    if cond.operator in FIELD_OPERATORS:
        if cond.reference_field not in columns:
            test = F.lit(False)
        else:
            other = F.col(cond.reference_field).cast("string")
            test = other.isNotNull() & PREDICATES[cond.operator](text, other)
    elif cond.operator == "regex":
        # Unix-lines mode: '.' stops at '\n' only and '$' allows one trailing '\n'.
        test = F.rlike(text, F.lit("(?id)" + (cond.value or "")))
    elif cond.operator == "bits_any_set":
        number = (lowered or {}).get(f"{cond.field} as hex")
        test = bits_any_set(F.col(number) if number else hex_value(text), cond.values)
    elif cond.values:
        test = PREDICATES[cond.operator](text, [v.lower() for v in cond.values])
    else:
        test = PREDICATES[cond.operator](text, (cond.value or "").lower())
    return F.when(text.isNull(), F.lit(cond.allow_null)).otherwise(test)


def rule_column(rule: Rule, columns: list[str], lowered: dict[str, str] | None = None) -> Column:
    """All conditions of a rule joined by its logic; the event type is tested by the caller."""
    tests = [condition_column(c, columns, lowered) for c in rule.conditions]
    return reduce(and_ if rule.logic == "AND" else or_, tests)
