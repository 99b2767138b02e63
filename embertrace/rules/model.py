"""What a rule is. A rule is data; ``operators.detect`` turns it into Columns."""

from __future__ import annotations

from dataclasses import dataclass

# The operator vocabulary, by the operand each takes.
TEXT_OPERATORS = {
    "equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with",
    "not_ends_with", "regex",
}
LIST_OPERATORS = {
    "contains_any", "not_contains_any", "bits_any_set", "ends_with_any", "not_ends_with_any",
}
FIELD_OPERATORS = {"same_basename", "not_same_basename"}
OPERATORS = TEXT_OPERATORS | LIST_OPERATORS | FIELD_OPERATORS


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str | None = None
    values: tuple[str, ...] = ()
    reference_field: str | None = None
    allow_null: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    event_ids: tuple[int, ...]
    severity: str
    mitre_tactic: str
    mitre_technique: str
    conditions: tuple[Condition, ...]
    name: str = ""
    description: str = ""
    logic: str = "AND"
