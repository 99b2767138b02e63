"""Evaluate a rule set over events: narrow, no shuffle, no join.

Each event gets one bitmask of the rules that fired. A rule is tested only inside the branch of
its event type, and only the rows whose mask is not 0 are built into hits.

Two points about the plan:

* Fields are lower-cased, and access masks parsed, once per row in a projection of their own.
* Fifty rules make more than 64 KB of bytecode, which cannot be one method. Spark splits such an
  expression into many small methods as long as the projection is not fused into a whole-stage
  function. A higher-order function in the projection (the ``_routed`` test) keeps it unfused;
  the masks beside it stay compiled.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.functions.clock import lit_time
from embertrace.functions.text import hex_value
from embertrace.operators.predicates import lower_text, rule_column
from embertrace.rules import Rule, catalogue

WORD_BITS = 60  # rules per mask column; a bigint keeps its sign bit clear


def rule_words(rules: Sequence[Rule]) -> list[list[Rule]]:
    ordered = sorted(rules, key=lambda r: r.id)
    return [ordered[i : i + WORD_BITS] for i in range(0, len(ordered), WORD_BITS)]


@lru_cache(maxsize=64)
def _built(session: str, columns: tuple[str, ...], rules: tuple[Rule, ...]) -> tuple[dict[str, Column], list[Column]]:
    """(prepared columns, masks). Building thousands of Column nodes takes seconds in Python and
    they do not depend on the data, so a session builds them once per rule set and layout."""
    fields = dict.fromkeys(c.field for r in rules for c in r.conditions)
    lowered = {f: f"_lower_{f}" for f in fields if f in columns}
    ready = {name: lower_text(f) for f, name in lowered.items()}
    for f in dict.fromkeys(c.field for r in rules for c in r.conditions if c.operator == "bits_any_set"):
        if f in columns:
            lowered[f"{f} as hex"] = f"_hex_{f}"
            ready[f"_hex_{f}"] = hex_value(F.col(f).cast("string"))
    return ready, fired_masks(list(columns), rules, lowered)


def fired_masks(columns: list[str], rules: Sequence[Rule], lowered: dict[str, str] | None = None) -> list[Column]:
    """One mask Column per 60 rules: bit i is set when rule i (by id) fired."""
    masks = []
    zero = F.lit(0).cast("bigint")
    for word in rule_words(rules):
        by_type: dict[int, Column] = {}
        for bit, rule in enumerate(word):
            flag = F.when(rule_column(rule, columns, lowered), F.lit(1 << bit).cast("bigint")).otherwise(zero)
            for eid in dict.fromkeys(rule.event_ids):
                by_type[eid] = by_type[eid].bitwiseOR(flag) if eid in by_type else flag
        mask = zero
        for eid, total in by_type.items():
            mask = F.when(F.col("event_type_id") == eid, total).otherwise(mask)
        masks.append(mask)
    return masks


def with_masks(events: DataFrame, rules: Sequence[Rule] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Events (or their ``keep`` columns) plus ``_routed`` and ``fired_0``, ``fired_1``, ..."""
    rules = catalogue() if rules is None else rules
    keep = events.columns if keep is None else list(keep)
    session = events.sparkSession.sparkContext.applicationId
    used = {f for r in rules for c in r.conditions for f in (c.field, c.reference_field)}
    ready, masks = _built(session, tuple(c for c in events.columns if c in used), tuple(rules))
    prepared = events.withColumns(ready)
    types = sorted({eid for r in rules for eid in r.event_ids})
    routed = F.exists(F.array("event_type_id"), lambda t: t.isin(types))
    return prepared.select(
        *keep, routed.alias("_routed"), *[m.alias(f"fired_{i}") for i, m in enumerate(masks)])


def _rule_positions(words: int) -> Column:
    """Zero-based positions of all set bits over the mask columns."""
    parts = []
    for w in range(words):
        mask, base = F.col(f"fired_{w}"), w * WORD_BITS
        bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.getbit(mask, i) == 1)
        parts.append(bits if w == 0 else F.transform(bits, lambda i: i + base))
    return parts[0] if words == 1 else F.concat(*parts)


def fired_rule_ids(rules: Sequence[Rule]) -> Column:
    """Ids, in order, of the rules whose bits are set in the columns of ``with_masks``; an event of a type
    that no rule asks for has none.

    The masks are named outside the bits' filter as well: a mask that is named once is moved into that filter,
    which would test every rule once for each bit.
    """
    words = len(rule_words(rules))
    any_fired = F.greatest(*[F.col(f"fired_{w}") for w in range(words)], F.lit(0)) > 0
    ids = F.array(*[F.lit(r.id) for r in sorted(rules, key=lambda r: r.id)])
    fired = F.transform(_rule_positions(words), lambda p: F.get(ids, p.cast("int")))
    return F.when(F.col("_routed") & any_fired, fired).otherwise(F.array().cast("array<string>"))


@lru_cache(maxsize=64)
def _rule_lookup(session: str, rules: tuple[Rule, ...]) -> Column:
    """The rule attributes as one constant array, in id order."""
    return F.array(*[
        F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"),
            F.lit(r.mitre_technique).alias("mitre_technique"), F.lit(r.mitre_tactic).alias("mitre_tactic"),
        )
        for r in sorted(rules, key=lambda r: r.id)
    ])


def detect(
    events: DataFrame,
    rules: Sequence[Rule] | None = None,
    fired_at: datetime | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (event, rule that fired), with the columns of the hits table.

    ``fired_at`` is the evaluation clock; without it a hit carries its event's time.
    ``keep`` names event columns to carry along.
    """
    rules = catalogue() if rules is None else list(rules)
    words = len(rule_words(rules))
    kept = list(dict.fromkeys(["id", "event_time", *keep]))
    masked = with_masks(events, rules, kept)
    any_fired = F.lit(False)
    for w in range(words):
        any_fired = any_fired | (F.col(f"fired_{w}") != 0)
    # The outer form: a plain explode makes Spark test the mask in a filter of its own first,
    # which evaluates every rule twice.
    positions = F.when(F.col("_routed") & any_fired, _rule_positions(words))
    fired = masked.select(
        F.col("id").alias("event_fk"), "event_time", *keep, F.explode_outer(positions).alias("_pos")
    ).filter(F.col("_pos").isNotNull())
    info = F.get(_rule_lookup(events.sparkSession.sparkContext.applicationId, tuple(rules)), F.col("_pos"))
    hits = fired.select("*", info.alias("_rule"))
    stamp = F.col("event_time") if fired_at is None else lit_time(fired_at)
    return hits.select(
        F.concat_ws(":", F.col("event_fk").cast("string"), F.col("_rule.rule_id")).alias("id"),
        "event_fk",
        "_rule.*",
        F.lit(None).cast("string").alias("matched_fields"),
        stamp.alias("timestamp"),
        "event_time",
        *keep,
    )
