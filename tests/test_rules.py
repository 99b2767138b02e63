"""Every shipped rule: one event that fires it, and one per condition that fails just that one."""

from collections import Counter

import pytest

from embertrace.operators import rule_table
from embertrace.operators.detect import detect, rule_words
from embertrace.operators.killchain import rules_frame, tactic_map
from embertrace.rules import Condition, Rule, catalogue
from embertrace.sources.rule_files import load_rules, load_tactics

INTS, BOOLS = {"destination_port"}, {"initiated", "signed"}
PATTERNS = {"^(80|443)$": ("443", "8080"), "^(445|139)$": ("445", "80"), ".{50,}": ("q" * 50, "q" * 49)}


def good(c: Condition) -> str:
    """A text that satisfies the condition."""
    op = c.operator
    if op == "regex":
        return PATTERNS.get(c.value, (c.value.strip("^$()").split("|")[0],))[0]
    if op in ("equals", "contains", "ends_with"):
        return c.value if op == "equals" else "C:\\z\\" + c.value
    if op in ("contains_any", "ends_with_any"):
        return "C:\\z\\" + c.values[0].lstrip("\\") if op == "ends_with_any" else f"z {c.values[0]}"
    return c.values[0] if op == "bits_any_set" else "C:\\z\\plain.bin"


def bad(c: Condition):
    """A text that fails the condition."""
    if c.operator in ("not_contains_any", "not_ends_with_any"):
        return "C:\\z" + ("" if c.values[0].startswith("\\") else "\\") + c.values[0]
    if c.operator in ("not_contains", "not_ends_with"):
        return "C:\\z\\" + c.value
    if c.operator == "regex":
        return PATTERNS.get(c.value, (None, "1"))[1]
    return {"equals": "true" if c.value == "false" else "false", "bits_any_set": "0x0"}.get(c.operator, "C:\\z\\other.txt")


def record(rule: Rule, number: int, fail: int | None = None) -> dict:
    """All conditions of a field met by one text (joined where several positive ones need it)."""
    fields: dict[str, str] = {}
    for c in rule.conditions:
        if c.operator.startswith("not_"):
            fields.setdefault(c.field, "C:\\z\\plain.bin")
        else:
            before = fields.get(c.field)
            text = good(c)
            fields[c.field] = text if before in (None, "C:\\z\\plain.bin") else f"{before} {text}"
        if c.reference_field:
            fields.setdefault(c.reference_field, "C:\\z\\second.bin")
    if fail is not None:
        c = rule.conditions[fail]
        fields[c.field] = fields[c.reference_field] if c.reference_field else bad(c)
    out: dict = {"id": number, "event_type_id": rule.event_ids[0]}
    for f, text in fields.items():
        out[f] = int(text) if f in INTS else text == "true" if f in BOOLS else text
    return out


def test_each_rule_fires_and_each_condition_matters(wide):
    records, fires, silent = [], {}, {}
    for rule in catalogue():
        fires[len(records)] = rule.id
        records.append(record(rule, len(records)))
        for i in range(len(rule.conditions)):
            silent[len(records)] = rule.id
            records.append(record(rule, len(records), fail=i))
    hits = {(r.event_fk, r.rule_id) for r in detect(wide(*records)).select("event_fk", "rule_id").collect()}
    assert [n for n, r in fires.items() if (n, r) not in hits] == []
    assert [(n, r) for n, r in silent.items() if (n, r) in hits] == []


def test_catalogue_shape():
    rules = catalogue()
    assert len(rules) == len({r.id for r in rules}) == 51
    assert Counter(r.severity for r in rules) == {"High": 40, "Medium": 8, "Critical": 3}
    assert Counter(r.event_ids[0] for r in rules) == {1: 34, 3: 7, 10: 4, 7: 2, 8: 2, 22: 2}


def test_more_rules_than_one_mask_holds(wide):
    rules = [Rule(f"R{i:03d}", (1,), "Low", "t", "t", (Condition("command_line", "contains", value=f"<{i}>"),)) for i in range(130)]
    assert len(rule_words(rules)) == 3
    hits = detect(wide({"command_line": "<0> <59> <60> <129>"}, {"command_line": "none"}), rules)
    assert sorted(r.rule_id for r in hits.collect()) == ["R000", "R059", "R060", "R129"]


def test_rules_table_is_valid_and_faults_are_named(spark):
    table = rules_frame(spark)
    assert rule_table.checked(table).filter("size(problems) > 0").count() == 0
    twice = table.limit(1).unionByName(table.limit(1))
    assert {tuple(r.problems) for r in rule_table.checked(twice).collect()} == {("repeated id",)}


def test_tactic_map_by_name_id_and_unknown(spark):
    rows = [("a", "n", "execution", "T1"), ("b", "n", "TA0040", "T1"), ("c", "n", "Mystery", "T1"), ("d", "n", None, "T1")]
    table = spark.createDataFrame(rows, "rule_id string, rule_name string, mitre_tactic string, mitre_technique string")
    got = {r.rule_id: (r.tactic_id, r.tactic_name) for r in tactic_map(table).collect()}
    assert got == {"a": ("TA0002", "Execution"), "b": ("TA0040", "Impact"), "c": ("UNKNOWN", "Mystery"), "d": ("", "")}


RULE_TEXT = """
- id: {id}
  name: n
  description: d
  mitre_technique: T1
  mitre_tactic: Execution
  severity: {severity}
  event_ids: {eids}
  logic: {logic}
  conditions:
    - field: image
      operator: {operator}
      {operand}
"""
OK = dict(id="B", severity="Low", eids="[1]", logic="AND", operator="ends_with", operand="value: x.exe")


def test_rule_files_load_sorted(tmp_path):
    (tmp_path / "b.yaml").write_text(RULE_TEXT.format(**OK))
    (tmp_path / "a.yaml").write_text(RULE_TEXT.format(**{**OK, "id": "A", "operator": "contains_any", "operand": "values: [x, 7]"}))
    rules = load_rules(tmp_path)
    assert [r.id for r in rules] == ["A", "B"] and rules[0].conditions[0].values == ("x", "7")
    (tmp_path / "c.yml").write_text("{id: C, mitre_tactic: TA0001}")
    (tmp_path / "d.yaml").write_text("[unclosed")
    assert [r[0] for r in load_tactics(tmp_path)] == ["A", "B", "C"]


@pytest.mark.parametrize("change", [
    {"severity": "Severe"}, {"logic": "XOR"}, {"eids": "[]"}, {"eids": "['1']"}, {"operator": "sounds_like"},
    {"operator": "contains_any"}, {"operand": "value: ''"}, {"operator": "same_basename"}])
def test_bad_rule_files_stop_the_load(tmp_path, change):
    (tmp_path / "a.yaml").write_text(RULE_TEXT.format(**{**OK, **change}))
    with pytest.raises(ValueError):
        load_rules(tmp_path)


def test_repeated_and_malformed_files_stop_the_load(tmp_path):
    (tmp_path / "a.yaml").write_text(RULE_TEXT.format(**OK) + RULE_TEXT.format(**OK))
    with pytest.raises(ValueError, match="Repeated"):
        load_rules(tmp_path)
    (tmp_path / "a.yaml").write_text("id: not a list")
    with pytest.raises(ValueError, match="list of rules"):
        load_rules(tmp_path)
