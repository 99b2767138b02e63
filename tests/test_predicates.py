"""Truth tables of the 15 predicates: NULL, '', case, backslashes, wildcards that must not be any."""

import pytest

from embertrace.operators.predicates import condition_column, rule_column
from embertrace.rules.model import Condition, Rule

NULL = None
CASES = [
    # operator, operand, {field text: result}
    ("equals", "ABC", {"abc": True, "Abc": True, "abcd": False, "": False}),
    ("not_equals", "abc", {"ABC": False, "x": True, "": True}),
    ("contains", "a%_", {"xA%_y": True, "abc": False, "": False}),
    ("not_contains", "c:\\x", {"C:\\X\\y": False, "d:\\x": True, "": True}),
    ("starts_with", "C:\\", {"c:\\win": True, "xc:\\": False}),
    ("ends_with", "mshta.exe", {"C:\\xMSHTA.exe": True, "mshta.exe.bak": False, "": False}),
    ("not_ends_with", ".exe", {"a.EXE": False, "a.dll": True}),
    ("regex", "^(80|443)$", {"80": True, "8080": False, "443": True}),
    ("regex", ".{3,}", {"ab": False, "abc": True, "\u2028ab": True}),
    ("contains_any", ("X", "\\y\\"), {"ax": True, "c:\\Y\\z": True, "q": False, "": False}),
    ("not_contains_any", ("x", "y"), {"ax": False, "q": True, "": True}),
    ("ends_with_any", ("\\A.exe", "b"), {"c:\\a.EXE": True, "aab": True, "a.exe": False}),
    ("not_ends_with_any", ("\\A.exe", "b"), {"c:\\a.EXE": False, "aab": False, "a.exe": True}),
    ("bits_any_set", ("0x10", "zz", "0x3"), {
        "0x1410": True, "1410": True, "0x3": True, "0x1": False, "": False, "bad!": False, "zz": False,
        " 0X10 ": True, "-0x10": True, "0x": False, "1_0": True, "0xFFFFFFFFFFFFFFFFFFFF": True}),
    ("bits_any_set", ("0x0",), {"0x5": True, "": False, "nope": False}),
]


@pytest.mark.parametrize("operator,operand,table", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_text_predicates(wide, operator, operand, table):
    kw = {"values": operand} if isinstance(operand, tuple) else {"value": operand}
    events = wide(*[{"command_line": text} for text in [*table, NULL]])
    strict, loose = Condition("command_line", operator, **kw), Condition("command_line", operator, allow_null=True, **kw)
    got = events.select(
        "command_line", condition_column(strict, events.columns).alias("s"),
        condition_column(loose, events.columns).alias("l")).collect()
    assert {r[0]: r[1] for r in got} == {**table, NULL: False}
    assert {r[0]: r[2] for r in got} == {**table, NULL: True}


@pytest.mark.parametrize("a,b,same", [
    ("C:\\x\\App.exe", "d:/y/app.EXE", True), ("C:\\x\\a.exe", "C:\\x\\b.exe", False), ("C:\\x\\", "D:\\y\\", True)])
def test_basename_predicates(wide, a, b, same):
    events = wide({"source_image": a, "target_image": b})
    test = lambda op: events.select(condition_column(
        Condition("source_image", op, reference_field="target_image"), events.columns)).first()[0]
    assert test("same_basename") is same and test("not_same_basename") is not same


def test_missing_reference_fails_but_missing_field_follows_allow_null(wide):
    events = wide({"source_image": "a", "target_image": None}, {"source_image": None, "target_image": "a"})
    for op in ("same_basename", "not_same_basename"):
        c = Condition("source_image", op, reference_field="target_image", allow_null=True)
        assert [r[0] for r in events.select(condition_column(c, events.columns)).collect()] == [False, True]


def test_booleans_numbers_and_unknown_fields(wide):
    events = wide({"initiated": True, "destination_port": 443})
    tests = [
        (Condition("initiated", "equals", value="true"), True), (Condition("destination_port", "equals", value="443"), True),
        (Condition("no_such", "equals", value="x"), False), (Condition("no_such", "equals", value="x", allow_null=True), True)]
    for condition, expected in tests:
        assert events.select(condition_column(condition, events.columns)).first()[0] is expected


def test_or_logic_with_null_stays_two_valued(wide):
    events = wide({"image": None, "command_line": "hit"})
    rule = Rule("R", (1,), "Low", "t", "t", (
        Condition("image", "ends_with", value="x"), Condition("command_line", "contains", value="hit")), logic="OR")
    assert events.select(rule_column(rule, events.columns)).first()[0] is True


def test_masks_wider_than_the_comparison_are_refused(wide):
    events = wide({"granted_access": "0x1"})
    with pytest.raises(ValueError):
        condition_column(Condition("granted_access", "bits_any_set", values=("0x" + "f" * 16,)), events.columns)
