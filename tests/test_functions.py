import ipaddress
import math
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from embertrace.functions import clock, lines, net, text

UTC = timezone.utc


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_file_names(spark):
    paths = ["C:\\a\\B.exe", "C:/a/B.exe", "C:\\a\\", "", None, "B.exe", "C:", "\\\\srv\\share\\x.exe", "\\\\srv\\share", "C:x.exe", "a\\.", "a/b//"]
    assert apply(spark, text.basename, paths) == ["b.exe", "b.exe", "", "", None, "b.exe", "c:", "x.exe", "share", "c:x.exe", ".", ""]
    assert apply(spark, text.win_name, paths) == ["B.exe", "B.exe", "a", None, None, "B.exe", None, "x.exe", None, "x.exe", "a", "b"]


def test_entropy_matches_a_direct_count(spark):
    values = ["", None, "a", "aab", "ab" * 500, "naïve – 測試 😀😀", "x\\y|.*", "the quick brown fox " * 50]

    def direct(s):
        if not s:
            return 0.0
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    for got, value in zip(apply(spark, text.entropy, values), values):
        assert got == pytest.approx(direct(value), abs=1e-9)


def test_numbers_and_flags(spark):
    values = ["7", " -3 ", "1_000", "1.5", "", None, "x", "9" * 25, "+4", "1__0"]
    assert apply(spark, text.to_int, values) == [7, -3, 1000, None, None, None, None, None, 4, None]
    assert apply(spark, text.to_bool, ["TRUE", "false", "yes", "1", "t", None]) == [True, False, None, None, None, None]


def test_masks_match_python_parsing(spark):
    values = ["0x1F0FFF", "0X10", "16", "010", "0", "00", "0b101", "0o17", "", "zz", "-0x10", " 32 ", "1_0", "0x1_0", "0x", "1e3", "_1"]

    def direct(base):
        def one(v):
            try:
                return int(v, base)
            except ValueError:
                return None
        return [one(v) for v in values]

    assert apply(spark, text.mask_value, values) == direct(0)
    assert [v for v in apply(spark, text.hex_value, values)] == [
        None if w is None else w for w in direct(16)]


V4 = ["8.8.8.8", "10.0.0.1", "100.64.0.1", "224.0.0.1", "192.0.0.9", "192.0.0.8", "192.0.0.170", "203.0.113.10", "169.254.1.1", "172.15.0.1",
      "172.16.0.1", "172.31.255.255", "172.32.0.0", "198.18.0.1", "198.20.0.0", "240.0.0.1", "255.255.255.255", "0.0.0.0", "127.9.9.9", "1.2.3",
      "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "", "host"]
V6 = ["::1", "::", "fe80::1", "fc00::1", "fe80::1%eth0", "2001:db8::1", "2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:1::1",
      "2001:1::3", "2002::1", "64:ff9b:1::5", "64:ff9b::1.2.3.4", "3fff::1", "100::1", "ff02::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":::", "12345::",
      "2001:4:112::1", "2001:20::5", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "FE80::ABCD", "1:2:3:4:5:6:1.2.3.4", "g::1"]


def test_external_addresses_match_the_standard_library(spark):
    def direct(v):
        try:
            ip = ipaddress.ip_address(v)
        except ValueError:
            return 0
        return int(not ip.is_private and not ip.is_loopback)

    values = V4 + V6
    got = dict(zip(values, apply(spark, net.is_external, values)))
    assert {v: g for v, g in got.items() if g != direct(v)} == {}
    assert apply(spark, net.is_external, [None]) == [0]


def test_event_times(spark):
    moment = datetime(2024, 3, 1, 5, 6, 7, 123456)
    values = ["2024-03-01T05:06:07.1234567Z", "2024-03-01 05:06:07.123456", "", "soon", None]
    micros = apply(spark, lambda c: F.unix_micros(clock.event_time(c)), values)
    want = int(moment.replace(tzinfo=UTC).timestamp()) * 1_000_000 + 123456
    assert micros == [want, want, None, None, None]
    assert apply(spark, lambda c: clock.hour_or_unknown(clock.event_time(c)), values) == [5, 5, -1, -1, -1]
    assert apply(spark, lambda c: clock.off_hours(clock.event_time(c)), ["2024-01-01 08:00:00", "2024-01-01 18:59:59", "2024-01-01 19:00:00", ""]) == [0, 0, 1, 1]


def test_relative_times(spark):
    now = datetime(2024, 1, 2, tzinfo=UTC)
    ages = [timedelta(seconds=-5), timedelta(seconds=59), timedelta(seconds=60), timedelta(hours=1), timedelta(hours=23, minutes=59), timedelta(days=3)]
    values = [(now - a).strftime("%Y-%m-%d %H:%M:%S") for a in ages] + [None]
    got = apply(spark, lambda c: clock.relative_time(c.cast("timestamp"), clock.lit_time(now)), values)
    assert got == ["just now", "just now", "1m ago", "1h ago", "23h ago", "3d ago", "—"]


def test_time_ranges_and_bounds():
    now = datetime(2024, 1, 31, tzinfo=UTC)
    assert clock.time_range(now) == (now - timedelta(hours=24), now)
    assert clock.time_range(now, "15m")[0] == now - timedelta(minutes=15)
    assert clock.time_range(now, "7d", "2024-01-01", "2024-01-02T00:00:00+02:00")[1] == datetime(2024, 1, 1, 22, tzinfo=UTC)
    for bad in (dict(quick="2h"), dict(start="x", end="y"), dict(start="2024-01-02", end="2024-01-02")):
        with pytest.raises(ValueError):
            clock.time_range(now, **bad)
    lo, hi = clock.bounds("2024-01-01T00:00:00", "2024-01-01 00:00:00")
    assert lo.microsecond == 0 and hi.microsecond == 999_999
    assert clock.bounds(None, "2024-01-01 00:00:00.5")[1].microsecond == 500_000
    for pair in (("2024-01-02 00:00:00", "2024-01-01 00:00:00"), ("2024-01-02", None)):
        with pytest.raises(ValueError):
            clock.bounds(*pair)
    spans = [(20, "1m"), (21, "5m"), (120, "5m"), (121, "30m"), (480, "30m"), (481, "1h"), (1800, "1h"), (1801, "6h"), (14400, "6h"), (14401, "1d")]
    assert [clock.timeline_step(now, now + timedelta(minutes=m))[0] for m, _ in spans] == [s for _, s in spans]


def test_quoting_matches_repr(spark):
    values = ["plain", "C:\\x", "it's", 'say "hi"', "both ' and \"", "line\nbreak\ttab"]
    assert apply(spark, lines.quote, values) == [repr(v) for v in values]


def test_json_text_that_is_not_whole_is_kept(spark):
    values = ['{"k": 1}', '{"k": 1} x', '"k": 1}', "", None, "[1]", "1,2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    value, left = lines.expand_json(F.col("v"), "$.k", "int")
    assert [tuple(r) for r in df.select(value, left).collect()] == [
        (1, None), (None, '{"k": 1} x'), (None, '"k": 1}'), (None, ""), (None, None), (None, None), (None, "1,2")]
