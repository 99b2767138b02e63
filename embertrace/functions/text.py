"""Text, path and number functions as Columns. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"
DASH = "—"  # shown where a value is missing


def basename(path: Column) -> Column:
    """Lower-case text after the last slash of either kind; a trailing slash leaves ''."""
    return F.lower(F.substring_index(F.replace(path, F.lit(BACKSLASH), F.lit("/")), "/", -1))


def win_name(path: Column) -> Column:
    """File name of a Windows path: drive, share and trailing slashes do not count; none is NULL."""
    p = F.translate(path, "/", BACKSLASH)
    p = F.regexp_replace(p, r"^\\\\[^\\]+\\[^\\]+", "")  # \\server\share
    p = F.regexp_replace(p, r"^[^\\]:", "")  # drive
    p = F.regexp_replace(p, r"(\\\.?)+$|^\.$", "")  # trailing slashes and single dots
    return F.nullif(F.substring_index(p, BACKSLASH, -1), F.lit(""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, base 2; 0.0 for NULL or ''.

    As log2(n) - sum(c * log2(c)) / n over the counts c. Each distinct character is counted with one
    native ``replace`` instead of a lambda per character pair, so long texts stay cheap.
    """
    n = F.char_length(text)
    counts = F.transform(
        F.array_distinct(F.split(text, "")), lambda ch: n - F.char_length(F.replace(text, ch, F.lit(""))))
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - weighted / n)).otherwise(F.lit(0.0))


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def to_int(text: Column) -> Column:
    """Decimal text to a whole number, NULL where it is not one."""
    ok = F.regexp_like(text, F.lit(r"^\s*[+-]?\d+(_\d+)*\s*$"))
    return F.when(ok, F.regexp_replace(text, r"[\s_]", "").try_cast("bigint"))


def to_bool(text: Column) -> Column:
    """``true`` / ``false`` in any case; anything else is NULL."""
    low = F.lower(text)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def _signed_digits(text: Column, prefix: str, base: int) -> Column:
    """Value of a guarded digit text. Masks are narrow, so the low 60 bits are enough."""
    keep = {16: 15, 8: 20, 2: 60}[base]
    digits = F.regexp_replace(F.trim(text), rf"^[+-]?{prefix}|_", "")
    value = F.conv(F.right(digits, F.lit(keep)), base, 10).try_cast("bigint")
    return F.when(F.startswith(F.trim(text), F.lit("-")), -value).otherwise(value)


def hex_value(text: Column) -> Column:
    """Hex text, ``0x`` optional; NULL where it is not hex. (``conv`` alone says 0 for those.)"""
    ok = F.regexp_like(text, F.lit(r"^\s*[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*\s*$"))
    return F.when(ok, _signed_digits(text, "(?:0[xX])?", 16))


def mask_value(text: Column) -> Column:
    """Access mask as prefixed hex, octal or binary text, or as decimal; else NULL."""
    t = F.trim(text)
    return (
        F.when(F.regexp_like(t, F.lit(r"^[+-]?0[xX](_?[0-9a-fA-F])+$")), _signed_digits(t, "0[xX]", 16))
        .when(F.regexp_like(t, F.lit(r"^[+-]?0[oO](_?[0-7])+$")), _signed_digits(t, "0[oO]", 8))
        .when(F.regexp_like(t, F.lit(r"^[+-]?0[bB](_?[01])+$")), _signed_digits(t, "0[bB]", 2))
        .when(F.regexp_like(t, F.lit(r"^[+-]?([1-9](_?[0-9])*|0(_?0)*)$")), to_int(t))
    )


def truncate(text: Column, length: int = 80) -> Column:
    return F.when(
        F.char_length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))
    ).otherwise(text)
