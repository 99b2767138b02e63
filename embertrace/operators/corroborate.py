"""Corroboration: decoded commands and known hashes. It enriches hits and never makes one."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.operators.alerts import process_image
from embertrace.operators.detect import fired_rule_ids, with_masks
from embertrace.rules import Rule, catalogue

# What to look for in a decoded command, and the name reported for it.
INDICATORS = [
    ("DownloadString", "decoded:download-cradle:DownloadString"),
    ("DownloadFile", "decoded:download-cradle:DownloadFile"),
    ("WebClient", "decoded:download-cradle:WebClient"),
    ("Invoke-WebRequest", "decoded:download-cradle:Invoke-WebRequest"),
    (r"iwr\s", "decoded:download-cradle:iwr"),
    (r"curl\s", "decoded:download-cradle:curl"),
    (r"wget\s", "decoded:download-cradle:wget"),
    ("amsiInitFailed", "decoded:amsi-bypass:amsiInitFailed"),
    ("AmsiScanBuffer", "decoded:amsi-bypass:AmsiScanBuffer"),
    ("AmsiUtils", "decoded:amsi-bypass:AmsiUtils"),
    (r"amsi\.dll", "decoded:amsi-bypass:amsi.dll"),
    ("Invoke-Expression", "decoded:execution:Invoke-Expression"),
    (r"\biex\b", "decoded:execution:IEX"),
    (r"\[char\]", "decoded:obfuscation:char-cast"),
    ("-join", "decoded:obfuscation:join"),
    ("FromBase64String", "decoded:obfuscation:nested-base64"),
    ("lsass", "decoded:credential-target:lsass"),
    ("sekurlsa", "decoded:credential-target:sekurlsa"),
    ("mimikatz", "decoded:credential-target:mimikatz"),
    (r"-ExecutionPolicy\s+Bypass", "decoded:bypass:execution-policy"),
    ("-NonInteractive", "decoded:bypass:non-interactive"),
]
# SHA-256 digest and family.
KNOWN_HASHES = [
    ("61c0810a23580cf492a6ba4f7654566108331e7a4134c968c2d6a05261b2d8a1", "Mimikatz-2.2.0"),
    ("f73af5d2a8f8f6c4f4f5b6e2c9b7d3e1a2c4f6b8d0e2a4c6e8f0b2d4f6a8c0e2", "PowerSploit-Invoke-Mimikatz"),
    ("a3b5c7d9e1f3a5b7c9d1e3f5a7b9c1d3e5f7a9b1c3d5e7f9a1b3c5d7e9f1a3b5", "CobaltStrike-Beacon-Stager"),
]
FLAG = r"(?i)(?:-EncodedCommand|-enc|-ec)\s+([A-Za-z0-9+/=]+)"


# A text of whole code units, each byte one character, with no surrogate that lacks its partner. The possessive
# loop goes once over it.
PAIRED = r"(?s)\A(?:.[^\xD8-\xDF]|.[\xD8-\xDB].[\xDC-\xDF])*+\z"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _utf16(raw: Column) -> Column:
    """Bytes of whole UTF-16LE code units as text; surrogates without a partner become U+FFFD."""

    def mended(raw: Column) -> Column:
        units = F.regexp_replace(F.hex(raw), "(.{4})", "$1 ")  # one code unit each, low byte first
        units = F.regexp_replace(units, "..D[89AB] (?!..D[C-F])", "FDFF ")
        units = F.regexp_replace(units, "(?<!..D[89AB] )..D[C-F] ", "FDFF ")
        return F.unhex(F.replace(units, F.lit(" "), F.lit("")))

    paired = F.rlike(F.decode(raw, "ISO-8859-1"), F.lit(PAIRED))
    return F.decode(F.when(paired, raw).otherwise(mended(raw)), "UTF-16LE")


def decode_command(command: Column) -> Column:
    """The Base64 UTF-16LE text after an encoded-command flag; NULL if there is none to decode.

    Half a character at the end, and surrogates without a partner, become U+FFFD.
    """

    def of_bytes(raw: Column) -> Column:
        size = F.octet_length(raw)
        whole = F.when(size % 2 == 0, _utf16(raw)).otherwise(F.concat(_utf16(F.substring(raw, F.lit(1), size - 1)), F.lit("�")))
        return _let(whole, lambda text: F.nullif(text, F.lit("")))

    def of_parts(body: Column, text: Column) -> Column:
        length = F.char_length(body)
        need = F.pmod(-length, F.lit(4))
        # the body is followed by "=" or by nothing: "=" that a letter follows are its pads all the same
        pads = F.char_length(F.regexp_extract(F.substring(text, length + 1, F.lit(3)), "^=*", 0))
        complete = (need != 3) & (pads >= need) & (length > 0)
        return F.when(complete, _let(F.try_to_binary(F.concat(body, F.repeat(F.lit("="), need)), F.lit("base64")), of_bytes))

    def of_text(text: Column) -> Column:
        return F.when(text != "", _let(F.regexp_extract(text, "^[A-Za-z0-9+/]*", 0), lambda body: of_parts(body, text)))

    return _let(F.regexp_extract(command, FLAG, 1), of_text)


# What a pattern cannot match without, in lower case: looked for first, as bytes.
_needed = lambda p: re.split(r"\\s|\\b", p.removeprefix(r"\b"))[0].replace("\\", "").lower()


def indicators(decoded: Column) -> Column:
    """Names of all patterns found, in list order; empty for NULL."""

    def named(text: Column, low: Column) -> Column:
        found = F.array(*[F.when(F.contains(low, F.lit(_needed(p))) & F.rlike(text, F.lit("(?id)" + p)), F.lit(n)) for p, n in INDICATORS])
        return F.filter(found, lambda n: n.isNotNull())

    return _let(decoded, lambda text: _let(F.lower(text), lambda low: named(text, low)))


def hash_families(hashes: Column) -> Column:
    """Families whose digest occurs in the hash text, by the fixed list."""
    low = F.lower(hashes)
    found = F.array(*[F.when(F.contains(low, F.lit(h)), F.lit(n)) for h, n in KNOWN_HASHES])
    return F.filter(found, lambda n: n.isNotNull())


def hash_matches(events: DataFrame, known: DataFrame) -> DataFrame:
    """(id, family) against a table of digests (sha256, family) of any size.

    Every 64-character window of a hex run is a candidate, so a digest matches wherever it occurs.
    Spark broadcasts ``known`` only if it is small.
    """
    runs = events.filter(F.col("hashes").isNotNull()).select(
        "id", F.explode(F.regexp_extract_all(F.lower("hashes"), F.lit("([0-9a-f]{64,})"))).alias("run"))
    windows = runs.select("id", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("run") - 63), lambda i: F.substr("run", i, F.lit(64)))).alias("sha256"))
    return windows.join(known.select(F.lower("sha256").alias("sha256"), "family"), "sha256").select("id", "family").distinct()


def _found(events: DataFrame) -> DataFrame:
    """Events with a finding, ``_image``, ``_payload`` and the struct ``_found`` of indicators and families."""
    decoded = events.withColumns({
        "_image": F.coalesce(process_image(), F.lit("N/A")), "_payload": decode_command(F.col("command_line"))})
    # one array column holds both lists, so each pattern is tested once per row
    listed = decoded.select("*", F.explode_outer(F.array(F.struct(
        indicators(F.col("_payload")).alias("indicators"),
        F.coalesce(hash_families(F.col("hashes")), F.array().cast("array<string>")).alias("families"),
    ))).alias("_found"))
    return listed.filter((F.size("_found.indicators") > 0) | (F.size("_found.families") > 0))


def _finding_columns() -> list[Column]:
    return [
        F.col("id"), F.col("_image").alias("image"), F.col("_payload").alias("decoded_payload"),
        F.col("_found.indicators").alias("decoded_indicators"), F.col("_found.families").alias("hash_matches")]


def corroborate(events: DataFrame) -> DataFrame:
    """id, image, decoded payload, indicator names, hash families for events with a finding."""
    return _found(events).select(*_finding_columns())


def findings(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Findings with the rules that fired on the same event; none makes the finding standalone."""
    rules = hits.groupBy("event_fk").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    out = corroborate(events).join(rules, F.col("id") == F.col("event_fk"), "left").drop("event_fk")
    ids = F.coalesce("rule_ids", F.array().cast("array<string>"))
    return out.withColumns({"rule_ids": ids, "standalone": F.size(ids) == 0})


def findings_detected(events: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The same findings without stored hits: rules are tested on the few events with a finding, so nothing is
    joined or shuffled."""
    rules = catalogue() if rules is None else list(rules)
    masked = with_masks(_found(events), rules)
    out = masked.select(*_finding_columns(), fired_rule_ids(rules).alias("rule_ids"))
    return out.withColumn("standalone", F.size("rule_ids") == 0)
