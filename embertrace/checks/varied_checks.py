"""Scalar functions on inputs that vary with every row, so that no list of answers could stand for them."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import functions as F

from embertrace.checks.oracle import with_tel
from embertrace.checks.registry import Tables, query
from embertrace.functions import net, text
from embertrace.operators.corroborate import INDICATORS, decode_command, indicators
from embertrace.plans.telemetry import sql_text

# One phrase in every third text, by turns; the last two only look like indicators.
PHRASES = [
    "Net.WebClient downloadstring", "IWR http", "curl -o", "amsi.dll", "[CHAR]65", "a -join b", "iex $x", "-executionpolicy  bypass",
    "sekurlsa::mimikatz", "frombase64string", "curly", "amsiXdll"]
_PHRASES_SQL = ", ".join(sql_text(p) for p in PHRASES)
_PLANTED_SQL = f"text || CASE WHEN doc_id % 3 = 0 THEN ' ' || ([{_PHRASES_SQL}])[doc_id // 3 % {len(PHRASES)} + 1] ELSE '' END"


def _commands(t: Tables):
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    planted = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.get(
        phrases, (F.floor(F.col("doc_id") / 3) % len(PHRASES)).cast("int")))).otherwise(F.lit("")))
    encoded = F.replace(F.base64(F.encode(planted, "UTF-16LE")), F.lit("\r\n"), F.lit(""))
    return t.given("documents").select("doc_id", F.concat(F.lit("powershell.exe -nop -EncodedCommand "), encoded).alias("command"))


@query("c_decode_texts", f"SELECT doc_id, nullif({_PLANTED_SQL}, '') AS decoded FROM documents")
def c_decode_texts(t: Tables):
    """Every document as an encoded command, decoded again."""
    return _commands(t).select("doc_id", decode_command(F.col("command")).alias("decoded"))


@query("c_indicator_texts", f"""
SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(planted, {sql_text(p)}, 'i') THEN {sql_text(n)} END" for p, n in INDICATORS)}) AS found
FROM (SELECT doc_id, {_PLANTED_SQL} AS planted FROM documents)""")
def c_indicator_texts(t: Tables):
    """Indicators of every document that is hidden in an encoded command."""
    decoded = _commands(t).select("doc_id", decode_command(F.col("command")).alias("decoded"))
    return decoded.select("doc_id", indicators(F.col("decoded")).alias("found"))


@query("fn_mask_numbers", with_tel("SELECT id, id * 7919 % 4294967296 AS mask, id * 7919 % 4294967296 AS hex FROM tel"))
def fn_mask_numbers(t: Tables):
    """Numbers written as prefixed hex, octal, binary or decimal text, and as bare hex, read again."""
    n = F.col("id") * 7919 % 4294967296
    written = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit(" 0X"), F.lower(F.hex(n)))).when(F.col("id") % 4 == 1, F.concat(F.lit("0o"), F.conv(n.cast("string"), 10, 8)))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("0b"), F.bin(n))).otherwise(n.cast("string")))
    return t.telemetry.select("id", text.mask_value(written).alias("mask"), text.hex_value(F.hex(n)).alias("hex"))


def _first_and_size(block: str) -> tuple[str, str]:
    """A block of addresses as two SQL terms."""
    address, length = block.split("/")
    a, b, c, d = address.split(".")
    return f"({a} * 16777216::BIGINT + {b} * 65536 + {c} * 256 + {d})", f"(1::BIGINT << {32 - int(length)})"


_BLOCKS = [_first_and_size(b) for b in net.PRIVATE_V4]
_PUBLIC = [_first_and_size(b) for b in net.PUBLIC_V4]
_inside = lambda blocks: "(" + " OR ".join(f"n >= {a} AND n < {a} + {s}" for a, s in blocks) + ")"


_EDGES = [int(ip) for b in net.PRIVATE_V4 for ip in (ip_network(b).network_address, ip_network(b).broadcast_address)]
_EDGES_SQL = ", ".join(map(str, _EDGES))


@query("fn_ip_numbers", with_tel(f"""
SELECT id, CAST(NOT {_inside(_BLOCKS)} OR {_inside(_PUBLIC)} AS BIGINT) AS external
FROM (SELECT id, CASE WHEN id % 2 = 0 THEN id * 2654435761 % 4294967296
  ELSE (([{_EDGES_SQL}]::BIGINT[])[id // 2 % {len(_EDGES)} + 1] + id // {2 * len(_EDGES)} % 5 - 2 + 4294967296) % 4294967296 END AS n FROM tel)"""))
def fn_ip_numbers(t: Tables):
    """Addresses made from ids: random ones, and those within two of the ends of a reserved block."""
    at = F.col("id")
    edge = F.get(F.array(*[F.lit(e).cast("bigint") for e in _EDGES]), (F.floor(at / 2) % len(_EDGES)).cast("int"))
    near = (edge + F.floor(at / (2 * len(_EDGES))) % 5 - 2 + 4294967296) % 4294967296
    n = F.when(at % 2 == 0, at * 2654435761 % 4294967296).otherwise(near)
    octets = [F.shiftright("n", s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return t.telemetry.select("id", n.cast("bigint").alias("n")).select("id", net.is_external(F.concat_ws(".", *octets)).alias("external"))
