"""Corroboration and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embertrace.checks.feature_checks import windowed_sql
from embertrace.checks.oracle import with_hits, with_tel, with_xml
from embertrace.checks.registry import Tables, query
from embertrace.operators.corroborate import (
    KNOWN_HASHES, decode_command, findings, findings_detected, hash_families, hash_matches, indicators)
from embertrace.operators.tables import event_image, event_pid
from embertrace.plans.batch import run_batch
from embertrace.plans.telemetry import COMMANDS, DIGESTS, DUMP_SCRIPT, PLAIN_SCRIPT, sql_text
from embertrace.session import shared_dir
from embertrace.sources import directory
from embertrace.sources.xml_events import render, stream_xml
from embertrace.streaming.compaction import vacuum
from embertrace.streaming.pipeline import TelemetryPipeline
from embertrace.streaming.windowed import windowed_features

# What each encoded command of the derived telemetry decodes to ("QUJD" is three bytes: a
# character and a half).
DECODED = {COMMANDS[1]: PLAIN_SCRIPT, COMMANDS[9]: DUMP_SCRIPT, COMMANDS[14]: "䉁�"}
FOUND = {
    COMMANDS[1]: "decoded:download-cradle:DownloadString,decoded:download-cradle:WebClient,decoded:execution:IEX",
    COMMANDS[9]: "decoded:amsi-bypass:amsi.dll,decoded:obfuscation:char-cast,decoded:obfuscation:join,"
                 "decoded:credential-target:lsass,decoded:credential-target:sekurlsa",
}
FAMILIES = {DIGESTS[1]: "Mimikatz-2.2.0", DIGESTS[3]: "CobaltStrike-Beacon-Stager"}


def _case(column: str, table: dict, default: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in table.items()) + f" ELSE {default} END"


@query("c_decode", with_tel(f"SELECT id, {_case('command_line', DECODED, 'NULL')} AS decoded FROM tel WHERE event_type_id = 1"))
def c_decode(t: Tables):
    return t.telemetry.filter("event_type_id = 1").select("id", decode_command(F.col("command_line")).alias("decoded"))


@query("c_indicators", with_tel(f"SELECT id, {_case('command_line', FOUND, repr(''))} AS found FROM tel WHERE event_type_id = 1"))
def c_indicators(t: Tables):
    decoded = t.telemetry.filter("event_type_id = 1").select("id", decode_command(F.col("command_line")).alias("d"))
    return decoded.select("id", indicators(F.col("d")).alias("found"))


@query("c_hash", with_tel(f"SELECT id, {_case('hashes', FAMILIES, repr(''))} AS families FROM tel"))
def c_hash(t: Tables):
    return t.telemetry.select("id", hash_families(F.col("hashes")).alias("families"))


@query("c_hash_table", with_tel(f"SELECT id, {_case('hashes', FAMILIES, 'NULL')} AS family FROM tel WHERE hashes IN ({', '.join(map(sql_text, FAMILIES))})"))
def c_hash_table(t: Tables):
    """The same matches against a table of digests."""
    known = t.spark.createDataFrame(KNOWN_HASHES, "sha256 string, family string")
    return hash_matches(t.telemetry, known)


FINDINGS_SQL = with_hits(f"""
, marked AS (SELECT id, coalesce(image, 'N/A') AS image, {_case('command_line', DECODED, 'NULL')} AS decoded_payload,
  {_case('command_line', FOUND, repr(''))} AS decoded_indicators, {_case('hashes', FAMILIES, repr(''))} AS hash_matches FROM tel)
SELECT m.id, m.image, m.decoded_payload, m.decoded_indicators, m.hash_matches,
  coalesce(string_agg(h.rule_id, ',' ORDER BY h.rule_id), '') AS rule_ids, CAST(count(h.id) = 0 AS BIGINT) AS standalone
FROM marked m LEFT JOIN hits h ON h.event_fk = m.id
WHERE m.decoded_indicators <> '' OR m.hash_matches <> '' GROUP BY 1, 2, 3, 4, 5""")


@query("c_findings", FINDINGS_SQL)
def c_findings(t: Tables):
    return findings(t.telemetry, t.hits)


@query("c_findings_live", FINDINGS_SQL)
def c_findings_live(t: Tables):
    """The same findings from events and rules alone."""
    return findings_detected(t.telemetry)


# --- streaming ------------------------------------------------------------------------------

FILE_ROWS = 50_000  # texts of a compressed file: it is not cut when read, and a task takes as many files as fit

STREAMED_HITS = with_xml("""
SELECT h.rule_id, h.severity, epoch_us(h.timestamp) AS timestamp, e.pid FROM hits h JOIN events_t e ON h.event_fk = e.id
WHERE e.pid IS NOT NULL""")


def _stream(t: Tables):
    """Events as XML files, followed by the pipeline until they are used up."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    _xml_text(t).select("value").write.text(f"{base}/in")
    pipeline = TelemetryPipeline(f"{base}/out")
    pipeline.start(stream_xml(t.spark, f"{base}/in"), f"{base}/checkpoint", once=True).awaitTermination()
    return pipeline


def _hits_of(t: Tables, pipeline: TelemetryPipeline):
    hits, alerts = pipeline.table(t.spark, "hits"), pipeline.table(t.spark, "alerts")
    pids = alerts.select(F.col("rule_hit_fk").alias("id"), F.col("process_pid").alias("pid"))
    return hits.join(pids, "id").select("rule_id", "severity", "timestamp", "pid")


def _xml_text(t: Tables):
    return render(t.telemetry).select(F.col("xml").alias("value"), "id")


@query("src_xml_batch", STREAMED_HITS)
def src_xml_batch(t: Tables):
    """A folder of files through the directory source in two fetches, oldest files first."""
    base = f"{shared_dir(t.spark)}/batch-{uuid.uuid4().hex}"
    _xml_text(t).select("value").repartition(7).write.text(f"{base}/in")
    pipeline, position = TelemetryPipeline(f"{base}/out"), None
    for number, limit in enumerate((3, None)):
        raw, position = directory.fetch(t.spark, f"{base}/in", position, limit, ".txt")
        pipeline.process(raw.select("xml"), number, "fetches")
    return _hits_of(t, pipeline)


@query("src_xml_stream", with_xml("""
SELECT event_type_id, epoch_us(timestamp) AS event_time, pid, image FROM events_t WHERE pid IS NOT NULL"""))
def src_xml_stream(t: Tables):
    """The records a stream of XML files leaves."""
    records = _stream(t).table(t.spark, "records")
    return records.select("event_type_id", "event_time", event_pid().alias("pid"), event_image().alias("image"))


@query("st_checkpoint", STREAMED_HITS)
def st_checkpoint(t: Tables):
    """Half the files, a stop, the rest: the restarted query reads only what is new."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    pipeline, xml = TelemetryPipeline(f"{base}/out"), _xml_text(t)
    for part in (0, 1):
        xml.filter(F.col("id") % 2 == part).select("value").write.mode("append").text(f"{base}/in")
        pipeline.start(stream_xml(t.spark, f"{base}/in"), f"{base}/checkpoint", once=True).awaitTermination()
    return _hits_of(t, pipeline)


@query("st_pipeline", STREAMED_HITS)
def st_pipeline(t: Tables):
    return _hits_of(t, _stream(t))


@query("st_idempotent", STREAMED_HITS)
def st_idempotent(t: Tables):
    """Half of the events, the same files again under another checkpoint, then all of them in one batch:
    nothing is lost and nothing is stored twice."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    pipeline, xml = TelemetryPipeline(f"{base}/out"), _xml_text(t)
    xml.filter("id % 2 = 0").select("value").write.text(f"{base}/half")
    xml.select("value").write.text(f"{base}/all")
    for checkpoint in ("one", "two"):
        pipeline.start(stream_xml(t.spark, f"{base}/half"), f"{base}/{checkpoint}", once=True).awaitTermination()
    run_batch(t.spark, f"{base}/all", pipeline)
    return _hits_of(t, pipeline)


@query("st_compacted", STREAMED_HITS)
def st_compacted(t: Tables):
    """Some batches, a compaction, a replay of a merged batch, the rest, another compaction and a clearing of
    what is merged: every event is there once."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    pipeline, xml = TelemetryPipeline(f"{base}/out"), _xml_text(t)
    for part in range(4):  # each text is written once, and a batch reads the folders up to its own
        rows = xml.filter(f"id % 4 {'=' if part else '<='} {part}").select("value")
        rows.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(f"{base}/in-{part}")
    for parts in ((0, 1, 1), (0, 2, 3)):  # a number that comes again is a replay, merged or not
        for part in parts:
            run_batch(t.spark, f"{base}/in-[0-{part}]", pipeline, batch_id=part, run="parts")
        pipeline.compact(t.spark)
    vacuum(t.spark, pipeline.out)
    return _hits_of(t, pipeline)


@query("st_isolation", with_xml("""
SELECT 'records' AS table_name, count(*) AS n FROM events_t WHERE pid IS NOT NULL
UNION ALL SELECT 'rejects', count(*) FROM events_t WHERE pid IS NULL"""))
def st_isolation(t: Tables):
    """Unusable rows end in the reject table; none is lost and none stops the stream."""
    pipeline = _stream(t)
    counts = [
        pipeline.table(t.spark, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
        for n in ("records", "rejects")]
    return counts[0].unionByName(counts[1])


@query("st_windowed_features", windowed_sql())
def st_windowed_features(t: Tables):
    return windowed_features(t.telemetry)
