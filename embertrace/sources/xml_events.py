"""Event XML in, typed records out; batch and stream share everything after the read.

Many events per file (one per line) is the form that scales. One event per file works too, but a
task then opens a file per event.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions.clock import event_time, lit_time
from embertrace.functions.text import to_bool, to_int
from embertrace.schema import (
    BLANK_FIELDS, BOOL_FIELDS, COMMON_FIELDS, EVENT_FIELDS, EVENT_TYPE_IDS, INT_FIELDS, RECORD_FIELDS,
    REQUIRED_FIELDS, xml_name,
)

FILES_PER_FETCH = 100  # fixed value: most files taken by one fetch
POLL = "2 seconds"  # fixed value: time between fetches

DOCUMENT = (
    "System struct<EventID: struct<_VALUE: string>, TimeCreated: struct<_SystemTime: string>, "
    "Computer: string>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)


# --- reading --------------------------------------------------------------------------------

def _plain_path(path: Column | str) -> Column:
    """Spark names a local file ``file:/x`` in one place and ``file:///x`` in another."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def list_xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and modification times of the folder's XML files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(folder)
    return files.select(_plain_path("path").alias("path"), F.col("modificationTime").alias("modified"))


def read_xml_files(
    spark: SparkSession, folder: str, seen: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """(path, xml) of the oldest ``limit`` files not in ``seen`` (a frame of ``path``), one event
    per file; without a limit all of them."""
    source: str | list[str] = folder
    if limit is not None:
        files = list_xml_files(spark, folder)
        if seen is not None:
            files = files.join(seen.select("path"), "path", "left_anti")
        source = [r.path for r in files.orderBy("modified", "path").limit(limit).select("path").collect()]
        if not source:
            return spark.createDataFrame([], "path string, xml string")
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.[xX][mM][lL]")
    texts = reader.text(source).select(_plain_path("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return texts if limit is not None or seen is None else texts.join(seen.select("path"), "path", "left_anti")


def read_xml_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One event per line: (path, xml). Files split across tasks."""
    text = spark.read.text(folder).filter(F.trim("value") != "")
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def stream_xml(
    spark: SparkSession, folder: str, whole_files: bool = False, files_per_trigger: int = FILES_PER_FETCH,
) -> DataFrame:
    """New files of a folder as a stream; the query's checkpoint remembers what was read."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if whole_files:
        reader = reader.option("wholetext", True).option("pathGlobFilter", "*.[xX][mM][lL]")
    return reader.text(folder).filter(F.trim("value") != "").select(F.col("value").alias("xml"))


# --- normalising ----------------------------------------------------------------------------

def parse(raw: DataFrame, now: datetime | None = None) -> DataFrame:
    """Raw XML to wide records plus ``reject_reason`` (NULL for a usable row) and the ``xml``.

    ``now`` replaces an unusable event time. The document is parsed once: ``explode_outer`` keeps
    later filters from being pushed below it and repeating the parse.
    """
    text = F.regexp_replace("xml", "^﻿", "")
    options = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "attributePrefix": "_", "valueTag": "_VALUE"}
    doc = F.from_xml(text, DOCUMENT, options)
    docs = raw.select("xml", F.explode_outer(F.array(doc)).alias("d")).select(
        "xml",
        to_int(F.col("d.System.EventID._VALUE")).cast("int").alias("event_type_id"),
        F.col("d.System.TimeCreated._SystemTime").alias("utc_time"),
        F.coalesce("d.System.Computer", F.lit("")).alias("computer"),
        F.col("d.EventData.Data._Name").alias("names"),
        F.col("d.EventData.Data._VALUE").alias("texts"),
    )
    eid = F.col("event_type_id")

    def field(name: str) -> Column:
        """First Data of that name, for the event types that have the field."""
        text = F.nullif(F.get("texts", F.array_position("names", F.lit(xml_name(name))) - 1), F.lit(""))
        value = to_int(text) if name in INT_FIELDS else to_bool(text) if name in BOOL_FIELDS else text
        if name in BLANK_FIELDS:
            value = F.coalesce(value, F.lit(""))
        return F.when(eid.isin([e for e, fields in EVENT_FIELDS.items() if name in fields]), value)

    records = docs.select(
        F.md5("xml").alias("id"), eid,
        event_time(F.col("utc_time"), None if now is None else lit_time(now)).alias("event_time"),
        "computer", *[field(f).alias(f) for f in RECORD_FIELDS], "xml",
        # a higher-order function keeps this wide projection out of one oversized fused method
        F.exists(F.array(eid), lambda t: t.isin(EVENT_TYPE_IDS)).alias("_known"))
    lacks_pid = F.lit(False)
    for e, fields in REQUIRED_FIELDS.items():
        for f in fields:
            lacks_pid = lacks_pid | ((eid == e) & F.col(f).isNull())
    reason = (
        F.when(eid.isNull(), "malformed")
        .when(~F.col("_known"), "event type")
        .when(lacks_pid, "process id")
    )
    return records.withColumn("reject_reason", reason).drop("_known")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select(*COMMON_FIELDS, *RECORD_FIELDS)


def rejected(parsed: DataFrame) -> DataFrame:
    """Dropped rows with the reason and their text."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select("id", "event_type_id", "reject_reason", "xml")


def keep_known_types(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type_id").isin(EVENT_TYPE_IDS))


# --- the reverse, for replay and tests ------------------------------------------------------

def _escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def render(events: DataFrame) -> DataFrame:
    """Wide records back to event XML, one document per row in ``xml``."""
    parts = []
    for f in RECORD_FIELDS:
        body = _escape(F.col(f).cast("string"))
        parts.append(F.concat(F.lit(f"<Data Name='{xml_name(f)}'>"), body, F.lit("</Data>")))
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    head = F.concat(
        F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>"),
        F.col("event_type_id").cast("string"), F.lit("</EventID><TimeCreated SystemTime='"), stamp,
        F.lit("0Z'/><EventRecordID>"), F.col("id").cast("string"), F.lit("</EventRecordID><Computer>"),
        _escape(F.col("computer")), F.lit("</Computer></System><EventData>"))
    return events.select(F.concat(head, F.concat_ws("", *parts), F.lit("</EventData></Event>")).alias("xml"), "id")
