"""The same pipeline over a folder of XML in one batch."""

from __future__ import annotations

from pyspark.sql import SparkSession

from embertrace.sources.xml_events import read_xml_files, read_xml_lines
from embertrace.streaming.pipeline import TelemetryPipeline


def run_batch(spark: SparkSession, folder: str, pipeline: TelemetryPipeline, whole_files: bool = False, batch_id: int = 0, run: str | None = None) -> None:
    """One folder as one batch. Each call is a run of its own unless ``run`` names one, whose batch of that
    number is then replaced."""
    raw = read_xml_files(spark, folder, limit=None) if whole_files else read_xml_lines(spark, folder)
    pipeline.process(raw.select("xml"), batch_id, run)
