"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
from datetime import datetime, timezone

from embertrace.checks.registry import NOW, Tables
from embertrace.checks.model_checks import KEYS
from embertrace.functions.clock import time_range
from embertrace.models.iforest import IsolationForest
from embertrace.models.scoring import score_events
from embertrace.operators import killchain, metrics, tables, tree
from embertrace.operators.corroborate import findings
from embertrace.operators.detect import detect
from embertrace.operators.features import event_vectors, window_features, window_features_live
from embertrace.operators.search import Fields, search
from embertrace.session import build
from embertrace.sources.stored import event_rows
from embertrace.sources.xml_events import accepted, parse

REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build(os.environ.get("BENCH_CPUS", "8"))
    t = Tables(spark, sf_dir)
    for name in ("telemetry", "hits", "alerts", "scores"):  # written once, outside the timings
        getattr(t, name)
    month, fields = time_range(NOW, "30d"), Fields("alerts")
    forest = IsolationForest.fit(window_features_live(t.telemetry), KEYS)
    raw = f"{spark.conf.get('spark.checkpoint.dir')}/bench-xml-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
    from embertrace.sources.xml_events import render

    render(t.telemetry).select("xml").write.parquet(raw)
    mapping = killchain.tactic_map(killchain.rules_frame(spark))
    queries = {
        "detect": lambda: detect(t.telemetry),
        "flagship_top_rules": lambda: metrics.top_rules(detect(t.telemetry), *month),
        "normalise_xml": lambda: accepted(parse(spark.read.parquet(raw))),
        "event_rows": lambda: event_rows(t.telemetry),
        "event_vectors": lambda: event_vectors(t.telemetry),
        "window_features": lambda: window_features(t.telemetry, t.hits),
        "window_features_live": lambda: window_features_live(t.telemetry),
        "search_page": lambda: search(
            {"alerts": t.alerts}, "alerts", fields.plain("process_image", "system32") & ~fields.plain("severity", "low"), *month).items,
        "stats": lambda: metrics.stats(t.alerts, t.telemetry.withColumnRenamed("event_time", "timestamp"), t.hits, *month),
        "timeline": lambda: metrics.timeline(t.alerts, *month),
        "tactic_status": lambda: killchain.tactic_status(t.hits, mapping, *month),
        "score_summary": lambda: metrics.score_summary(t.scores),
        "process_tree": lambda: tree.edges(tree.nodes(t.telemetry, *month)),
        "findings": lambda: findings(t.telemetry, t.hits),
        "orphans": lambda: tables.orphans(t.scores, t.telemetry),
        "forest_score_events": lambda: score_events(t.telemetry, forest),
    }
    seconds = {}
    for name, make in queries.items():
        make().write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    events = t.telemetry.count()
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "events": events,
        "events_per_second_detect": round(events / seconds["detect"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
