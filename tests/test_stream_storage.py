"""The id index, compaction and the directory source."""

import os
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from embertrace.plans.batch import run_batch
from embertrace.sources import directory
from embertrace.sources.id_index import IdIndex, by_hash, by_time
from embertrace.streaming import compaction
from embertrace.streaming.pipeline import TelemetryPipeline
from test_pipeline import document

T = datetime(2024, 1, 10, tzinfo=timezone.utc)


def test_a_live_batch_opens_no_more_files_as_batches_grow(spark, tmp_path):
    index, opened = IdIndex(str(tmp_path / "index")), []
    for n in range(12):
        rows = spark.createDataFrame([(f"id {n} {k}", T + timedelta(seconds=2 * n + k)) for k in range(3)], "id string, event_time timestamp").coalesce(1)
        known = index.known(by_time(rows, "event_time"), [])
        opened.append(0 if known is None else len(known.inputFiles()))
        assert known is None or known.join(rows.select("id"), "id").count() == 0
        index.add(by_time(rows, "event_time"), n, "live")
    assert opened[0] == 0 and max(opened) <= 1  # each batch's last second is the next one's first
    whole = spark.createDataFrame([("id 4 1", T + timedelta(seconds=9)), ("new", T + timedelta(days=1))], "id string, event_time timestamp")
    found = lambda *unfinished: {r.id for r in index.known(by_time(whole, "event_time"), list(unfinished)).join(whole.select("id"), "id").collect()}
    assert found() == {"id 4 1"} and index.known(by_time(whole.limit(0), "event_time"), []) is None
    none_left = index.known(by_time(whole, "event_time"), [("live", 4)])
    assert none_left is None or none_left.filter("id = 'id 4 1'").count() == 0
    # Merging leaves the ids of batches that may be done again, and finds the same.
    assert index.compact(spark, lambda run, batch: batch != 3) == 1
    assert found() == {"id 4 1"} and len(list((tmp_path / "index").glob("part=*/run=*/batch_id=*"))) == 2
    index.add(by_time(rows, "event_time").limit(1), 3, "live")  # a batch that is done again replaces what it stored
    gone = spark.createDataFrame([("id 3 0", T + timedelta(seconds=6))], "id string, event_time timestamp")
    left = index.known(by_time(gone, "event_time"), [])
    assert left is None or left.join(gone.select("id"), "id").count() == 0


def test_rows_without_time_lie_in_hash_buckets(spark, tmp_path):
    index = IdIndex(str(tmp_path / "index"))
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"))
    index.add(by_hash(rows), 0, "r")
    few = rows.filter("id IN ('7', '8')")
    assert {r.id for r in index.known(by_hash(few), []).join(few, "id").collect()} == {"7", "8"}
    assert index.known(by_hash(few), []).count() <= 200


def write_events(folder, numbers):
    folder.mkdir()
    for n in numbers:
        stamp = f"2024-01-{10 + n % 3:02d}T00:00:{n:02d}Z"
        (folder / f"{n}.xml").write_text(document(1, [("ProcessId", str(n)), ("Image", "C:\\mshta.exe"), ("ParentImage", "C:\\winword.exe")], time=stamp))


def test_compaction_keeps_every_event_once(spark, tmp_path):
    pipeline = TelemetryPipeline(str(tmp_path / "out"))
    folders = []
    for k in range(3):
        write_events(tmp_path / f"in{k}", range(4 * k, 4 * k + 4))
        folders.append(str(tmp_path / f"in{k}"))
    batch = lambda k: run_batch(spark, folders[k], pipeline, whole_files=True, batch_id=k, run="r")
    rows = lambda name: sorted((r.process_id if name == "records" else r.id) for r in pipeline.table(spark, name).collect())
    batch(0), batch(1)
    before = {name: rows(name) for name in ("records", "events", "hits", "alerts")}
    columns = set(pipeline.table(spark, "hits").columns)
    reading = pipeline.table(spark, "records")  # begun before the compaction
    manifest = pipeline.compact(spark)
    assert manifest.version == 1 and manifest.covered == {"r": [[0, 1]]} and len(manifest.segments) == 1
    assert {name: rows(name) for name in before} == before and set(pipeline.table(spark, "hits").columns) == columns
    assert reading.count() == 8 and pipeline.compact(spark).version == 1
    assert (tmp_path / "out" / "segments" / manifest.segments[0].rsplit("/", 1)[1] / "hits" / "event_date=2024-01-10").exists()
    batch(1), batch(2)  # a merged batch that comes again is done already
    assert rows("records") == list(range(12))
    days = date(2024, 1, 11), date(2024, 1, 11)
    assert sorted(r.process_id for r in pipeline.table(spark, "records", days).collect()) == [1, 4, 7, 10]
    assert pipeline.compact(spark, least=1).covered == {"r": [[0, 2]]} and rows("records") == list(range(12))
    assert compaction.vacuum(spark, pipeline.out) > 0 and rows("records") == list(range(12))
    run_batch(spark, folders[0], pipeline, whole_files=True, run="again")  # its ids are known although its folders are gone
    assert rows("records") == list(range(12))
    with pytest.raises(FileExistsError):
        compaction.write_new(spark, f"{pipeline.out}/manifests/{compaction.current(spark, pipeline.out).version:08d}.json", "{}")


def test_manifest_ranges():
    manifest = compaction.Manifest(covered={"a": [[0, 2]]})
    assert manifest.with_batches([("a", 4), ("a", 3), ("b", 7)]) == {"a": [[0, 4]], "b": [[7, 7]]}
    assert manifest.covers("a", 1) and not manifest.covers("a", 3) and not manifest.covers("c", 0)


def test_a_piece_of_a_file_holds_its_own_lines(tmp_path):
    from pyarrow import fs

    text = "\ufeffé1\n\n \nzwei 測試\r\n" + "long " * 40 + "\nlast"
    data = text.encode()
    (tmp_path / "a.xml").write_bytes(data)
    (tmp_path / "ended.xml").write_bytes(data + b"\n")
    store = fs.LocalFileSystem()
    for name, content in (("a.xml", data), ("ended.xml", data + b"\n")):
        whole = [line for line in content.split(b"\n")]
        whole = whole[:-1] if whole[-1] == b"" else whole
        for size in (1, 2, 3, 7, 50, 1000):
            for block in (1, 4, 1000):
                starts = range(0, len(content), size)
                got = [x for s in starts for lines in directory.lines_of(store, str(tmp_path / name), s, None if s + size >= len(content) else s + size, block) for x in lines]
                assert got == whole, (name, size, block)


def test_directory_cuts_large_files(spark, tmp_path):
    """A task takes a piece of a file and holds a block of it; a compressed file is one piece."""
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"<Event>{n} {'é' * (n % 50)}</Event>" for n in range(500)]
    (folder / "a.xml").write_text("\ufeff" + "\n".join(lines[:300]) + "\n \n")
    (folder / "empty.xml").write_text("")
    import gzip
    with gzip.open(folder / "b.xml.gz", "wt") as f:
        f.write("\n".join(lines[300:]))
    spark.dataSource.register(directory.EventFiles)
    for suffix, wanted, parts in ((".xml", lines[:300], -(-(folder / "a.xml").stat().st_size // 4000)), (".xml.gz", lines[300:], 1)):
        files = spark.read.format(directory.FORMAT).option("suffix", suffix).load(str(folder))
        cut = directory.pieces(files, str(folder), 4000).filter("path not like '%empty%'").collect()
        assert len(cut) == parts
        got = directory.contents(files, str(folder), 3, 4000)
        assert sorted(r.xml for r in got.collect()) == sorted(wanted)


def test_directory_fetches_oldest_first(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, name in enumerate(["c.xml", "a.XML", "b.xml", "skip.txt", "d.xml"]):
        (folder / name).write_text(f"<Event>{name}</Event>\n\n<Event>more</Event>\n")
        os.utime(folder / name, (1000 + n // 2, 1000 + n // 2))  # a.XML has the time of c.xml
    taken, position = [], None
    for _ in range(4):
        rows, position = directory.fetch(spark, str(folder), position, 2)
        taken.append(sorted({r.path.rsplit("/", 1)[1] for r in rows.collect()}))
    assert taken == [["a.XML", "c.xml"], ["b.xml", "d.xml"], [], []]
    (folder / "late.xml").write_text("\ufeff<Event>late</Event>")
    rows, _ = directory.fetch(spark, str(folder), position, None)
    assert [r.xml for r in rows.collect()] == ["<Event>late</Event>"]
    assert directory.fetch(spark, str(tmp_path / "missing"))[0].count() == 0
    # The same files as a stream, two at a time; a restart reads only what is new.
    for run in range(2):
        query = directory.stream(spark, str(folder), limit=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "streamed"))
        query.processAllAvailable()
        query.stop()
        if run == 0:
            (folder / "new.xml").write_text("<Event>new</Event>")
    got = sorted((r.path.rsplit("/", 1)[1], r.xml) for r in spark.read.parquet(str(tmp_path / "streamed")).collect())
    assert got == sorted([(n, x) for n in ("a.XML", "b.xml", "c.xml", "d.xml") for x in (f"<Event>{n}</Event>", "<Event>more</Event>")] + [("late.xml", "<Event>late</Event>"), ("new.xml", "<Event>new</Event>")])


def test_large_batches_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """No task gets much more than ``TASK_ROWS`` records to sort or join, however few tasks the session has."""
    from embertrace.streaming import pipeline as live

    monkeypatch.setattr(live, "TASK_ROWS", 100)
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("id"))
    parts = live.dealt(rows.coalesce(1), 1000)
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000
    assert live.dealt(rows, 50) is rows
    # the same rows as undealt, repeated and stored ones left out
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("\n".join(document(1, [("ProcessId", str(n % 400 + 1))]) for n in range(600)))
    flow = TelemetryPipeline(str(tmp_path / "out"))
    for _ in range(2):
        run_batch(spark, str(tmp_path / "in"), flow)
    assert flow.table(spark, "records").count() == 400


def test_the_text_of_a_stored_event_is_not_parsed_again(spark, tmp_path, monkeypatch):
    from embertrace.streaming import pipeline as live

    parse, counts = live.parse, []
    monkeypatch.setattr(live, "parse", lambda raw, now=None: (counts.append(raw.count()), parse(raw, now))[1])
    event = lambda n, time="2024-01-10T00:00:00Z": document(1, [("ProcessId", str(n))], time=time)
    # a time of another date that only the parser can read, one in double quotes that the pattern reads too, and rejects
    odd, quoted = event(7, "2024-02-02T00:00:00&#90;"), event(8).replace("'2024-01-10T00:00:00Z'", '"2024-01-10T00:00:00Z"')
    lines = [*(event(n) for n in range(1, 7)), event(6), odd, quoted, event(9, "soon"), "<Event>junk"]
    for name, texts in (("a", lines), ("b", [*lines, event(20), event(21, "2024-03-10T00:00:00Z")])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.xml").write_text("\n".join(texts))
    flow = TelemetryPipeline(str(tmp_path / "out"))
    stored = lambda: (sorted(r.process_id for r in flow.table(spark, "records").collect()), flow.table(spark, "rejects").count())
    for _ in range(2):  # a batch that comes again is done again: its own events are not known to it
        run_batch(spark, str(tmp_path / "a"), flow, run="one")
        assert stored() == (list(range(1, 9)), 2)
    run_batch(spark, str(tmp_path / "b"), flow, run="two")
    assert stored() == ([*range(1, 9), 20, 21], 2)
    assert counts == [11, 11, 5]
    flow.compact(spark)
    run_batch(spark, str(tmp_path / "b"), flow, run="three")
    assert stored() == ([*range(1, 9), 20, 21], 2) and counts[3:] == [3]


def test_what_a_stream_leaves_on_disk(spark, tmp_path, monkeypatch):
    """Batches that overlap share the files of their texts, and ids are stored by a codec that codes digits."""
    from embertrace.checks import enrichment

    batches, flows = [], []
    monkeypatch.setattr(enrichment, "run_batch", lambda spark, folder, flow, **named: (
        batches.append((folder, named["batch_id"], spark.read.text(folder).count())), flows.append(flow), run_batch(spark, folder, flow, **named)))
    ids = [*range(40), 6, None]  # one that comes twice, none
    rows = [(n, T + timedelta(seconds=k), 3 + k % 5, "click", 1.0, "{}") for k, n in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    enrichment.st_compacted(enrichment.Tables(spark, str(tmp_path)))
    upto = [sum(n is not None and n % 4 <= part for n in ids) for part in range(4)]
    assert [(number, n) for _, number, n in batches] == [(part, upto[part]) for part in (0, 1, 1, 0, 2, 3)]
    base = flows[0].out.removesuffix("/out")
    assert spark.read.text(f"{base}/in-*").count() == upto[3] == 41
    assert flows[0].table(spark, "records").count() + flows[0].table(spark, "rejects").count() == 41
    stored = [at for at in Path(base, "out").rglob("*.parquet") if "_temporary" not in at.parts]
    footers = [pq.ParquetFile(at).metadata for at in stored]
    codecs = {m.row_group(g).column(c).compression for m in footers for g in range(m.num_row_groups) for c in range(m.num_columns)}
    assert {at.relative_to(f"{base}/out").parts[0] for at in stored} >= {"segments", "index"} and codecs == {"ZSTD"}
