from __future__ import annotations

import datetime
import json
import shutil

import pytest

from tallyforge.operators import checks
from tallyforge.sinks import files
from tallyforge.sinks.ledger import Ledger
from tallyforge.sources import page_source, readers
from tallyforge.streaming import first_seen, inbox

ROW = {"source_file": "a", "vendor": "V", "invoice_number": "1", "invoice_date": "2026-01-01", "subtotal": 1.0, "tax": 0.0, "total": 1.0, "line_sum": 1.0, "n_lines": 1, "file_hash": "h"}


@pytest.fixture
def keyed(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    first_seen.use_keyed_state(spark)
    yield spark
    spark.conf.set(key, old)


def test_first_arrival_survives_restarts_and_is_forgotten(keyed, tmp_path):
    spark, folder, out, check = keyed, tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    folder.mkdir()

    def run(n, *rows):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(ROW | r) for r in rows))
        stream = first_seen.first_seen(inbox.read_inbox(spark, str(folder)), datetime.timedelta(days=3), "1 hour")
        stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return {(r.kind, r.source_file): r.first_file for r in spark.read.parquet(out).collect()}

    day = lambda d: f"2026-01-{d:02d}T00:00:00.000Z"
    run(0, {"source_file": "b", "arrived": day(2), "invoice_number": ""}, {"source_file": "a", "arrived": day(1), "invoice_number": None})
    run(1, {"source_file": "c", "arrived": day(3)}, {"source_file": "d", "arrived": day(3), "file_hash": "other"})
    got = run(2, {"source_file": "e", "arrived": day(3), "file_hash": ""})
    assert {k: v for k, v in got.items() if k[0] == "file"} == {("file", "a"): "a", ("file", "b"): "a", ("file", "c"): "a", ("file", "d"): "d"}
    assert got["invoice", "c"] == "c" and got["invoice", "d"] == "c" and got["invoice", "e"] == "c"
    run(3, {"source_file": "f", "arrived": day(20), "file_hash": "x", "invoice_number": "9"})  # the watermark passes every horizon
    got = run(4, {"source_file": "g", "arrived": day(20)})
    assert got["file", "g"] == "g" and got["invoice", "g"] == "g"


def test_distinct_files_and_hourly_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [ROW | {"source_file": f"f{i}", "file_hash": f"h{i % 2}", "arrived": f"2026-01-01T0{i}:30:00.000Z", "total": float(i)} for i in range(4)]
    (folder / "0.json").write_text("\n".join(map(json.dumps, rows)))
    for name, build in (("d", inbox.distinct_files), ("h", inbox.hourly_counts)):
        build(inbox.read_inbox(spark, str(folder))).writeStream.option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / name)).start().awaitTermination()
    assert {r.file_hash for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {"h0", "h1"} and spark.read.parquet(str(tmp_path / "d")).count() == 2
    # the last hour is still open
    assert sorted((r.window.start.hour, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "h")).collect())[:2] == [(0, 1, 0.0), (1, 1, 1.0)]


def test_ledger_counts_every_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "l"), "x long"
    ledger = Ledger(spark, path, schema)
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], schema)
    seen = lambda: sorted(r.x for r in Ledger(spark, path, schema).read().collect())
    assert seen() == [] and ledger.compact() is None
    assert ledger.append(rows(1, 2), "a/1") and not ledger.append(rows(1, 2), "a/1") and ledger.append(rows(3), "b")
    assert seen() == [1, 2, 3]
    # an append that was broken off: files, but no mark
    rows(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=c")
    assert seen() == [1, 2, 3] and ledger.append(rows(4), "c") and seen() == [1, 2, 3, 4]
    # a compaction that was broken off before its mark
    rows(1, 2, 3, 4).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/merged=00000001-3")
    assert seen() == [1, 2, 3, 4]
    shutil.copytree(f"{path}/batch=b", f"{tmp_path}/kept")
    name = ledger.compact()
    assert name and ledger.entries() == [name] and seen() == [1, 2, 3, 4]
    # one that was broken off after its mark, before the old entries were gone
    shutil.copytree(f"{tmp_path}/kept", f"{path}/batch=b")
    assert seen() == [1, 2, 3, 4] and not ledger.append(rows(3), "b") and not ledger.append(rows(1, 2), "a/1")
    assert ledger.append(rows(5), "d") and ledger.compact(newest=("x", 2)) and seen() == [4, 5]
    assert not ledger.append(rows(3), "b") and seen() == [4, 5]
    ledger.clear()
    assert seen() == []


def test_history_and_audit_by_batches(spark, tmp_path):
    schema = "source_file string, vendor string, invoice_number string, invoice_date string, total double, file_hash string, validation_ok boolean, batch_pos long"
    inv = spark.createDataFrame([(f"{i}.pdf", "V", str(i), None, 1.0, f"h{i}", True, i) for i in range(5)], schema)
    path = str(tmp_path / "h")
    assert files.append_history(inv, path, "2026-01-01") and not files.append_history(inv, path, "2026-01-01")
    assert files.append_history(inv, path, "2026-01-02", 10)
    files.compact_history(spark, path)
    assert not files.append_history(inv, path, "2026-01-02", 10) and readers.read_history(spark, path).count() == 10
    batch = spark.createDataFrame([("new.pdf", "V", "3", "none", 0), ("same.pdf", "W", "", "h4", 1)], "source_file string, vendor string, invoice_number string, file_hash string, batch_pos long")
    got = {r.source_file: r.duplicate_of for r in checks.check_duplicates(batch, readers.read_history(spark, path)).collect()}
    assert got == {"new.pdf": "3.pdf", "same.pdf": "4.pdf"}
    plan = checks.check_duplicates(batch, readers.read_history(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
    files.clear_history(spark, path)
    assert readers.read_history(spark, path).count() == 0
    audit = spark.createDataFrame([(i, str(i), "a" if i % 2 else "b", "api_key=SECRETVALUE123", "u", "ok") for i in range(6)], files.AUDIT)
    log = str(tmp_path / "audit")
    assert files.append_audit(audit, log, "1") and not files.append_audit(audit, log, "1")
    files.compact_audit(spark, log, 4)
    kept = readers.read_audit(spark, log)
    assert [r.seq for r in files.audit_tail(kept, 2, ("a",)).collect()] == [5, 3] and "SECRET" not in kept.first().detail
    files.clear_audit(spark, log)
    assert readers.read_audit(spark, log).count() == 0


def failing(content, last):
    raise ValueError("not a document")
    yield


def test_words_of_files_through_the_data_source(spark, tmp_path):
    for folder, name, text in (("x", "1.txt", "a bb\n ccc\fsecond page\fthird"), ("x", "2.txt", ""), ("y", "deep/3.txt", "ünï\x0bz"), (".", "4.txt", "root"), ("x", "_skip.txt", "no"), ("y", "5.pdf", "no")):
        file = tmp_path / "in" / folder / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    page_source.register(spark)
    read = lambda **o: spark.read.format("tallyforge_words").options(path=str(tmp_path / "in"), suffix=".txt", **o).load()
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.page_no, r.word_no, r.text, r.x0, r.top) for r in read(partitions=2).collect())
    assert got == [("1.txt", 1, 0, "a", 0.0, 0.0), ("1.txt", 1, 1, "bb", 10.0, 0.0), ("1.txt", 1, 2, "ccc", 5.0, 12.0), ("1.txt", 2, 3, "second", 0.0, 0.0), ("1.txt", 2, 4, "page", 35.0, 0.0), ("1.txt", 3, 5, "third", 0.0, 0.0), ("3.txt", 1, 0, "ünï", 0.0, 0.0), ("3.txt", 1, 1, "z", 20.0, 0.0), ("4.txt", 1, 0, "root", 0.0, 0.0)]
    assert read().where("page_no <= 1").count() == 6 and read().where("page_no = 2 and text = 'page'").count() == 1 and read().where("page_no in (1, 3)").count() == 7
    reader = page_source.WordReader({"path": str(tmp_path / "in")})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    assert list(reader.pushFilters([GreaterThan(("page_no",), 1), LessThan(("page_no",), 4), EqualTo(("page_no",), 2)])) and reader.last == 2
    assert [(p.folders, p.files) for p in reader.partitions() if p.folders] and all("deep" not in f for p in reader.partitions() for f in p.folders)
    errors = read(parser="tests.test_streams_and_ledger:failing").collect()
    assert len(errors) == 4 and {(r.page_no, r.text) for r in errors} == {(0, "ValueError: not a document")}
    assert list(page_source.text_pages(b"a\fb", 1))[0][0] == 1 and len(list(page_source.text_pages(b"a\fb", 1))) == 1
