import json

import pytest

from veilscan.kernel.engine import Rule, ScannerBuilder, default_scanner
from veilscan.streaming import chunks as c
from veilscan.streaming import incremental as inc

TEXT = "é\r\npassword = hunter2hunter2\r\nAB1Z-CD2Y-EF3X-GH4W ü ghp_aB3dE5gH7jK9mN1pQ3sT5vW7"


def test_every_split_gives_the_whole_report():
    data, scanner = TEXT.encode(), default_scanner()
    whole = scanner.report(TEXT)
    for k in range(len(data) + 1):
        s = c.Session(scanner)
        assert s.push(data[:k]) is None and s.push(data[k:]) is None
        error, report = s.finish()
        assert error is None and (report["findings"], report["candidates"]) == whole


def test_errors_end_a_session():
    s = c.Session(default_scanner())
    assert s.push(b"\xff") == "invalid_utf8" and s.push(b"x") == "not_active" and s.finish() == ("invalid_utf8", None)
    s = c.Session(default_scanner())
    s.push("é".encode()[:1])
    assert s.finish() == ("incomplete_utf8", None)
    for limits, error in ((c.Limits(max_stream_storage_bytes=3), "storage_limit_exceeded"), (c.Limits(max_candidates=0), "candidate_limit_exceeded"), (c.Limits(max_retained_results=0), "result_limit_exceeded")):
        s = c.Session(default_scanner(), limits)
        s.push(TEXT.encode())
        assert s.finish()[0] == error
    assert c.Session(default_scanner(), strict=True).push(b"x") == "not_active"
    assert c.unsupported_rules(ScannerBuilder().rule(Rule.literal("a", "b", "low"), Rule.pattern("b", "x{1,3}", "low")).build()) == []
    assert c.unsupported_rules(ScannerBuilder().rule(Rule.suffix("a", "aba", "low"), Rule.pattern("b", "x+", "low")).build()) == ["a", "b"]


def _pieces():
    data = TEXT.encode()
    rows = [("a", i, data[i * 7:i * 7 + 7], False) for i in range(-(-len(data) // 7))]
    return [*rows, ("a", len(rows), b"", True), ("b", 0, b"\xff", False), ("c", 1, b"x", True), ("d", 0, b"open", False)]


_SCHEMA = "source_id string, seq long, chunk binary, eof boolean"


def _check(rows):
    got = {r.source_id: r for r in rows}
    assert set(got) == {"a", "b", "c"} and got["b"].error == "invalid_utf8" and got["c"].error == "out_of_order"
    report = json.loads(got["a"].report)
    assert (report["findings"], report["candidates"]) == default_scanner().report(TEXT) and got["a"].source_bytes == len(TEXT.encode())


def test_batch_of_chunks(spark):
    rows = c.stream_reports(spark.createDataFrame(_pieces(), _SCHEMA)).collect()
    assert [(r.error, r.source_bytes) for r in rows if r.source_id == "d"] == [("unfinished", 4)]
    _check([r for r in rows if r.source_id != "d"])


def test_strict_batch(spark):
    rows = c.stream_reports(spark.createDataFrame(_pieces()[:1], _SCHEMA), strict=True).collect()
    assert [r.error for r in rows] == ["unsupported_rule_set"]


def test_a_push_reads_its_fragment_only(monkeypatch):
    read = []
    monkeypatch.setattr(c, "_utf8_error", lambda data: read.append(len(data)))
    s = c.Session(default_scanner())
    for _ in range(100):
        s.push("aé€😀".encode())
    assert sum(read) == 100 * 10
    for k in range(1, 4):
        s = c.Session(default_scanner())
        s.push("😀".encode()[:k])
        s.push("😀".encode()[k:])
        assert read[-1] == 4 and not c._open_bytes(s.held)


def test_structured_streaming(spark, tmp_path):
    rows = _pieces()
    for i in range(0, len(rows), 6):  # one file per micro-batch, so sources span batches
        spark.createDataFrame(rows[i:i + 6], _SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = c.stream_reports(stream).writeStream.format("memory").queryName("chunk_reports").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    _check(spark.table("chunk_reports").collect())


def test_edits_equal_rescans():
    d = inc.Document(default_scanner(), TEXT)
    for k, (a, b, new) in enumerate([(0, 2, ""), (0, 0, "ü token: 0123456789abcdef01\n"), (5, 5, ""), (0, len(d.data) - 2, "x")]):
        end = min(b, len(d.data))
        assert d.apply_edit(k, a, end, new) == "applied" and d.revision == k + 1
        assert (d.report["findings"], d.report["candidates"]) == default_scanner().report(d.text)


def test_edit_errors_come_in_order():
    d = inc.Document(default_scanner(), "éa")
    assert d.apply_edit(1, 5, 2, "") == "stale_revision"
    assert d.apply_edit(0, 2, 1, "") == "invalid_range" and d.apply_edit(0, 0, 9, "") == "invalid_range"
    assert d.apply_edit(0, 1, 2, "") == "invalid_utf8_boundary"
    d.revision = inc.LAST_REVISION
    assert d.apply_edit(inc.LAST_REVISION, 0, 0, "") == "revision_overflow"
    d = inc.Document(default_scanner(), "x", inc.Limits(max_candidates=0))
    assert d.apply_edit(0, 0, 0, "password = hunter2hunter2 ") == "candidate_limit_exceeded"
    assert d.text == "x" and d.revision == 0 and d.apply_edit(0, 0, 0, "") == "not_active"


def test_edit_log(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    log = spark.createDataFrame([("a", 1, 0, 0, 1, "password = hunter2hunter2"), ("a", 2, 0, 0, 0, "late"), ("z", 0, 0, 0, 0, "")], "doc_id string, seq long, expected_revision long, start long, end long, replacement string")
    got = {(r.doc_id, r.seq): r for r in inc.apply_edits(docs, log).collect()}
    assert {k: (r.status, r.revision) for k, r in got.items()} == {("a", -1): ("opened", 0), ("a", 1): ("applied", 1), ("a", 2): ("stale_revision", 1), ("b", -1): ("opened", 0), ("z", 0): ("unknown_document", None)}
    assert len(json.loads(got["a", 1].report)["findings"]) == 1


def test_repeated_documents_and_null_ids(spark):
    docs = spark.createDataFrame([("a", "y"), ("a", "x"), (None, "n")], "doc_id string, text string")
    log = spark.createDataFrame([("a", 0, 0, 0, 1, "zz"), (None, 0, 0, 0, 0, "q")], "doc_id string, seq long, expected_revision long, start long, end long, replacement string")
    got = sorted((r.doc_id or "", r.seq, r.status, r.source_bytes) for r in inc.apply_edits(docs, log).collect())
    assert got == [("", -1, "opened", 1), ("", 0, "applied", 2), ("a", -1, "duplicate_document", 1), ("a", -1, "opened", 1), ("a", 0, "applied", 2)]
    none = spark.createDataFrame([], "source_id string, seq long, chunk binary, eof boolean")
    assert c.stream_reports(none).count() == 0 and inc.apply_edits(docs.limit(0), log.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 0, None, True), ("b", 0, b"x", True)], "source_id string, seq long, chunk binary, eof boolean")
    assert sorted((r.source_id or "", r.error, r.source_bytes) for r in c.stream_reports(nulls).collect()) == [("", None, 0), ("b", None, 1)]


def test_cache_limit():
    d = inc.Document(ScannerBuilder().rule(Rule.literal("a", "b", "low")).build(), "b", inc.Limits(max_retained_cache_records=1))
    assert d.records == 1 and d.apply_edit(0, 0, 0, " ") == "cache_limit_exceeded" and not d.active


@pytest.mark.parametrize("text", ["", "no findings"])
def test_empty(text):
    s = c.Session(default_scanner())
    s.push(text.encode())
    assert s.finish() == (None, {"findings": [], "candidates": []})


def test_report_is_written_once_and_as_json_does(spark):
    text = 'é ghp_aB3dE5gH7jK9mN1pQ3sT5vW7\ncode AB1Z-CD2Y-EF3X-GH4W kept\npassword = "hunter2hunter2"\n'
    for start in (text, text * 40, ""):
        doc = inc.Document(default_scanner(), start)
        for edit in ((0, 0, 0, "x = 1\n"), (0, 0, 1, "stale"), (1, 0, 6, "password: hunter2hunter2\n")):
            before = doc.report_json
            assert doc.apply_edit(*edit) == "applied" or doc.report_json is before
            assert doc.report_json == json.dumps(doc.report) and doc.counts == tuple(map(len, doc.report.values()))
            assert doc.report == dict(zip(("findings", "candidates"), default_scanner().report(doc.text)))
