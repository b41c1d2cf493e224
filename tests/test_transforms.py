import json
import os

import pytest

from veilscan.cli import main
from veilscan.kernel import transforms as t
from veilscan.kernel.blake3 import digest
from veilscan.kernel.engine import default_scanner
from veilscan.operators import scan as s
from veilscan.operators import transform as op

KEY = bytes(range(32))


def test_blake3_vectors():
    assert digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert digest(b"demo_api_Z9Y8X7W6V5U4", 16, b"\x31" * 32).hex() == "78eeefdfa87622730ba4c14d777cb4be"
    assert digest(b"demo-pass-local-only-73", 16, b"\x31" * 32).hex() == "c3ae590de99115a1269113ac383a55d4"
    # public vectors: input bytes i % 251
    data = bytes(i % 251 for i in range(5000))
    assert digest(data[:1]).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert digest(data[:1024]).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert digest(data[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert digest(data[:2049]).hex() == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"


def test_redact_merges_overlaps_only():
    assert t.redact("abcdef", [(0, 2, "a"), (1, 3, "b"), (3, 4, "c")]) == "[REDACTED][REDACTED]ef"


@pytest.mark.parametrize(("spans", "kind"), [([(2, 2, "a")], "invalid_span"), ([(0, 99, "a")], "span_out_of_bounds"), ([(1, 2, "a")], "invalid_utf8_boundary"), ([(0, 3, "a"), (2, 4, "b")], "overlapping_spans")])
def test_errors(spans, kind, spark):
    text = "éabcdef"
    with pytest.raises(t.TransformError) as e:
        t.template(text, spans)
    assert e.value.kind == kind
    found = [dict(rule_id=r, location=dict(start=a, end=b, line=1, column=1), severity="low", severity_ord=1, confidence="low", confidence_ord=0, remediation=None) for a, b, r in spans]
    from veilscan.model import FINDING
    from pyspark.sql import types as T

    rows = spark.createDataFrame([(1, 0, text, found)], T.StructType([T.StructField("source_key", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("text", T.StringType()), T.StructField("findings", T.ArrayType(FINDING))]))
    got = op.template(rows).first()
    assert (got.content, got.error) == (None, kind)
    with pytest.raises(Exception, match=kind):
        op.template(rows, strict=True).collect()


def test_template_names():
    assert t.template("abcd", [(0, 1, "my rule!"), (2, 3, "my rule!")], namespace=" x  y ", numbered=True) == "<x-y:my-rule:1>b<x-y:my-rule:2>d"


TEXTS = ["ü password = hunter2hunter2\nghp_aB3dE5gH7jK9mN1pQ3sT5vW7 end é", "", "clean", "AB1Z-CD2Y-EF3X-GH4W", None]


def test_frames_equal_kernel(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "k long, t string")
    entries = s.scan(s.sources(rows, "k", "t", "k"), keep_text=True)
    scanner = default_scanner()
    spans = {i: [(f["location"]["start"], f["location"]["end"], f["rule_id"]) for f in scanner.report(x or "")[0]] for i, x in enumerate(TEXTS)}
    cases = [(op.redact(entries), t.redact, {}), (op.redact(entries, "*"), t.redact, {"replacement": "*"}), (op.template(entries, numbered=True), t.template, {"numbered": True}), (op.pseudonymize(entries, KEY), t.pseudonymize, {"key": KEY}), (op.synthesize(entries, KEY), t.synthesize, {"key": KEY})]
    for frame, f, options in cases:
        assert {r.source_key: r.content for r in frame.collect()} == {i: f(x or "", spans[i], **options) for i, x in enumerate(TEXTS)}


def test_synthetic_values_keep_length_and_are_not_found_again():
    texts = ["ghp_aB3dE5gH7jK9mN1pQ3sT5vW7", "password = hunter2hunter2", "AKIA" + "ABCD1234" * 2, "token: 0123456789abcdef01", "xoxb-123456789012-abcdefghijkl"]
    scanner = default_scanner()
    for text in texts:
        spans = [(f["location"]["start"], f["location"]["end"], f["rule_id"]) for f in scanner.report(text)[0]]
        made = t.synthesize(text, spans, KEY)
        assert spans and len(made) == len(text) and made != text
        assert made == t.synthesize(text, spans, KEY) != t.synthesize(text, spans, KEY[::-1])
    assert t.synthesize("4111111111111111", [(0, 16, "financial.pan")], KEY) != "4111111111111111"


def test_bundle(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "k long, t string")
    entries = s.scan(s.sources(rows, "k", "t", "k"), keep_text=True)
    srcs, manifest = op.bundle(entries, t.ShareMode("redact"))
    assert "hunter2" not in repr(srcs.collect()) and manifest.first().summary.total_findings == 2


def test_cli(tmp_path, capsys):
    (tmp_path / "a.txt").write_text("password = hunter2hunter2\n")
    (tmp_path / "k").write_bytes(KEY)
    path = str(tmp_path / "a.txt")
    assert main(["scan", path, "--format", "json", "--min-severity", "high", "--explain"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["status"] == "findings" and out["selection"]["findings_count"] == 1 and out["findings"][0]["detection_mode"] == "contextual"
    assert main(["redact", path]) == 0 and capsys.readouterr().out == "password = [REDACTED]\n"
    assert main(["pseudonymize", path, "--key-file", str(tmp_path / "k")]) == 0
    assert main(["scan", path, "--severity", "high", "--min-severity", "low"]) == 2 and main(["nope"]) == 2 and main(["redact", str(tmp_path / "none")]) == 1
    (tmp_path / "bad").write_bytes(b"\xff")
    assert main(["redact", str(tmp_path / "bad")]) == 1
    out_dir = str(tmp_path / "b")
    assert main(["bundle", "template", "--output-dir", out_dir, path]) == 0 and sorted(os.listdir(out_dir)) == ["manifest.json", "sources"]
    assert main(["bundle", "template", "--output-dir", out_dir, path]) == 1


def test_digests_of_many_messages():
    from veilscan.kernel.blake3 import digests

    data = bytes(i % 251 for i in range(3000))
    messages = [bytes([k]) + data[:n] for n in (0, 1, 62, 63, 64, 126, 127, 500, 1022, 1023, 1024, 2999) for k in range(20)] + [b""]
    for size in (8, 32, 64, 130):
        for key in (None, KEY):
            assert digests(messages, size, key) == {m: digest(m, size, key) for m in messages}


@pytest.mark.parametrize("mode", ["pseudonymize", "synthesize"])
def test_keyed_modes_make_a_batch_of_digests_together(mode, spark, monkeypatch):
    values = [f"é password = {'x' * (k % 90)}hunter{k}hunter" for k in range(200)]
    spans = [[(len("é password = ".encode()), len(v.encode()), "generic.password-field")] for v in values]
    share = t.ShareMode(mode, {"key": KEY})
    single = [share.apply(v, s) for v, s in zip(values, spans)]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, t string").coalesce(1)
    got = op.keyed(s.scan(s.sources(rows, "k", "t", "k"), keep_text=True), share).orderBy("ordinal").collect()
    found = default_scanner()
    assert [r.content for r in got] == [share.apply(v, [(len(v[:m.start].encode()), len(v[:m.end].encode()), found.rules[m.rule].id) for m in found.findings(v)]) for v in values]
    known = share.known(values, spans)
    monkeypatch.setattr(t, "digest", None)  # nothing is left to be made one by one
    assert [share.apply(v, x, known) for v, x in zip(values, spans)] == single


@pytest.mark.parametrize("ordered", [False, True])
def test_bundle_scans_its_sources_once(spark, ordered):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, "password = hunter2hunter2") for k in range(300)], "k long, t string").repartition(3)
    rows = rows.repartitionByRange(3, "k").sortWithinPartitions("k") if ordered else rows
    entries = s.scan(s.sources(rows, "k", "t", "k").mapInArrow(count, "source_key long, ordinal long, text string"), keep_text=True)
    got = op.bundle(entries, t.ShareMode("redact"), **({"ordered": True} if ordered else {}))[0].collect()
    assert [r.key for r in got] == list(range(300)) and got[0].content == "password = [REDACTED]"
    assert seen.value == 300
