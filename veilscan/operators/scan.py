"""Scanning a DataFrame of text sources, and the relational form of normalisation.

A source is never split, so ``scan`` normalises inside the kernel and needs no
shuffle. ``accepted`` with ``resolve_exact_spans`` and ``suppress_candidates``
give the same findings with windows and joins, for accepted matches that come
from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernel.engine import Coordinates, Scanner, default_scanner
from ..kernel.validators import CHECKS
from ..model import CANDIDATES, CONFIDENCES, FINDINGS, SEVERITIES

_LOCATION = [pa.field(n, pa.int64()) for n in ("start", "end", "line", "column")]


def sources(df: DataFrame, key: str, text: str, ordinal: str | None = None) -> DataFrame:
    """(source_key, ordinal, text) of any table; the order of input is by ``ordinal``, else by key."""
    order = F.col(ordinal).cast("long") if ordinal else F.lit(None).cast("long")
    return df.select(F.col(key).alias("source_key"), order.alias("ordinal"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _lists(rows: list[int], n: int, places: list[tuple], more: list[tuple[str, pa.Array]], after: list[tuple[str, pa.Array]]) -> pa.Array:
    """A list column of n rows from flat values; ``rows`` ascend."""
    offsets = np.searchsorted(np.array(rows, np.int64), np.arange(n + 1)).astype(np.int32)
    columns = np.array(places, np.int64).reshape(-1, 4).T
    location = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=_LOCATION)
    named = [*more, ("location", location), *after]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([v for _, v in named], names=[k for k, _ in named]))


ROWS_A_TASK = 25_000  # of short rows, from which texts are then made: a scan of a few seconds


def spread(df: DataFrame, *order: str) -> DataFrame:
    """df, in ``order`` if there is one, over tasks whose number follows its rows, as the bytes of short or well-packed rows say little of the work that comes after.

    The rows are counted first, which Parquet answers from its footers.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order else df.repartition(tasks)


def scan(srcs: DataFrame, scanner: Scanner | None = None, keep_text: bool = False, suppress: bool = True) -> DataFrame:
    """sources -> entries(source_key, ordinal, source_bytes, findings, candidates[, text]).

    One Arrow pass without a shuffle. Texts that the scanner's gate excludes
    cost one automaton pass over the Arrow buffer. Without ``suppress`` the
    candidates that findings overlap stay.
    """
    scanner = scanner or default_scanner()
    kept = ["source_key", "ordinal", *["text"] * keep_text]
    rules = scanner.rules
    of_rule = [
        ("severity", [r.severity for r in rules], pa.string()), ("severity_ord", [SEVERITIES.index(r.severity) for r in rules], pa.int32()), ("confidence", [CHECKS[r.validator][2] for r in rules], pa.string()),
        ("confidence_ord", [CONFIDENCES.index(CHECKS[r.validator][2]) for r in rules], pa.int32()), ("remediation", [r.remediation for r in rules], pa.string()),
    ]
    names = [r.id for r in rules]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            n, got = batch.num_rows, scanner.column(batch.column("text"), suppress)
            at = pa.array(got.rules, pa.int64())
            findings = _lists(got.rows, n, got.places, [("rule_id", pa.array(names, pa.string()).take(at))], [(k, pa.array(v, t).take(at)) for k, v, t in of_rule])
            same = lambda x: pa.array([x] * len(got.review_rows), pa.string())
            review = _lists(got.review_rows, n, got.review_places, [("kind", same("recovery_like_code"))], [("evidence", same("structural"))])
            yield pa.record_batch([*(batch.column(k) for k in kept), batch.column("source_bytes"), findings, review], names=[*kept, "source_bytes", "findings", "candidates"])

    rows = srcs.select("source_key", "ordinal", "text", F.octet_length("text").cast("long").alias("source_bytes"))
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept]
    schema = ", ".join([*fields, "source_bytes long", f"findings {FINDINGS.simpleString()}", f"candidates {CANDIDATES.simpleString()}"])
    order = ["source_key", "ordinal", "source_bytes", "findings", "candidates", *["text"] * keep_text]
    return rows.mapInArrow(run, schema).select(*order)


def accepted(srcs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """sources -> validated matches before normalisation: (source_key, rule_idx, rule_id, start, end, line, column, priority, confidence, ...)."""
    scanner = scanner or default_scanner()
    rules = scanner.rules
    of_rule = [
        ("rule_id", [r.id for r in rules], "string"), ("priority", [CHECKS[r.validator][1] for r in rules], "int"), ("confidence", [CHECKS[r.validator][2] for r in rules], "string"),
        ("confidence_ord", [CONFIDENCES.index(CHECKS[r.validator][2]) for r in rules], "int"), ("severity", [r.severity for r in rules], "string"), ("severity_ord", [SEVERITIES.index(r.severity) for r in rules], "int"), ("remediation", [r.remediation for r in rules], "string"),
    ]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            col, rows, idx, places = batch.column("text"), [], [], []
            for row in scanner.possible(col).to_pylist():
                text = col[row].as_py() or ""
                found = scanner.matches(text)
                where = Coordinates(text) if found else None
                for m in found:
                    rows.append(row)
                    idx.append(m.rule)
                    places.append(where.place(m.start, m.end))
            at = pa.array(idx, pa.int64())
            cols = [batch.column("source_key").take(pa.array(rows, pa.int64())), pa.array(idx, pa.int32()), *(pa.array(c) for c in np.array(places, np.int64).reshape(-1, 4).T)]
            cols += [pa.array(v, pa.string() if t == "string" else pa.int32()).take(at) for _, v, t in of_rule]
            yield pa.record_batch(cols, names=["source_key", "rule_idx", "start", "end", "line", "column", *(k for k, _, _ in of_rule)])

    schema = ", ".join([f"source_key {srcs.schema['source_key'].dataType.simpleString()}", "rule_idx int", "start long", "end long", "line long", "column long", *(f"{k} {t}" for k, _, t in of_rule)])
    return srcs.select("source_key", "text").mapInArrow(run, schema)


def resolve_exact_spans(rows: DataFrame) -> DataFrame:
    """Of accepted matches on one span, those of the highest priority; ties and partial overlaps all stay."""
    span = Window.partitionBy("source_key", "start", "end")
    return rows.withColumn("_best", F.max("priority").over(span)).where("priority = _best").drop("_best")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank: start, end, priority down, confidence down, severity down, rule id, from 1 in each source."""
    order = Window.partitionBy("source_key").orderBy("start", "end", F.desc("priority"), F.desc("confidence_ord"), F.desc("severity_ord"), "rule_id")
    return rows.withColumn("rank", F.row_number().over(order))


def review_candidates(srcs: DataFrame) -> DataFrame:
    """All grouped codes, before suppression: (source_key, start, end, line, column)."""
    found = candidates(scan(srcs, Scanner(()), suppress=False))
    return found.select("source_key", "start", "end", "line", "column")


def suppressed(entries: DataFrame) -> DataFrame:
    """Entries of ``scan(..., suppress=False)`` without the candidates that a finding of theirs overlaps."""
    hit = lambda c: F.exists("findings", lambda f: (f["location"]["start"] < c["location"]["end"]) & (f["location"]["end"] > c["location"]["start"]))
    return entries.withColumn("candidates", F.filter("candidates", lambda c: ~hit(c)))


def suppress_candidates(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidates that no finding of their source overlaps."""
    f = findings.select(F.col("source_key").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return candidates.join(f, (F.col("source_key") == F.col("_k")) & (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start")), "left_anti")


def findings(entries: DataFrame) -> DataFrame:
    """One row per finding, flat: source_key, ordinal, pos (its place in the report), rule_id, location, ..."""
    f = entries.select("source_key", "ordinal", F.posexplode("findings").alias("pos", "f"))
    return f.select("source_key", "ordinal", "pos", "f.rule_id", "f.location.*", "f.severity", "f.severity_ord", "f.confidence", "f.confidence_ord", "f.remediation")


def candidates(entries: DataFrame) -> DataFrame:
    """One row per review candidate, flat."""
    c = entries.select("source_key", "ordinal", F.posexplode("candidates").alias("pos", "c"))
    return c.select("source_key", "ordinal", "pos", "c.kind", "c.location.*", "c.evidence")


def rule_metadata(spark, scanner: Scanner | None = None) -> DataFrame:  # noqa: ANN001
    """The rule dimension: position, id, kind, detection mode, severity, remediation with its label and message."""
    from ..model import REMEDIATIONS

    rules = (scanner or default_scanner()).rules
    rows = [(i, r.id, r.public_kind, CHECKS[r.validator][3], r.severity, SEVERITIES.index(r.severity), r.remediation, *(REMEDIATIONS[r.remediation] if r.remediation else (None, None))) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, rule_id string, kind string, detection_mode string, severity string, severity_ord int, remediation string, remediation_label string, remediation_message string")
