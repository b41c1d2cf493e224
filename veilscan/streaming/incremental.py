"""Documents changed edit by edit; after each edit the report is that of the whole text, which is scanned again.

STATUSES lists what an edit can come to. Errors of number widths have no
counterpart here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.engine import Scanner, default_scanner, review_spans
from ..session import partitions

LAST_REVISION = (1 << 64) - 1
STATUSES = ("applied", "not_active", "stale_revision", "invalid_range", "invalid_utf8_boundary", "revision_overflow", "candidate_limit_exceeded", "cache_limit_exceeded", "result_limit_exceeded", "transaction_storage_limit_exceeded", "unknown_document", "duplicate_document")
RESULT = "doc_id string, seq long, status string, active boolean, revision long, source_bytes long, report string, findings long, candidates long"


@dataclass(frozen=True)
class Limits:
    """None: no limit. Cache records are the matches and codes of the text before the edit and after it, together."""

    max_candidates: int | None = None
    max_retained_cache_records: int | None = None
    max_materialized_results: int | None = None
    max_transaction_storage_bytes: int | None = None


@dataclass
class Document:
    """Errors of the edit itself leave the document as it is; a limit's error also ends editing, and the last report stays."""

    scanner: Scanner
    text: str
    limits: Limits = field(default_factory=Limits)
    revision: int = 0
    active: bool = True
    records: int = 0

    def __post_init__(self) -> None:
        self.data = self.text.encode()
        error, result = self._scan(self.text, len(self.data))
        if error:
            raise ValueError(error)
        self._set(self.text, result)

    def _set(self, text: str, result: tuple) -> None:
        """The last report is kept as what it is made of, and written when asked for."""
        self._reported, self._json = (text, *result), None

    @property
    def report(self) -> dict:
        found, review = self.scanner.rows(*self._reported)
        return {"findings": found, "candidates": review}

    @property
    def counts(self) -> tuple[int, int]:
        """Findings and candidates of the report."""
        return len(self._reported[1]), len(self._reported[2])

    @property
    def report_json(self) -> str:
        if self._json is None:
            self._json = self.scanner.report_json(*self._reported)
        return self._json

    def _scan(self, text: str, size: int) -> tuple[str | None, tuple]:
        lim = self.limits
        if lim.max_transaction_storage_bytes is not None and size + len(self.data) > lim.max_transaction_storage_bytes:
            return "transaction_storage_limit_exceeded", ()
        raw = list(self.scanner.plan.raw(text))
        if lim.max_candidates is not None and len(raw) > lim.max_candidates:
            return "candidate_limit_exceeded", ()
        codes = list(review_spans(text))
        held = len(raw) + len(codes)
        if lim.max_retained_cache_records is not None and held + self.records > lim.max_retained_cache_records:
            return "cache_limit_exceeded", ()
        found, spans = self.scanner.both(text, matches=self.scanner.matches(text, raw), codes=codes)
        if lim.max_materialized_results is not None and len(found) + len(spans) > lim.max_materialized_results:
            return "result_limit_exceeded", ()
        self.records = held
        return None, (found, spans)

    def apply_edit(self, expected_revision: int, start: int, end: int, replacement: str) -> str:
        """Replaces bytes start to end; the status: applied, or the first error in a fixed order."""
        data = self.data
        inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
        if not self.active:
            return "not_active"
        if expected_revision != self.revision:
            return "stale_revision"
        if start > end or start < 0 or end > len(data):
            return "invalid_range"
        if inside(start) or inside(end):
            return "invalid_utf8_boundary"
        if self.revision >= LAST_REVISION:
            return "revision_overflow"
        data = data[:start] + replacement.encode() + data[end:]
        changed = data.decode()
        error, result = self._scan(changed, len(data))
        if error:
            self.active = False
            return error
        self.text, self.data, self.revision = changed, data, self.revision + 1
        self._set(changed, result)
        return "applied"


def apply_edits(documents: DataFrame, edits: DataFrame, scanner: Scanner | None = None, limits: Limits | None = None) -> DataFrame:
    """documents(doc_id, text), edits(doc_id, seq, expected_revision, start, end, replacement) -> RESULT, a row per document (seq -1) and edit.

    Documents and edits meet by one shuffle on doc_id and a sort; a document is
    held only while its edits run. Of rows that repeat a doc_id the least text
    is edited, the others have the status ``duplicate_document``.
    """
    scanner, limits = scanner or default_scanner(), limits or Limits()
    none = lambda kind: F.lit(None).cast(kind)
    left = documents.select(F.col("doc_id").cast("string").alias("doc_id"), none("long").alias("seq"), none("long").alias("expected_revision"), none("long").alias("start"), none("long").alias("end"), F.coalesce(F.col("text"), F.lit("")).alias("body"), F.lit(False).alias("is_edit"))
    right = edits.select(F.col("doc_id").cast("string").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("seq", "expected_revision", "start", "end")), F.coalesce(F.col("replacement"), F.lit("")).alias("body"), F.lit(True).alias("is_edit"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, name, first = None, None, True
        for batch in frames:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "seq", "expected_revision", "start", "end", "body", "is_edit"))
            for key, seq, revision, start, end, body, is_edit in zip(*columns):
                if first or key != name:
                    doc, name, first = None, key, False
                if is_edit and doc is None:
                    out.append((name, seq, "unknown_document", False, None, None, None, None, None))
                    continue
                if is_edit:
                    status = doc.apply_edit(revision, start, end, body)
                elif doc is None:
                    doc, status = Document(scanner, body, limits), "opened"
                else:
                    status = "duplicate_document"
                out.append((name, seq if is_edit else -1, status, doc.active, doc.revision, len(doc.data), doc.report_json, *doc.counts))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    return left.unionByName(right).repartition(partitions(left), "doc_id").sortWithinPartitions("doc_id", "is_edit", "seq", "body").mapInArrow(run, RESULT)
