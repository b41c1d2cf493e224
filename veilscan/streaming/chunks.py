"""Sources that arrive as byte fragments, in batch or Structured Streaming.

A fragment may end inside a character or between CR and LF. A source is
reported once, at its end, exactly as the whole text would be; its first error
ends it and nothing of it is reported.

ERRORS lists what can end a source. Errors of number widths and of a static
storage estimate have no counterpart: offsets are Python integers, and the
limit counts the bytes that are held.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import HINTS, RuleSpec
from ..kernel.dialect import translate
from ..kernel.engine import SUFFIX_BYTES, Scanner, default_scanner
from ..session import partitions

#: unsupported_rule_set and the three limits come from the configuration, not_active follows another error,
#: out_of_order and unfinished come from a table of fragments that is not a whole source.
ERRORS = ("unsupported_rule_set", "not_active", "invalid_utf8", "incomplete_utf8", "candidate_limit_exceeded", "result_limit_exceeded", "storage_limit_exceeded", "out_of_order", "unfinished")
RESULT = "source_id string, error string, source_bytes long, report string"
_STATE = "next_seq long, held binary, done boolean"


@dataclass(frozen=True)
class Limits:
    """None: no limit. Bytes are those of the source held for its report."""

    max_candidates: int | None = None
    max_retained_results: int | None = None
    max_stream_storage_bytes: int | None = None


def unsupported_rules(scanner: Scanner) -> list[str]:
    """Ids of rules that a bounded-memory stream could not run exactly; sessions here hold the source, so this only informs."""
    out = []
    for r in scanner.rules:
        built_in = isinstance(r, RuleSpec)
        if r.kind == "prefix" and r.validator != "none":
            out.append(r.id)
        elif r.kind == "suffix" and (len(r.value) > SUFFIX_BYTES or not re.fullmatch("[A-Za-z0-9_-]+", r.value) or any(r.value.endswith(r.value[:k]) for k in range(1, len(r.value)))):
            out.append(r.id)
        elif r.kind in ("pattern", "capture") and ((built_in and r.id in HINTS) or re._parser.parse(translate(r.value)).getwidth()[1] >= re._parser.MAXREPEAT):
            out.append(r.id)
    return out


@dataclass
class Session:
    """One source: push fragments, then finish."""

    scanner: Scanner
    limits: Limits = field(default_factory=Limits)
    strict: bool = False
    held: bytearray = field(default_factory=bytearray)
    error: str | None = None

    def __post_init__(self) -> None:
        if self.strict and unsupported_rules(self.scanner):
            self.error = "unsupported_rule_set"

    def push(self, data: bytes) -> str | None:
        """Takes a fragment; only it and the last character's open bytes are decoded."""
        if self.error:
            return "not_active"
        carry = _open_bytes(self.held)
        most = self.limits.max_stream_storage_bytes
        fresh = bytes(self.held[len(self.held) - carry:]) + data
        self.held += data
        if most is not None and len(self.held) > most:
            self.error = "storage_limit_exceeded"
        else:
            self.error = _utf8_error(fresh)
        return self.error

    def finish(self) -> tuple[str | None, dict | None]:
        if self.error:
            return self.error, None
        if _open_bytes(self.held):
            self.error = "incomplete_utf8"
            return self.error, None
        text, lim = self.held.decode(), self.limits
        raw = list(self.scanner.plan.raw(text))
        if lim.max_candidates is not None and len(raw) > lim.max_candidates:
            self.error = "candidate_limit_exceeded"
            return self.error, None
        accepted = self.scanner.matches(text, raw)
        found, spans = self.scanner.both(text, matches=accepted)
        if lim.max_retained_results is not None and len(accepted) + len(spans) > lim.max_retained_results:
            self.error = "result_limit_exceeded"
            return self.error, None
        rows, review = self.scanner.rows(text, found, spans)
        self.error = "finished"
        return None, {"findings": rows, "candidates": review}


def _open_bytes(data: bytes | bytearray) -> int:
    """How many last bytes are the beginning of a character that goes on: 0 to 3."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            return back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
        if lead < 0x80:
            return 0
    return 0


def _utf8_error(data: bytes) -> str | None:
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return None if e.reason == "unexpected end of data" else "invalid_utf8"
    return None


class _Source:
    """One source's session and place in its fragments."""

    def __init__(self, scanner: Scanner, limits: Limits, strict: bool, next_seq: int = 0, held: bytes = b"", done: bool = False) -> None:
        self.session, self.next_seq, self.done = Session(scanner, limits, strict, bytearray(held)), next_seq, done

    def take(self, seq: int, chunk: bytes | None, eof: bool) -> tuple[str | None, int, str | None] | None:
        """(error, source_bytes, report) if this fragment ends the source; after its end a source takes no more."""
        if self.done:
            return None
        error = self.session.error or (None if seq == self.next_seq else "out_of_order") or self.session.push(bytes(chunk or b""))
        self.next_seq, report = int(seq) + 1, None
        if not error and eof:
            error, report = self.session.finish()
        self.done = bool(error or eof)
        return (error, len(self.session.held), None if report is None else json.dumps(report)) if self.done else None

    def close(self) -> tuple[str | None, int, str | None] | None:
        """The end of a batch ends the source."""
        return None if self.done else ("unfinished", len(self.session.held), None)


def stream_reports(chunks: DataFrame, scanner: Scanner | None = None, limits: Limits | None = None, strict: bool = False) -> DataFrame:
    """Streaming or batch chunks(source_id, seq, chunk, eof) -> RESULT rows, one per ended source; seq counts from 0.

    A batch ends every source: one without a last fragment has the error
    ``unfinished``. A stream waits for it. With ``strict`` every source of a rule
    set that a bounded session could not run has ``unsupported_rule_set``.
    """
    scanner, limits = scanner or default_scanner(), limits or Limits()
    rows = chunks.select(chunks["source_id"].cast("string").alias("source_id"), "seq", "chunk", "eof")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source = _Source(scanner, limits, strict, *(state.get if state.exists else ()))
        part = pd.concat(list(frames)).sort_values("seq")
        ends = [r for r in map(source.take, part["seq"], part["chunk"], part["eof"]) if r]
        state.update((source.next_seq, b"" if source.done else bytes(source.session.held), source.done))
        for error, size, report in ends:
            yield pd.DataFrame({"source_id": [key[0]], "error": [error], "source_bytes": [size], "report": [report]}, dtype=object)

    if rows.isStreaming:
        return rows.groupBy("source_id").applyInPandasWithState(fold, RESULT, _STATE, "append", GroupStateTimeout.NoTimeout)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments come sorted, so one source is held at a time, across Arrow batches too."""
        source, name, out = None, None, []
        for batch in frames:
            for key, seq, chunk, eof in zip(*(batch.column(c).to_pylist() for c in ("source_id", "seq", "chunk", "eof"))):
                if source is None or key != name:
                    out.append((name, source.close() if source else None))
                    source, name = _Source(scanner, limits, strict), key
                out.append((name, source.take(seq, chunk, eof)))
            yield _results(out)
            out = []
        yield _results([(name, source.close() if source else None)])

    return rows.repartition(partitions(rows), "source_id").sortWithinPartitions("source_id", "seq").mapInArrow(run, RESULT)


def _results(ends: list[tuple]) -> pa.RecordBatch:
    rows = [(name, *end) for name, end in ends if end]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["source_id", "error", "source_bytes", "report"])
