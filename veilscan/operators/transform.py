"""Safe forms of scanned sources: redaction, templates, pseudonyms, synthetic values, share bundles.

Redaction and templates are Catalyst expressions over binary text; keyed modes
need BLAKE3, which Spark lacks, and run in one Arrow kernel. Entries must come
from ``scan(..., keep_text=True)``. A row that cannot be transformed has null
content and its error; strict=True fails the job instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel.transforms import NAMESPACE, ShareMode, TransformError, component
from ..session import partitions
from .query import summary

_SORTED = "array_sort(transform(findings, f -> struct(f.location.start as s, f.location.end as e, f.rule_id as r)))"
# Spans that overlap merge, touching ones stay apart. With starts and ends sorted each on its own, a merged span begins at
# the k-th start if the k - 1 least ends are no greater, and ends at the k-th end if the next start is no less.
_BEGINS = "filter(transform(starts, (x, i) -> if(coalesce(get(ends, i - 1) <= x, true), x, null)), x -> x is not null)"
_CLOSES = "filter(transform(ends, (x, i) -> if(coalesce(get(starts, i + 1) >= x, true), x, null)), x -> x is not null)"


def _merged(rows: DataFrame) -> DataFrame:
    ordered = rows.withColumn("starts", F.array_sort(F.transform("sorted", lambda x: x["s"]))).withColumn("ends", F.array_sort(F.transform("sorted", lambda x: x["e"])))
    return ordered.withColumn("spans", F.arrays_zip(F.expr(_BEGINS).alias("s"), F.expr(_CLOSES).alias("e"))).drop("starts", "ends")


def _prepared(entries: DataFrame, merge: bool) -> DataFrame:
    """Adds b (binary text), spans and error."""
    rows = entries.withColumn("b", F.encode("text", "UTF-8")).withColumn("sorted", F.expr(_SORTED))
    sound = F.expr("not exists(sorted, x -> x.s >= x.e)")
    rows = _merged(rows) if merge else rows.withColumn("spans", F.col("sorted"))
    inner = lambda at: f"({at} < length(b) and conv(hex(substring(b, cast({at} + 1 as int), 1)), 16, 10) between 128 and 191)"
    overlap = F.lit(False) if merge else F.expr("exists(sequence(1, size(spans)), i -> i < size(spans) and spans[i].s < spans[i - 1].e)")
    error = (F.when(~sound, "invalid_span")
             .when(F.expr("exists(sorted, x -> x.e > length(b))"), "span_out_of_bounds")
             .when(F.expr(f"exists(sorted, x -> {inner('x.s')} or {inner('x.e')})"), "invalid_utf8_boundary")
             .when((F.size("spans") > 1) & overlap, "overlapping_spans"))
    return rows.withColumn("error", error)


def _spliced(rows: DataFrame, values: Column, strict: bool) -> DataFrame:
    """content: the text between spans, joined by ``values`` (one per span); rows with an error are not cut, as their spans may lie anywhere."""
    rows = rows.withColumn("spans", F.when(F.col("error").isNull(), F.col("spans")).otherwise(F.slice("spans", 1, 0)))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["e"]))
    ends = F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.length("b").cast("long")))
    rows = rows.withColumn("parts", F.zip_with(starts, ends, lambda a, e: F.decode(F.substring(F.col("b"), (a + 1).cast("int"), (e - a).cast("int")), "UTF-8"))).withColumn("values", values)
    content = F.array_join(F.flatten(F.zip_with("parts", "values", lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    failed = F.raise_error(F.col("error")).cast("string") if strict else F.lit(None).cast("string")
    content = F.when(F.col("error").isNotNull(), failed).when(F.size("spans") == 0, F.col("text")).otherwise(content)
    return rows.select("source_key", "ordinal", content.alias("content"), "error")


def redact(entries: DataFrame, replacement: str = "[REDACTED]", strict: bool = False) -> DataFrame:
    """(source_key, ordinal, content, error): overlapping spans merge, touching ones stay apart."""
    return _spliced(_prepared(entries, True), F.transform("spans", lambda _: F.lit(replacement)), strict)


def template(entries: DataFrame, namespace: str = NAMESPACE, numbered: bool = False, strict: bool = False) -> DataFrame:
    """<NAMESPACE:rule> or <NAMESPACE:rule:n>, n counting a rule's findings in its source."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^[^A-Za-z0-9._-]+", ""), "[^A-Za-z0-9._-]+", "-"), "-+$", "")
    name = lambda x: F.when(tidy(x["r"]) == "", "finding").otherwise(tidy(x["r"]))
    head = f"<{component(namespace, NAMESPACE)}:"

    rows = _prepared(entries, False)
    if not numbered:
        return _spliced(rows, F.transform("spans", lambda x: F.concat(F.lit(head), name(x), F.lit(">"))), strict)
    # a rule's n-th finding: its place among all findings sorted by rule, less the place of the rule's first one
    rows = rows.withColumn("by_rule", F.array_sort(F.transform("spans", lambda x, i: F.struct(x["r"].alias("r"), i.alias("i")))))
    rows = rows.withColumn("kinds", F.transform("by_rule", lambda t: t["r"]))
    rows = rows.withColumn("first", F.expr("map_from_arrays(array_distinct(kinds), transform(array_distinct(kinds), r -> array_position(kinds, r)))"))
    rows = rows.withColumn("n", F.array_sort(F.expr("transform(by_rule, (t, j) -> struct(t.i as i, j + 2 - first[t.r] as n))")))
    return _spliced(rows, F.zip_with("spans", "n", lambda x, n: F.concat(F.lit(head), name(x), F.lit(":"), n["n"].cast("string"), F.lit(">"))), strict)


def keyed(entries: DataFrame, mode: ShareMode, strict: bool = False) -> DataFrame:
    """pseudonymize or synthesize (or any mode) in the kernel."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out, errors = [], []
            texts, column = batch.column("text").to_pylist(), batch.column("spans")
            flat = column.flatten()
            each = zip(*(flat.field(k).to_pylist() for k in ("s", "e", "r")))
            spans = [list(islice(each, n or 0)) for n in column.value_lengths().to_pylist()]
            known = mode.known(texts, spans)
            for text, found in zip(texts, spans):
                try:
                    out.append(mode.apply(text, found, known) if found else text)
                    errors.append(None)
                except TransformError as e:
                    if strict:
                        raise
                    out.append(None)
                    errors.append(e.kind)
            yield pa.record_batch([batch.column("source_key"), batch.column("ordinal"), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["source_key", "ordinal", "content", "error"])

    rows = entries.select("source_key", "ordinal", "text", F.expr(_SORTED).alias("spans"))
    return rows.mapInArrow(run, f"source_key {entries.schema['source_key'].dataType.simpleString()}, ordinal long, content string, error string")


def pseudonymize(entries: DataFrame, key: bytes, strict: bool = False, **options: object) -> DataFrame:
    return keyed(entries, ShareMode("pseudonymize", {"key": key, **options}), strict)


def synthesize(entries: DataFrame, key: bytes, strict: bool = False, **options: object) -> DataFrame:
    return keyed(entries, ShareMode("synthesize", {"key": key, **options}), strict)


def apply_mode(entries: DataFrame, mode: ShareMode, strict: bool = True) -> DataFrame:
    native = {"redact": redact, "template": template}
    return native[mode.kind](entries, strict=strict, **mode.options) if mode.kind in native else keyed(entries, mode, strict)


def bundle(entries: DataFrame, mode: ShareMode, generated_at: datetime | None = None, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sources(key, content), one-row manifest(mode, summary, generated_at)) of one scan; any row that fails, fails the bundle.

    Sources come by ordinal, then key. ``ordered``: entries already do, as a
    scan keeps the order of what it reads; that is the cheaper way, since only
    narrow rows are moved. Else the texts are dealt out before the sort, so
    that its bounds are sampled from them and not by a second scan.
    """
    wrong = F.octet_length("text") != F.col("source_bytes")
    checked = entries.withColumn("text", F.when(wrong, F.raise_error(F.lit("source_mismatch")).cast("string")).otherwise(F.col("text")))
    srcs = apply_mode(checked, mode)
    srcs = srcs if ordered else srcs.repartition(partitions(srcs)).orderBy("ordinal", "source_key")
    srcs = srcs.select(F.col("source_key").alias("key"), "content")
    at = F.lit(generated_at).cast("timestamp") if generated_at else F.current_timestamp()
    manifest = summary(entries).select(F.lit(mode.kind).alias("mode"), F.struct("*").alias("summary"), at.alias("generated_at"))
    return srcs, manifest
