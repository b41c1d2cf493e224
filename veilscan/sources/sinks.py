"""Reports as JSON, text and bundles; never with matched text."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.engine import Scanner
from ..kernel.validators import CHECKS
from ..model import REMEDIATIONS


def report_json(entries: DataFrame) -> DataFrame:
    """(source_key, json): status, counts, findings and candidates; an absent remediation is left out."""
    f = F.transform("findings", lambda x: F.struct(x["rule_id"].alias("rule_id"), x["location"]["start"].alias("start"), x["location"]["end"].alias("end"), x["location"]["line"].alias("line"), x["location"]["column"].alias("column"), x["severity"].alias("severity"), x["confidence"].alias("confidence"), x["remediation"].alias("remediation")))
    status = F.when(F.size("findings") > 0, "findings").when(F.size("candidates") > 0, "review").otherwise("clean")
    body = F.struct(F.col("source_key").cast("string").alias("source"), status.alias("status"), F.size("findings").alias("findings_count"), F.size("candidates").alias("candidates_count"), f.alias("findings"), F.col("candidates"))
    return entries.select("source_key", F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))


def display_findings(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Flat findings with ``display``: severity, confidence, rule, place and advice in one line."""
    r = rules.select(F.col("rule_id").alias("_id"), "remediation_label")  # a scanner's rules: a few hundred rows
    joined = rows.join(F.broadcast(r), F.col("rule_id") == F.col("_id"), "left").drop("_id")
    line = F.format_string("%s · %s confidence · %s · %d:%d", "severity", "confidence", "rule_id", "line", "column")
    return joined.withColumn("display", F.concat(line, F.coalesce(F.concat(F.lit(" · "), "remediation_label"), F.lit("")))).drop("remediation_label")


def display_summary(row: DataFrame) -> DataFrame:
    """A summary with ``display``, nine lines of text."""
    form = "sources: %d (with findings: %d, without findings: %d)\nbytes: %d\nfindings: %d\nambiguous candidates: %d (reports: %d)\ncritical: %d\nhigh: %d\nmedium: %d\nlow: %d\ninfo: %d"
    return row.withColumn("display", F.format_string(form, "scanned_sources", "reports_with_findings", "reports_without_findings", "scanned_bytes", "total_findings", "total_candidates", "reports_with_candidates", "critical", "high", "medium", "low", "info"))


def report_text(entries: DataFrame) -> DataFrame:
    """(source_key, text): the report for people, as ``render_text`` gives it for one source, as Catalyst expressions."""
    status = F.when(F.size("findings") > 0, "findings").when(F.size("candidates") > 0, "review").otherwise("clean")
    place = lambda x: F.format_string("%d:%d bytes=%d..%d", x["location"]["line"], x["location"]["column"], x["location"]["start"], x["location"]["end"])
    head = F.array(F.concat(F.lit("source: "), F.col("source_key").cast("string")), F.concat(F.lit("status: "), status), F.format_string("findings: %d", F.size("findings")), F.format_string("candidates: %d", F.size("candidates")))
    found = F.transform("findings", lambda f: F.format_string("finding: %s %s severity=%s confidence=%s remediation=%s", f["rule_id"], place(f), f["severity"], f["confidence"], F.coalesce(f["remediation"], F.lit("none"))))
    review = F.transform("candidates", lambda c: F.format_string("candidate: %s kind=%s evidence=%s", place(c), c["kind"], c["evidence"]))
    return entries.select("source_key", F.concat(F.array_join(F.concat(head, found, review), "\n"), F.lit("\n")).alias("text"))


def status_of(found: list[dict], review: list[dict]) -> str:
    return "findings" if found else "review" if review else "clean"


def render_json(name: str, found: list[dict], review: list[dict], chosen: list[dict] | None = None, scanner: Scanner | None = None) -> str:
    modes = {r.id: CHECKS[r.validator][3] for r in scanner.rules} if scanner else None
    row = lambda f: {"rule_id": f["rule_id"], **f["location"], "severity": f["severity"], "confidence": f["confidence"], "remediation": f["remediation"]} | ({"detection_mode": modes.get(f["rule_id"])} if modes else {})
    out: dict = {"source": name, "status": status_of(found, review), "findings_count": len(found), "candidates_count": len(review)}
    if chosen is not None:
        out["selection"] = {"active": True, "findings_count": len(chosen)}
    out["findings"] = [row(f) for f in (found if chosen is None else chosen)]
    out["candidates"] = [{**c["location"], "kind": c["kind"], "evidence": c["evidence"]} for c in review]
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False)


def render_text(name: str, found: list[dict], review: list[dict], chosen: list[dict] | None = None, scanner: Scanner | None = None) -> str:
    modes = {r.id: CHECKS[r.validator][3] for r in scanner.rules} if scanner else None
    out = [f"source: {name}", f"status: {status_of(found, review)}", f"findings: {len(found)}", f"candidates: {len(review)}"]
    if chosen is not None:
        out.append(f"selected findings: {len(chosen)}")
    place = lambda x: "{line}:{column} bytes={start}..{end}".format(**x["location"])
    for f in found if chosen is None else chosen:
        out.append(f"finding: {f['rule_id']} {place(f)} severity={f['severity']} confidence={f['confidence']} remediation={f['remediation'] or 'none'}" + (f" detection={modes.get(f['rule_id'], 'unknown')}" if modes else ""))
    out += [f"candidate: {place(c)} kind={c['kind']} evidence={c['evidence']}" for c in review]
    return "\n".join(out) + "\n"


def manifest_json(mode: str, paths: list[str], summary: dict[str, int]) -> str:
    return json.dumps({"schema_version": 1, "mode": mode, "sources": paths, "summary": summary}, separators=(",", ":")) + "\n"


def write_bundle_local(folder: str, mode: str, contents: list[str], summary: dict[str, int]) -> None:
    """sources/NNNN.txt and manifest.json; the folder appears whole and must not exist before."""
    if os.path.lexists(folder):
        raise FileExistsError(folder)
    made = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(folder)), prefix=".bundle-")
    os.mkdir(f"{made}/sources")
    paths = [f"sources/{i:04d}.txt" for i in range(1, len(contents) + 1)]
    for path, text in zip(paths, contents):
        with open(f"{made}/{path}", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    with open(f"{made}/manifest.json", "w", encoding="utf-8") as f:
        f.write(manifest_json(mode, paths, summary))
    os.rename(made, folder)


def write_bundle(srcs: DataFrame, manifest: DataFrame, folder: str) -> None:
    """A bundle of any size by Spark's writers: sources as Parquet, the manifest as one JSON row. Fails if it exists."""
    srcs.write.mode("errorifexists").parquet(f"{folder}/sources")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")


def advice(remediation: str | None) -> tuple[str, str] | None:
    return REMEDIATIONS.get(remediation) if remediation else None
