"""Filtering, ordering and summing up findings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..model import CONFIDENCES, SEVERITIES
from .scan import findings

#: Sort name -> primary columns. Ties always ascend by key, location, rule, severity, confidence.
SORTS = {"rule_id": ["rule_id"], "source": ["source_key"], "severity": ["severity_ord"], "confidence": ["confidence_ord"], "location": ["start", "end", "line", "column"]}
_TIES = ["source_key", "start", "end", "line", "column", "rule_id", "severity_ord", "confidence_ord"]


def severity_ord(name: str) -> int:
    return SEVERITIES.index(name)


def confidence_ord(name: str) -> int:
    return CONFIDENCES.index(name)


@dataclass(frozen=True)
class Query:
    """Constraints on the findings of entries, one slot per dimension: a later constraint replaces an earlier one. All must hold."""

    entries: DataFrame
    by_severity: Column | None = None
    by_confidence: Column | None = None
    by_rule: Column | None = None

    def severity(self, name: str) -> Query:
        return replace(self, by_severity=F.col("severity_ord") == severity_ord(name))

    def min_severity(self, name: str) -> Query:
        return replace(self, by_severity=F.col("severity_ord") >= severity_ord(name))

    def confidence(self, name: str) -> Query:
        return replace(self, by_confidence=F.col("confidence_ord") == confidence_ord(name))

    def min_confidence(self, name: str) -> Query:
        return replace(self, by_confidence=F.col("confidence_ord") >= confidence_ord(name))

    def rule_id(self, rule_id: str) -> Query:
        return replace(self, by_rule=F.col("rule_id") == rule_id)

    def critical(self) -> Query:
        return self.severity("critical")

    def high_priority(self) -> Query:
        return self.min_severity("high")

    def high_confidence(self) -> Query:
        return self.confidence("high")

    def rows(self) -> DataFrame:
        """Matching findings, flat and unordered."""
        out = findings(self.entries)
        for c in (self.by_severity, self.by_confidence, self.by_rule):
            if c is not None:
                out = out.where(c)
        return out

    def ordered(self) -> DataFrame:
        """Source order, then report order."""
        return self.rows().orderBy("ordinal", "source_key", "pos")

    def sort(self, by: str, descending: bool = False) -> DataFrame:
        """The order of SORTS; only the primary columns descend."""
        primary = [F.desc(c) if descending else F.asc(c) for c in SORTS[by]]
        return self.rows().orderBy(*primary, *[c for c in _TIES if c not in SORTS[by]])

    def sort_keys(self, by: str, descending: bool = False) -> list[Column]:
        primary = [F.desc(c) if descending else F.asc(c) for c in SORTS[by]]
        return [*primary, *[F.asc(c) for c in _TIES if c not in SORTS[by]]]

    def count(self) -> int:
        return self.rows().count()

    def first(self) -> Row | None:
        return self.ordered().first()

    def last(self) -> Row | None:
        return self.rows().orderBy(F.desc("ordinal"), F.desc("source_key"), F.desc("pos")).first()

    def has_matches(self) -> bool:
        return not self.is_empty()

    def is_empty(self) -> bool:
        return self.rows().isEmpty()

    def collect(self) -> list[Row]:
        return self.ordered().collect()


def total_bytes(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("total_findings"), F.coalesce(F.sum(F.size("candidates")), F.lit(0)).cast("long").alias("total_candidates"))


def has_critical(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.bool_or(F.exists("findings", lambda f: f["severity"] == "critical")), F.lit(False)).alias("has_critical"))


def failed(entries: DataFrame) -> DataFrame:
    """Entries with a finding."""
    return entries.where(F.size("findings") > 0)


def review(entries: DataFrame) -> DataFrame:
    """Entries without findings but with candidates."""
    return entries.where((F.size("findings") == 0) & (F.size("candidates") > 0))


def clean(entries: DataFrame) -> DataFrame:
    """Entries with neither."""
    return entries.where((F.size("findings") == 0) & (F.size("candidates") == 0))


def single_report(entries: DataFrame) -> Row | None:
    """The entry, if there is exactly one."""
    two = entries.limit(2).collect()
    return two[0] if len(two) == 1 else None


def report_helpers(entries: DataFrame) -> DataFrame:
    """Per entry: counts by severity, has_critical, needs_review, is_empty (looks at findings only), status."""
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    has = F.size("findings") > 0
    some = F.size("candidates") > 0
    return entries.select(
        "source_key", *[count(s).alias(s) for s in reversed(SEVERITIES)], F.size("findings").cast("long").alias("len"), F.size("candidates").cast("long").alias("candidate_len"),
        F.exists("findings", lambda f: f["severity"] == "critical").alias("has_critical"), some.alias("needs_review"), (~has).alias("is_empty"),
        F.when(has, "findings").when(some, "review").otherwise("clean").alias("status"),
    )


def finding_helpers(rows: DataFrame) -> DataFrame:
    """Adds is_critical, is_high_priority, is_high_confidence and byte_len to flat findings."""
    return rows.select("*", (F.col("severity") == "critical").alias("is_critical"), (F.col("severity_ord") >= severity_ord("high")).alias("is_high_priority"), (F.col("confidence") == "high").alias("is_high_confidence"), (F.col("end") - F.col("start")).alias("byte_len"))


def summary(entries: DataFrame) -> DataFrame:
    """One row of twelve counters, in one aggregation."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    flag = lambda c: total(F.when(c, 1).otherwise(0))
    of = lambda s: total(F.size(F.filter("findings", lambda f: f["severity"] == s)))
    return entries.agg(
        F.count("*").alias("scanned_sources"), total("source_bytes").alias("scanned_bytes"), flag(F.size("findings") > 0).alias("reports_with_findings"), flag(F.size("findings") == 0).alias("reports_without_findings"),
        total(F.size("findings")).alias("total_findings"), total(F.size("candidates")).alias("total_candidates"), flag(F.size("candidates") > 0).alias("reports_with_candidates"), *[of(s).alias(s) for s in reversed(SEVERITIES)],
    )


def summary_helpers(row: DataFrame) -> DataFrame:
    """Adds is_clean (neither findings nor candidates), has_candidates and has_critical to a summary."""
    return row.select("*", ((F.col("total_findings") == 0) & (F.col("total_candidates") == 0)).alias("is_clean"), (F.col("total_candidates") > 0).alias("has_candidates"), (F.col("critical") > 0).alias("has_critical"))


def explain(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds detection_mode and advice to flat findings from the rule dimension; null where the scanner does not own the rule as found."""
    r = rules.select(F.col("rule_id").alias("_id"), F.col("severity").alias("_severity"), F.col("remediation").alias("_remediation"), "detection_mode", "remediation_label", "remediation_message")
    # a scanner's rules: at most a few hundred rows
    joined = rows.join(F.broadcast(r), (F.col("rule_id") == F.col("_id")) & (F.col("severity") == F.col("_severity")) & F.col("remediation").eqNullSafe(F.col("_remediation")), "left")
    return joined.withColumn("is_classified", F.col("detection_mode").isNotNull()).drop("_id", "_severity", "_remediation")


def explain_candidates(rows: DataFrame) -> DataFrame:
    """Candidates are ambiguous: their evidence is all there is."""
    return rows.select("*", F.col("evidence").alias("candidate_evidence"), F.lit(True).alias("is_ambiguous"))
