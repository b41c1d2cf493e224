"""Shapes of sources, findings, candidates and reports, and the orders of their enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
KINDS = ("literal", "prefix", "suffix", "pattern")
MODES = ("matcher_only", "deterministic", "contextual")

# Advice by remediation, as (label, message).
REMEDIATIONS = {
    "revoke_and_rotate_credential": ("Revoke and rotate credential", "Revoke and rotate this credential. If it was committed or shared, treat it as exposed."),
    "rotate_credential": ("Rotate credential", "Rotate this credential and replace every active use of the previous value."),
    "rotate_password": ("Rotate password", "Replace this password or passphrase and update every system that still uses it."),
    "replace_private_key": ("Replace private key", "Replace this private key and retire the previous key wherever it is trusted."),
    "remove_sensitive_value": ("Remove sensitive value", "Remove this sensitive value before storing, publishing, or sharing this content."),
    "review_sensitive_hash": ("Review sensitive hash", "Review whether this hash represents sensitive information before sharing it."),
    "review_password_verifier": ("Review exposed password verifier", "Review this exposed password verifier and remove it from material that should not contain authentication data."),
}

LOCATION = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "end", "line", "column")])

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("location", LOCATION, False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("severity_ord", T.IntegerType(), False),
    T.StructField("confidence", T.StringType(), False),
    T.StructField("confidence_ord", T.IntegerType(), False),
    T.StructField("remediation", T.StringType(), True),
])

CANDIDATE = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("location", LOCATION, False),
    T.StructField("evidence", T.StringType(), False),
])

FINDINGS, CANDIDATES = T.ArrayType(FINDING, False), T.ArrayType(CANDIDATE, False)

SUMMARY_FIELDS = (
    "scanned_sources", "scanned_bytes", "reports_with_findings", "reports_without_findings", "total_findings", "total_candidates",
    "reports_with_candidates", "critical", "high", "medium", "low", "info",
)
