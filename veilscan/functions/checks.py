"""Token checks as Catalyst columns, for filters and quick counts without the kernel.

Each takes a column that holds one matched token and says whether the rule
family's check accepts it (placeholders aside, which need the kernel's lists).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel.engine import Scanner, default_scanner

FORMS = {
    "github": "(github_pat_|gh[opusr]_)[A-Za-z0-9_]{20,}|ghs_[0-9]+_[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+",
    "gitlab": "(glagent|glrtr|glsoat|glffct|glpat|gloas|gldt|glrt|glcbt|glptt|glft|glimt|glwt)-[A-Za-z0-9_]{8,}",
    "stripe": "([sr]k_(live|test)_|whsec_)[A-Za-z0-9_]{16,}",
    "cloudflare": "cf(k|ut|at)_[A-Za-z0-9]{40}[0-9a-fA-F]{8}",
    "telegram": "[0-9]{5,20}:[A-Za-z0-9_-]{20,128}",
    "rubygems": "rubygems_[0-9a-fA-F]{32,}",
    "aws": "(AKIA|ASIA)[A-Z0-9]{16}",
}


def has_form(token: Column, family: str) -> Column:
    return token.rlike(f"^(?:{FORMS[family]})$")


def prefix_tokens(text: Column, needle: str) -> Column:
    """All tokens that begin with the needle at a token boundary."""
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in needle)
    return F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9_-]){quoted}[A-Za-z0-9_-]*"), 0)


def luhn(digits: Column) -> Column:
    return F.luhn_check(digits)


def register(spark: SparkSession, name: str = "veil_scan", scanner: Scanner | None = None) -> None:
    """SELECT * FROM t, LATERAL veil_scan(t.text): findings of one text as rows, for SQL users."""
    held = scanner or default_scanner()

    class Scan:
        def eval(self, text: str):  # noqa: ANN202
            for f in held.report(text or "")[0]:
                p = f["location"]
                yield f["rule_id"], p["start"], p["end"], p["line"], p["column"], f["severity"], f["confidence"], f["remediation"]

    kinds = [("rule_id", T.StringType()), *((n, T.LongType()) for n in ("start", "end", "line", "column")), ("severity", T.StringType()), ("confidence", T.StringType()), ("remediation", T.StringType())]
    spark.udtf.register(name, F.udtf(Scan, returnType=T.StructType([T.StructField(n, k) for n, k in kinds])))
