"""Sources derived from the orders table by one expression that Spark and DuckDB both read.

Order key modulo 8 picks what a text holds: a platform token, a payment key, a
password, a bearer token, a grouped code, nothing, a cloud key id, or a hash
next to a platform token. Every text has a non-ASCII character before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import spread

_H = "md5(cast(o_orderkey as varchar(20)))"
TEXT = f"""concat('# order ', cast(o_orderkey as varchar(20)), ' café', chr(10), case o_orderkey % 8
 when 0 then concat('GITHUB_TOKEN=ghp_', {_H})
 when 1 then concat('key: sk_live_', substr({_H}, 1, 24), ' end')
 when 2 then concat('password = "', substr({_H}, 1, 12), '"')
 when 3 then concat('ü token: ', {_H}, chr(10), 'done')
 when 4 then concat('code ', upper(substr({_H}, 1, 3)), 'Z-', upper(substr({_H}, 5, 4)), '-', upper(substr({_H}, 9, 4)), '-', upper(substr({_H}, 13, 4)), ' kept')
 when 5 then concat('status ', o_orderpriority)
 when 6 then concat('id AKIA', upper(substr({_H}, 1, 16)), ';')
 else concat('password_hash=', {_H}, chr(13), chr(10), 'next ghp_', {_H}) end, chr(10))"""


def sources(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority"), *["o_orderkey"] * ordered)
    return orders.select(F.col("o_orderkey").alias("source_key"), F.col("o_orderkey").cast("long").alias("ordinal"), F.expr(TEXT).alias("text"))


# DuckDB: the findings that the rules' definitions give on these texts, found by pattern and position.
_RULES = (
    ("github.classic-pat", "(?:^|[^A-Za-z0-9_-])(ghp_[A-Za-z0-9_]{20,})", "critical", 4, "high", 2, "revoke_and_rotate_credential", 500, "deterministic"),
    ("stripe.live-secret-key", "(?:^|[^A-Za-z0-9_-])(sk_live_[A-Za-z0-9_]{16,})", "critical", 4, "high", 2, "revoke_and_rotate_credential", 500, "deterministic"),
    ("generic.password-field", 'password = "([^"\\s]{8,})"', "high", 3, "medium", 1, "rotate_password", 200, "contextual"),
    ("generic.auth-token", "(?:^|[^A-Za-z0-9_.-])token: ([0-9a-f]{16,})", "high", 3, "medium", 1, "rotate_credential", 100, "contextual"),
    ("aws.access-key-id", "(?:^|[^A-Za-z0-9_-])(AKIA[A-Z0-9]{16})(?:[^A-Za-z0-9_-]|$)", "high", 3, "high", 2, "revoke_and_rotate_credential", 500, "contextual"),
    ("generic.sensitive-hash", "password_hash=([0-9a-f]{32})", "medium", 2, "medium", 1, "review_sensitive_hash", 200, "contextual"),
)
_PLACE = "cast(strlen(substr(text, 1, strpos(text, v) - 1)) as bigint) as \"start\", cast(strlen(substr(text, 1, strpos(text, v) - 1)) + strlen(v) as bigint) as \"end\", cast(1 + length(substr(text, 1, strpos(text, v) - 1)) - length(replace(substr(text, 1, strpos(text, v) - 1), chr(10), '')) as bigint) as line, cast(strpos(text, v) - coalesce(length(regexp_extract(substr(text, 1, strpos(text, v) - 1), '(?s)^.*\\n')), 0) as bigint) as \"column\""

_Q = "'"


def _rule_sql(rule: tuple) -> str:
    rule_id, rx, sev, so, conf, co, rem, prio, mode = rule
    return (f"select source_key, text, '{rule_id}' as rule_id, regexp_extract(text, {_Q}{rx}{_Q}, 1) as v, '{sev}' as severity, {so} as severity_ord, '{conf}' as confidence, {co} as confidence_ord, "
            f"'{rem}' as remediation, {prio} as priority, '{mode}' as detection_mode from src")


SQL = f"""with src as (select o_orderkey as source_key, {TEXT} as text from orders),
hits as ({' union all '.join(map(_rule_sql, _RULES))}),
found as (select source_key, text, rule_id, v, severity, severity_ord, confidence, confidence_ord, remediation, priority, detection_mode, {_PLACE} from hits where v <> ''),
codes as (select source_key, text, regexp_extract(text, '(?:^|[^A-Za-z0-9-])((?:[A-Z0-9]{{4}}-){{3}}[A-Z0-9]{{4}})(?:[^A-Za-z0-9-]|$)', 1) as v from src),
review as (select source_key, 'recovery_like_code' as kind, 'structural' as evidence, {_PLACE} from codes where v <> '' and not regexp_full_match(replace(v, '-', ''), '[0-9A-F]+')),
entries as (select source_key, cast(strlen(text) as bigint) as source_bytes, (select count(*) from found f where f.source_key = src.source_key) as nf, (select count(*) from review r where r.source_key = src.source_key) as nc from src)
"""
