"""Rules compiled into a scanner of texts.

Offsets are code points inside; reports give UTF-8 bytes, lines and columns.
A column of texts first meets one gate, an automaton that runs at memory speed
over the whole Arrow buffer: texts without anything that some rule needs are
never turned into Python strings.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    import ahocorasick
except ImportError:  # then needles are looked for one after the other
    ahocorasick = None

from ..catalog import CATALOGS, CURRENT, HINTS, RuleSpec
from ..model import CONFIDENCES, REMEDIATIONS, SEVERITIES
from .dialect import RuleError, translate
from .validators import CHECKS, Context, placeholder, size

SUFFIX_BYTES = 4096
_TOKEN = "[A-Za-z0-9_-]"
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


class ScannerError(ValueError):
    """Rules that cannot be built into a scanner; ``kind`` names the reason."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


@dataclass(frozen=True)
class Rule:
    """A rule of the user's own; use literal, prefix, suffix or pattern to make one."""

    id: str
    kind: str
    value: str
    severity: str
    remediation: str | None = None

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or not (self.remediation is None or self.remediation in REMEDIATIONS):
            raise RuleError("unknown severity or remediation", "invalid_rule")

    @classmethod
    def literal(cls, id: str, value: str, severity: str) -> Rule:  # noqa: A002
        return cls(id, "literal", value, severity)

    @classmethod
    def prefix(cls, id: str, value: str, severity: str) -> Rule:  # noqa: A002
        return cls(id, "prefix", value, severity)

    @classmethod
    def suffix(cls, id: str, value: str, severity: str) -> Rule:  # noqa: A002
        return cls(id, "suffix", value, severity)

    @classmethod
    def pattern(cls, id: str, value: str, severity: str) -> Rule:  # noqa: A002
        if re._parser.parse(translate(value)).getwidth()[0] == 0:
            raise RuleError("pattern matches the empty text", "pattern_matches_empty")
        return cls(id, "pattern", value, severity)

    def with_remediation(self, remediation: str) -> Rule:
        return Rule(self.id, self.kind, self.value, self.severity, remediation)

    @property
    def validator(self) -> str:
        return "none"

    @property
    def public_kind(self) -> str:
        return self.kind


AnyRule = Rule | RuleSpec


class Match(NamedTuple):
    """An accepted match: rule number, code-point span and confidence."""

    rule: int
    start: int
    end: int
    confidence: str


# What a text must hold, in lower case, for a rule without hints to be able to match and pass its check.
_NEEDS = {
    "telegram.bot-token": (":",), "jwt.signed-compact": ("eyj",), "github.stateless-installation-token": ("ghs_",),
    "generic.pkcs8-private-key": ("-----begin private",), "generic.encrypted-private-key": ("-----begin encrypted",), "generic.rsa-private-key": ("-----begin rsa",),
    "generic.ec-private-key": ("-----begin ec",), "generic.openssh-private-key": ("-----begin openssh",), "generic.pgp-private-key": ("-----begin pgp",),
    "composer.bearer-token": ('"bearer"', "\\u"), "system.shadow-password-verifier": (":$",), "system.htpasswd-password-verifier": (":$",), "mfa.otp-provisioning-secret": ("otp",),
    "financial.pan": ("pan", "account", "card"), "financial.card-verification-code": ("cv", "cid", "card"), "personal.uk-nhs-number": ("nhs",), "personal.us-ssn": ("ssn", "social"),
}

#: A letter that every match of a rule begins with, for rules that no word of _NEEDS tells apart.
_FIRST = {"nats.nkey-seed": "S", "nats.nkey-private-key": "P"}

# Part of the gate, for RE2: what every match of a rule holds, where that says more than its needles do.
_BLANK = r"[\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_GATES = {
    "telegram.bot-token": r"[0-9]{5}:[A-Za-z0-9_-]{20}", "jwt.signed-compact": r"eyJ[A-Za-z0-9_-]*\.", "nats.nkey-seed": "S[A-Z2-7]{57}", "nats.nkey-private-key": "P[A-Z2-7]{57}",
    "docker.registry-auth": f'"auth"{_BLANK}:', "npm.registry-auth-token": "(?i:/:_auth)", "npm.registry-auth": "(?i:/:_auth)", "npm.registry-password": "(?i:/:_password)",
    "cargo.registry-token": r"token[ \t]*=", "pypi.repository-token": r"(?i:password)[ \t]*=", "netrc.password": r"password[ \t]", "swiftpm.netrc-password": r"password[ \t]",
    "generic.authorization-basic": f"(?i:authorization)[\"']?{_BLANK}:", "wireguard.private-key": f"(?i:privatekey){_BLANK}=", "wireguard.preshared-key": f"(?i:presharedkey){_BLANK}=",
    "mfa.otp-provisioning-secret": "(?i:otp(?:[_.-]secret|auth))", "system.shadow-password-verifier": r":\$[56y]\$", "system.htpasswd-password-verifier": r":\$(?:apr1|2[aby])\$",
    "financial.iban": "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", "personal.it-codice-fiscale": "[A-Z0-9]{16}", "personal.pl-pesel": "[0-9]{11}", "financial.pan": "[0-9]{10}", "financial.card-verification-code": "(?i:cv|cid|card)",
}
#: Rules whose pattern is one of its words, perhaps a quote, blanks, then = or :.
_ASSIGNED = {"aws.secret-access-key", "aws.session-token", "azure.client-secret", "azure.storage-account-key", "azure.shared-access-signature", "gcp.private-key-id", "gcp.private-key", "gcp.escaped-private-key", "generic.password-field", "generic.database-password-field", "generic.passphrase-field", "generic.sensitive-hash", "generic.api-key", "generic.auth-token", "generic.authorization-bearer", "generic.secret"}
_REVIEW_GATE = "(?:[A-Z0-9]{4}-){3}[A-Z0-9]{4}"


def _gate(rule: AnyRule) -> str | None:
    """For RE2: every text that the rule matches holds this; None if nothing is known."""
    if rule.kind in ("literal", "prefix", "suffix"):
        return re.escape(rule.value)
    if not isinstance(rule, RuleSpec):
        return None
    words = "|".join(map(re.escape, HINTS.get(rule.id) or _NEEDS.get(rule.id) or ()))
    if rule.id in _ASSIGNED:
        return f"(?i:{words})[\"']?{_BLANK}[:=]"
    return _GATES.get(rule.id) or (f"(?i:{words})" if words else None)


def _rows_with(col: pa.Array, pattern: str) -> pa.Array:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(col, pattern), False))


class Found(NamedTuple):
    """Findings and candidates of a column, flat: row of the column, then the place; findings also their rule's number."""

    rows: list[int]
    rules: list[int]
    places: list[tuple[int, int, int, int]]
    review_rows: list[int]
    review_places: list[tuple[int, int, int, int]]


class Scanner:
    """Immutable; built by ScannerBuilder or ``catalog``. Safe to pickle: compiled parts are made where it is used."""

    def __init__(self, rules: tuple[AnyRule, ...]) -> None:
        self.rules = rules
        self._made: _Plan | None = None

    def __reduce__(self) -> tuple:
        return Scanner, (self.rules,)

    @property
    def plan(self) -> _Plan:
        if self._made is None:
            self._made = _plan(self.rules)
        return self._made

    def matches(self, text: str, raw: list[tuple[int, int, int]] | None = None) -> list[Match]:
        """Accepted matches before normalisation, in no particular order."""
        checks = self.plan.checks
        return [Match(rule, start, end, checks[rule][2]) for rule, start, end in (self.plan.raw(text) if raw is None else raw) if checks[rule][0](Context(text, start, end))]

    def rank(self, m: Match) -> tuple:
        return (m.start, m.end, *self.plan.ranks[m.rule])

    def resolve(self, found: list[Match]) -> list[Match]:
        """Of matches on one span only those of the highest priority stay; ties stay, overlaps stay."""
        if len(found) < 2:
            return found
        best: dict[tuple[int, int], int] = {}
        ranks = self.plan.ranks
        for m in found:
            span = m.start, m.end
            best[span] = min(best.get(span, 0), ranks[m.rule][0])
        return sorted((m for m in found if ranks[m.rule][0] == best[m.start, m.end]), key=self.rank)

    def findings(self, text: str) -> list[Match]:
        return self.resolve(self.matches(text))

    def both(self, text: str, suppress: bool = True, matches: list[Match] | None = None, codes: bool | list[tuple[int, int]] = True) -> tuple[list[Match], list[tuple[int, int]]]:
        """Findings, and the spans of candidates; with ``suppress`` without those that a finding overlaps. ``codes``: spans already found."""
        found = self.findings(text) if matches is None else self.resolve(matches)
        spans = codes if isinstance(codes, list) else list(review_spans(text)) if codes else []
        if not suppress or not spans or not found:
            return found, spans
        free, at, reach = [], 0, -1
        for s, e in spans:
            while at < len(found) and found[at].start < e:
                reach = max(reach, found[at].end)
                at += 1
            if reach <= s:
                free.append((s, e))
        return found, free

    def rows(self, text: str, found: list[Match], spans: list[tuple[int, int]]) -> tuple[list[dict], list[dict]]:
        if not found and not spans:
            return [], []
        where = Coordinates(text)
        rows = []
        for m in found:
            rule = self.rules[m.rule]
            rows.append({"rule_id": rule.id, "location": where.location(m.start, m.end), "severity": rule.severity, "severity_ord": SEVERITIES.index(rule.severity), "confidence": m.confidence, "confidence_ord": CONFIDENCES.index(m.confidence), "remediation": rule.remediation})
        return rows, [{"kind": "recovery_like_code", "location": where.location(s, e), "evidence": "structural"} for s, e in spans]

    def report_json(self, text: str, found: list[Match], spans: list[tuple[int, int]]) -> str:
        """``rows`` as one JSON object, written as json.dumps writes it."""
        if not found and not spans:
            return '{"findings": [], "candidates": []}'
        where, ends = Coordinates(text), self.plan.json_ends
        place = lambda s, e: '"location": {"start": %d, "end": %d, "line": %d, "column": %d}' % where.place(s, e)
        rows = ", ".join([f"{ends[m.rule][0]}{place(m.start, m.end)}{ends[m.rule][1]}" for m in found])
        review = ", ".join([f'{{"kind": "recovery_like_code", {place(s, e)}, "evidence": "structural"}}' for s, e in spans])
        return f'{{"findings": [{rows}], "candidates": [{review}]}}'

    def report(self, text: str) -> tuple[list[dict], list[dict]]:
        """(findings, candidates) as rows of model.FINDING and model.CANDIDATE."""
        return self.rows(text, *self.both(text))

    def possible(self, col: pa.Array) -> pa.Array:
        """Rows of a string column that may hold a finding or a candidate."""
        return pa.array(np.arange(len(col))) if self.plan.gate is None else _rows_with(col, self.plan.gate)

    def column(self, col: pa.Array, suppress: bool = True) -> Found:
        out = Found([], [], [], [], [])
        rows = self.possible(col)
        some = col.take(rows)
        codes = set(_rows_with(some, _REVIEW_GATE).to_pylist())
        for i, row in enumerate(rows.to_pylist()):
            text = some[i].as_py() or ""
            found, spans = self.both(text, suppress, codes=i in codes)
            if found or spans:
                where = Coordinates(text)
                for m in found:
                    out.rows.append(row)
                    out.rules.append(m.rule)
                    out.places.append(where.place(m.start, m.end))
                for s, e in spans:
                    out.review_rows.append(row)
                    out.review_places.append(where.place(s, e))
        return out


class _Plan:
    """Regular expressions and needles of one rule list."""

    def __init__(self, rules: tuple[AnyRule, ...]) -> None:
        self.prefixes: dict[str, list[int]] = {}
        self.literals: list[tuple[int, str]] = []
        self.suffixes: list[tuple[int, str]] = []
        self.patterns: list[tuple[int, re.Pattern, bool, re.Pattern | None]] = []
        self.needles: dict[str, list[int]] = {}
        self.always: list[tuple[int, str]] = []
        self.hinted: dict[str, list[tuple[int, int]]] = {}  # hint -> patterns tried there, and the hint's place among the pattern's own
        self.checks = [CHECKS[r.validator] for r in rules]
        self.ranks = [(-CHECKS[r.validator][1], -CONFIDENCES.index(CHECKS[r.validator][2]), -SEVERITIES.index(r.severity), r.id) for r in rules]
        after = [{"severity": r.severity, "severity_ord": SEVERITIES.index(r.severity), "confidence": c[2], "confidence_ord": CONFIDENCES.index(c[2]), "remediation": r.remediation} for r, c in zip(rules, self.checks)]
        self.json_ends = [(f'{{"rule_id": {json.dumps(r.id)}, ', f", {json.dumps(a)[1:]}") for r, a in zip(rules, after)]
        for i, rule in enumerate(rules):
            built_in = isinstance(rule, RuleSpec)
            if rule.kind == "prefix":
                self.prefixes.setdefault(rule.value, []).append(i)
            elif rule.kind == "literal":
                self.literals.append((i, rule.value))
            elif rule.kind == "suffix":
                self.suffixes.append((i, rule.value))
            else:
                hints = HINTS.get(rule.id) if built_in else None
                tries = re.compile("|".join(map(re.escape, hints)), re.I | re.A) if hints else None
                needs = hints or (_NEEDS.get(rule.id) if built_in else None)
                for k, n in enumerate(needs or ()):
                    self.needles.setdefault(n, []).append(len(self.patterns))
                    if hints:
                        self.hinted.setdefault(n, []).append((len(self.patterns), k))
                if not needs:
                    self.always.append((len(self.patterns), _FIRST.get(rule.id, "") if built_in else ""))
                self.patterns.append((i, re.compile(translate(rule.value)), rule.kind == "capture", tries))
        self.automaton = None
        self.low_prefixes: dict[str, list[str]] = {}
        for p in self.prefixes:
            self.low_prefixes.setdefault(p.lower(), []).append(p)
        words = {*self.needles, *self.low_prefixes}
        if ahocorasick and len(words) > 16:
            self.automaton = ahocorasick.Automaton()
            for n in words:
                self.automaton.add_word(n, (n, len(n), self.hinted.get(n)))
            self.automaton.make_automaton()
        self.token_rx = re.compile(_TOKEN + "*")
        self.head_rx = re.compile(_TOKEN + r"*\Z")
        gates = {_gate(r) for r in rules} | {_REVIEW_GATE}
        try:
            self.gate = None if None in gates else "|".join(f"(?:{g})" for g in sorted(gates))
            if self.gate:
                pc.match_substring_regex(pa.array([""]), self.gate)
        except (pa.ArrowInvalid, UnicodeEncodeError):  # needles that are not text, or too many for one automaton
            self.gate = None

    def raw(self, text: str) -> Iterator[tuple[int, int, int]]:
        live = {i for i, first in self.always if first in text}
        low = text.lower()
        # hits of hinted patterns: (start, place among the hints, end); lower-casing may lengthen a text, then they are looked for again
        spots: dict[int, list[tuple[int, int, int]]] = {}
        if self.automaton:
            same, plain, needles = len(low) == len(text), text.isascii(), set()
            for last, (n, length, tried) in self.automaton.iter(low):
                needles.add(n)
                if tried and same and (plain or text[last + 1 - length:last + 1].isascii()):
                    for i, k in tried:
                        spots.setdefault(i, []).append((last + 1 - length, k, last + 1))
        else:
            same, needles = False, [n for n in {**self.needles, **self.low_prefixes} if n in low]
        for n in needles:
            live.update(self.needles.get(n, ()))
            for needle in self.low_prefixes.get(n, ()):
                at = text.find(needle)
                while at >= 0:
                    if not at or text[at - 1] not in _TOKEN_CHARS:
                        end = self.token_rx.match(text, at + len(needle)).end()
                        for rule in self.prefixes[needle]:
                            yield rule, at, end
                    at = text.find(needle, at + 1)
        for rule, needle in self.literals:
            at = text.find(needle)
            while at >= 0:
                yield rule, at, at + len(needle)
                at = text.find(needle, at + 1)
        for rule, needle in self.suffixes:
            at = text.find(needle)
            while at >= 0:
                end = at + len(needle)
                if end == len(text) or text[end] not in _TOKEN_CHARS:
                    head = self.head_rx.search(text[max(0, at - SUFFIX_BYTES):at])[0]
                    if size(needle) + len(head) <= SUFFIX_BYTES:
                        yield rule, at - len(head), end
                at = text.find(needle, end)
        for i in sorted(live):
            rule, rx, capture, tries = self.patterns[i]
            group = "value" if capture else 0
            if tries is None:
                for m in rx.finditer(text):
                    if m.start(group) >= 0:
                        yield rule, m.start(group), m.end(group)
                continue
            reach = 0
            for key, _, end in sorted(spots.get(i, ())) if same else ((m.start(), 0, m.end()) for m in tries.finditer(text)):
                if key < reach:  # hits do not overlap, and the first hint of a place counts
                    continue
                reach = end
                begin = key - 1 if key and text[key - 1] in "'\"" else key
                # the match must begin at the hint or at the quote before it; the leftmost match from the quote on decides
                m = rx.match(text, begin) or (begin < key and rx.match(text, key)) or None
                if m and m.start(group) >= 0:
                    yield rule, m.start(group), m.end(group)


@lru_cache(maxsize=8)
def _plan(rules: tuple[AnyRule, ...]) -> _Plan:
    return _Plan(rules)


_REVIEW = re.compile(r"(?<![A-Za-z0-9-])(?:[A-Z0-9]{4}-){3}[A-Z0-9]{4}(?![A-Za-z0-9-])")


def review_spans(text: str) -> Iterator[tuple[int, int]]:
    """Grouped codes that look like recovery codes but are neither numbers, hexadecimal nor stand-ins."""
    if text.count("-") < 3:
        return
    for m in _REVIEW.finditer(text):
        compact = m[0].replace("-", "")
        if not re.fullmatch("[0-9A-F]+", compact) and not placeholder(compact):
            yield m.start(), m.end()


_BREAK = re.compile("\n")
_SHORT = 1024  # code points of a text in which places are counted anew each time


class Coordinates:
    """Bytes, lines and columns of code-point offsets of one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ascii = text.isascii()
        self.short = len(text) <= _SHORT
        self.breaks = [] if self.short else [m.end() for m in _BREAK.finditer(text)]
        self._known = [(0, 0)]

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        if self.short:
            return len(self.text[:at].encode("utf-8", "surrogatepass"))
        i = bisect_right(self._known, (at, 1 << 62)) - 1
        start, have = self._known[i]
        have += len(self.text[start:at].encode("utf-8", "surrogatepass"))
        if i == len(self._known) - 1 and at > start:
            self._known.append((at, have))
        return have

    def place(self, start: int, end: int) -> tuple[int, int, int, int]:
        """Start, end, line, column."""
        if self.short:
            return self.byte(start), self.byte(end), self.text.count("\n", 0, start) + 1, start - self.text.rfind("\n", 0, start)
        line = bisect_right(self.breaks, start)
        return self.byte(start), self.byte(end), line + 1, start - (self.breaks[line - 1] if line else 0) + 1

    def location(self, start: int, end: int) -> dict[str, int]:
        return dict(zip(("start", "end", "line", "column"), self.place(start, end)))


class ScannerBuilder:
    """Collects rules; custom rules come first, built-in rules after them."""

    def __init__(self) -> None:
        self._own: list[Rule] = []
        self._built_in: list[RuleSpec] = []

    def rule(self, *rules: Rule) -> ScannerBuilder:
        self._own += rules
        return self

    def builtin(self, *specs: RuleSpec) -> ScannerBuilder:
        self._built_in += specs
        return self

    def catalog(self, *names: str) -> ScannerBuilder:
        for name in names:
            self._built_in += CATALOGS[name]
        return self

    def build(self) -> Scanner:
        rules = (*self._own, *self._built_in)
        seen = set()
        for r in rules:
            if not r.id:
                raise ScannerError("empty_rule_id")
            if r.id in seen:
                raise ScannerError("duplicate_rule_id", r.id)
            seen.add(r.id)
            if not r.value:
                raise ScannerError("empty_matcher", r.id)
            if r.kind not in ("literal", "prefix", "suffix", "pattern", "capture"):
                raise ScannerError("rule", r.id)
        if len(rules) >= 1 << 32:
            raise ScannerError("too_many_rules")
        return Scanner(rules)


def default_scanner() -> Scanner:
    return Scanner(CURRENT)


def configured(mode: str = "built_in_only", custom: tuple[Rule, ...] = (), catalogs: tuple[str, ...] = ("current",)) -> Scanner:
    """Scanner by configuration: built_in_only, custom_only, built_in_and_custom or catalogs."""
    b = ScannerBuilder()
    if mode in ("custom_only", "built_in_and_custom"):
        b.rule(*custom)
    if mode in ("built_in_only", "built_in_and_custom"):
        b.catalog("current")
    elif mode == "catalogs":
        b.rule(*custom).catalog(*catalogs)
    elif mode != "custom_only":
        raise ScannerError("rule", f"unknown configuration {mode}")
    return b.build()
