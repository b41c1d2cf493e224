"""Command line: scan, redact, template, pseudonymize, synthesize, bundle, help, version.

Reads one explicit UTF-8 file (or - for standard input) per source. Exit codes:
0 done, 1 the input or a transformation failed, 2 wrong usage. For tables and
many files, use the DataFrame operators.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from .kernel.engine import default_scanner
from .kernel.transforms import ShareMode, TransformError
from .model import CONFIDENCES, SEVERITIES
from .sources import files, sinks

VERSION = "0.1.0"
USAGE = """usage: python -m veilscan COMMAND
  scan FILE [--format human|json] [--severity S | --min-severity S] [--confidence C | --min-confidence C] [--rule-id ID] [--sort ORDER] [--explain]
  redact FILE | template FILE | pseudonymize FILE --key-file KEY | synthesize FILE --key-file KEY
  bundle redact|template|pseudonymize|synthesize --output-dir DIR [--key-file KEY] FILE...
  help | version
"""
SORTS = {"rule-id": ("rule_id",), "severity": ("severity_ord",), "confidence": ("confidence_ord",), "location": ("start", "end", "line", "column")}


class UsageError(ValueError):
    pass


def _read(path: str) -> str:
    data = sys.stdin.buffer.read() if path == "-" else open(path, "rb").read()  # noqa: SIM115
    return data.decode("utf-8")


def _options(args: list[str], known: dict[str, str], flags: set[str] = frozenset()) -> tuple[list[str], dict[str, str]]:
    """known: option -> slot; two options of one slot conflict."""
    rest, found = [], {}
    it = iter(args)
    for a in it:
        slot = a if a in flags else known.get(a)
        if slot is None:
            if a.startswith("--"):
                raise UsageError(f"unexpected argument: {a}")
            rest.append(a)
            continue
        if slot in found:
            raise UsageError(f"duplicate or conflicting option: {a}")
        if a in flags:
            found[slot] = a
            continue
        value = next(it, "")
        if not value or value.startswith("--"):
            raise UsageError(f"{a} requires a value")
        found[slot] = value
        found[f"{slot}:name"] = a
    return rest, found


def _scan(args: list[str]) -> str:
    rest, o = _options(args, {"--format": "format", "--severity": "severity", "--min-severity": "severity", "--confidence": "confidence", "--min-confidence": "confidence", "--rule-id": "rule", "--sort": "sort"}, {"--explain"})
    if len(rest) != 1 or o.get("format", "human") not in ("human", "json"):
        raise UsageError("scan takes one source")
    scanner = default_scanner()
    found, review = scanner.report(_read(rest[0]))
    chosen = found
    for slot, names in (("severity", SEVERITIES), ("confidence", CONFIDENCES)):
        if slot in o:
            if o[slot] not in names:
                raise UsageError(f"unsupported value: {o[slot]}")
            at, exact = names.index(o[slot]), not o[f"{slot}:name"].startswith("--min-")
            chosen = [f for f in chosen if (f[f"{slot}_ord"] == at if exact else f[f"{slot}_ord"] >= at)]
    if "rule" in o:
        chosen = [f for f in chosen if f["rule_id"] == o["rule"]]
    if "sort" in o:
        name = o["sort"].removesuffix("-asc").removesuffix("-desc")
        if name not in SORTS:
            raise UsageError(f"unsupported value: {o['sort']}")
        flat = lambda f: f | f["location"]
        ties = lambda f: tuple(flat(f)[k] for k in ("start", "end", "line", "column", "rule_id", "severity_ord", "confidence_ord"))
        chosen = sorted(sorted(chosen, key=ties), key=lambda f: tuple(flat(f)[k] for k in SORTS[name]), reverse=False)
        if o["sort"].endswith("-desc"):  # primary columns descend, ties still ascend
            groups: dict[tuple, list] = {}
            for f in chosen:
                groups.setdefault(tuple(flat(f)[k] for k in SORTS[name]), []).append(f)
            chosen = [f for k in sorted(groups, reverse=True) for f in groups[k]]
    filtered = any(k in o for k in ("severity", "confidence", "rule"))
    render = sinks.render_json if o.get("format") == "json" else sinks.render_text
    return render(rest[0], found, review, chosen if filtered or "sort" in o else None, scanner if "--explain" in o else None) + ("\n" if o.get("format") == "json" else "")


def _mode(kind: str, o: dict[str, str]) -> ShareMode:
    keyed = kind in ("pseudonymize", "synthesize")
    if keyed != ("key" in o):
        raise UsageError("a key file goes with pseudonymize and synthesize only, and must be given there")
    return ShareMode(kind, {"key": files.read_key(o["key"])} if keyed else {})


def _spans(found: list[dict]) -> list[tuple[int, int, str]]:
    return [(f["location"]["start"], f["location"]["end"], f["rule_id"]) for f in found]


def _transform(kind: str, args: list[str]) -> str:
    rest, o = _options(args, {"--key-file": "key"})
    if len(rest) != 1:
        raise UsageError(f"{kind} takes one source")
    text, mode = _read(rest[0]), _mode(kind, o)
    return mode.apply(text, _spans(default_scanner().report(text)[0]))


def _bundle(args: list[str]) -> str:
    rest, o = _options(args, {"--key-file": "key", "--output-dir": "out"})
    if len(rest) < 2 or "out" not in o or rest[0] not in ("redact", "template", "pseudonymize", "synthesize"):
        raise UsageError("bundle takes a mode, an output directory and sources")
    mode, texts, scanner = _mode(rest[0], o), [_read(p) for p in rest[1:]], default_scanner()
    reports = [scanner.report(t) for t in texts]
    count = lambda sev: sum(f["severity"] == sev for r in reports for f in r[0])
    summary = {"scanned_sources": len(texts), "scanned_bytes": sum(len(t.encode()) for t in texts), "reports_with_findings": sum(bool(r[0]) for r in reports), "reports_without_findings": sum(not r[0] for r in reports), "total_findings": sum(len(r[0]) for r in reports), "total_candidates": sum(len(r[1]) for r in reports), "reports_with_candidates": sum(bool(r[1]) for r in reports)} | {s: count(s) for s in reversed(SEVERITIES)}
    sinks.write_bundle_local(o["out"], mode.kind, [mode.apply(t, _spans(r[0])) for t, r in zip(texts, reports)], summary)
    return ""


def main(argv: Sequence[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    try:
        command = args[0] if args else "help"
        if command in ("help", "--help", "-h"):
            out = USAGE
        elif command in ("version", "--version"):
            out = f"veilscan {VERSION}\n"
        elif command == "scan":
            out = _scan(args[1:])
        elif command in ("redact", "template", "pseudonymize", "synthesize"):
            out = _transform(command, args[1:])
        elif command == "bundle":
            out = _bundle(args[1:])
        else:
            raise UsageError(f"unknown command: {command}")
    except UsageError as e:
        sys.stderr.write(f"{e}\n{USAGE}")
        return 2
    except UnicodeDecodeError:
        sys.stderr.write("input is not valid UTF-8\n")
        return 1
    except (OSError, TransformError, ValueError) as e:
        sys.stderr.write(f"{type(e).__name__}: {e if isinstance(e, (OSError, TransformError)) else 'failed'}\n")
        return 1
    sys.stdout.write(out)
    return 0
