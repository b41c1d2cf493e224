"""The regular expressions of rules, translated into Python's or refused.

Rules are written in the linear-time dialect: no look-around, no
back-references; Unicode classes; classes with nesting, set operations and
POSIX names; flags anywhere in a group. What has no exact counterpart here is
refused with a RuleError, never guessed.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache


class RuleError(ValueError):
    """A rule that cannot be used; ``kind`` is invalid_pattern, pattern_matches_empty, missing_capture_group or invalid_rule."""

    def __init__(self, detail: str, kind: str = "invalid_pattern") -> None:
        super().__init__(detail)
        self.kind = kind


Ranges = tuple[tuple[int, int], ...]
LAST = sys.maxunicode

# White space by Unicode, and the POSIX classes over ASCII.
SPACE: Ranges = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
POSIX: dict[str, Ranges] = {
    "alnum": ((48, 57), (65, 90), (97, 122)), "alpha": ((65, 90), (97, 122)), "ascii": ((0, 127),), "blank": ((9, 9), (32, 32)), "cntrl": ((0, 31), (127, 127)), "digit": ((48, 57),),
    "graph": ((33, 126),), "lower": ((97, 122),), "print": ((32, 126),), "punct": ((33, 47), (58, 64), (91, 96), (123, 126)), "space": ((9, 13), (32, 32)), "upper": ((65, 90),),
    "word": ((48, 57), (65, 90), (95, 95), (97, 122)), "xdigit": ((48, 57), (65, 70), (97, 102)),
}
_SIMPLE = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "a": 7}


def tidy(parts: list[tuple[int, int]] | Ranges) -> Ranges:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return tuple(out)


def inverse(r: Ranges) -> Ranges:
    edges = [-1, *(x for a, b in r for x in (a - 1, b)), LAST]
    return tuple((a + 1, b) for a, b in zip(edges[::2], edges[1::2]) if a < b)


def both(r: Ranges, s: Ranges) -> Ranges:
    return inverse(tidy([*inverse(r), *inverse(s)]))


@lru_cache(maxsize=64)
def category(*names: str) -> Ranges:
    """Characters whose general category begins with one of the names."""
    return tidy([(c, c) for c in range(LAST + 1) if unicodedata.category(chr(c)).startswith(names)])


@lru_cache(maxsize=1)
def word() -> Ranges:
    """Letters, marks, digits, connectors, circled letters and joiners."""
    return tidy([*category("L", "M", "Nd", "Nl", "Pc"), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189), (0x200C, 0x200D)])


def _class(r: Ranges) -> str:
    ch = lambda c: chr(c) if chr(c).isalnum() and c < 128 else f"\\x{c:02x}" if c < 256 else f"\\u{c:04x}" if c < 0x10000 else f"\\U{c:08x}"
    if not r:
        return r"(?!)"
    if r[-1][1] == LAST and len(r) > 1 or r == ((0, LAST),):  # short as what it leaves out
        left_out = inverse(r)
        return "[^" + _class(left_out)[1:] if left_out else r"[\s\S]"
    return "[" + "".join(ch(a) if a == b else f"{ch(a)}-{ch(b)}" for a, b in r) + "]"


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def look(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.look(token):
            self.at += len(token)
            return True
        return False

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def next(self) -> str:
        if self.at >= len(self.text):
            raise RuleError("pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]


def _number(r: _Reader, letter: str) -> int:
    m = r.match(r"\{([0-9A-Fa-f]+)\}") or r.match({"x": "([0-9A-Fa-f]{2})", "u": "([0-9A-Fa-f]{4})", "U": "([0-9A-Fa-f]{8})"}[letter])
    if not m or int(m[1], 16) > LAST or 0xD800 <= int(m[1], 16) < 0xE000:
        raise RuleError("not a character number")
    return int(m[1], 16)


def _escaped(r: _Reader, ascii_only: bool) -> int | Ranges:
    """What follows a backslash: one character, or a set."""
    c = r.next()
    if c in _SIMPLE:
        return _SIMPLE[c]
    if c in "xuU":
        return _number(r, c)
    if c in "dDwWsS":
        ranges = {"d": POSIX["digit"] if ascii_only else category("Nd"), "w": POSIX["word"] if ascii_only else word(), "s": POSIX["space"] if ascii_only else SPACE}[c.lower()]
        return inverse(ranges) if c.isupper() else ranges
    if c in "pP":
        m = r.match(r"\{(\^?)(?:(?:gc|General_Category)=)?([A-Z][a-z]?)\}") or r.match("()([A-Z])")
        if not m or m[2][0] not in "LMNPSZC" or (len(m[2]) == 2 and not category(m[2])):
            raise RuleError("unsupported property class")
        return inverse(category(m[2])) if (c == "P") != bool(m[1]) else category(m[2])
    if c.isascii() and (c.isalnum() or c in "<>"):
        raise RuleError(f"unsupported escape \\{c}")
    return ord(c)


def _set(r: _Reader, fold: bool, ascii_only: bool) -> Ranges:
    """A class after its opening bracket, with nested classes and && -- ~~ from left to right."""
    negated = r.take("^")
    parts: list[tuple[int, int]] = []
    left: Ranges | None = None
    operator, first = "", True
    while r.take("-"):
        parts.append((45, 45))
        first = False

    def fix(items: list[tuple[int, int]]) -> Ranges:
        if fold:
            items = [*items, *((max(a, lo) ^ 32, min(b, hi) ^ 32) for a, b in items for lo, hi in ((65, 90), (97, 122)) if max(a, lo) <= min(b, hi))]
        return tidy(items)

    def joined() -> Ranges:
        here = fix(parts)
        return here if left is None else both(left, here) if operator == "&&" else both(left, inverse(here)) if operator == "--" else tidy([*both(left, inverse(here)), *both(here, inverse(left))])

    while True:
        if r.look("]") and not first:
            r.at += 1
            break
        op = next((o for o in ("&&", "--", "~~") if r.take(o)), "")
        if op:
            left, operator, parts = joined(), op, []
            first = False
            continue
        if r.take("[:"):
            m = r.match(r"(\^?)([a-z]+):\]")
            if not m or m[2] not in POSIX:
                raise RuleError("unknown class name")
            parts += inverse(POSIX[m[2]]) if m[1] else POSIX[m[2]]
        elif r.take("["):
            parts += _set(r, fold, ascii_only)
        else:
            c = r.next()
            low = _escaped(r, ascii_only) if c == "\\" else ord(c)
            if isinstance(low, int) and r.look("-") and not r.look("--") and not r.look("-]"):
                r.at += 1
                c = r.next()
                high = _escaped(r, ascii_only) if c == "\\" else ord(c)
                if not isinstance(high, int) or high < low:
                    raise RuleError("bad range")
                parts.append((low, high))
            elif isinstance(low, int):
                parts.append((low, low))
            else:
                parts += low
        first = False
    out = joined()
    if ascii_only and (negated or any(b > 127 for _, b in out)):
        raise RuleError("a class without Unicode may not go beyond ASCII")
    return inverse(out) if negated else out


def translate(pattern: str) -> str:
    """The pattern in Python's dialect."""
    r = _Reader(pattern)
    out: list[str] = []
    # per open group: (flags before it, parts before it, flag groups opened in it)
    flags = frozenset()
    groups: list[tuple[frozenset, int]] = []
    extra = [0]
    spans: list[str] = [""]  # the opening text of flag groups, to open again after |
    atom: int | None = None
    lead = r.match(r"\(\?([ims]+)\)")
    if lead:
        out.append(lead[0])
        flags = frozenset(lead[1])

    while r.at < len(pattern):
        start = len(out)
        c = r.next()
        if c == "\\":
            if r.take("A"):
                out.append(r"\A")
            elif r.take("z"):
                out.append(r"\Z")
            elif r.take("b{start}") or r.take("<"):
                out.append(r"\b(?=\w)")
            elif r.take("b{end}") or r.take(">"):
                out.append(r"\b(?<=\w)")
            elif r.look("b{"):
                raise RuleError("unsupported word boundary")
            elif r.take("b"):
                out.append(r"\b")
            elif r.take("B"):
                out.append(r"\B")
            else:
                got = _escaped(r, "a" in flags)
                if "a" in flags and not isinstance(got, int) and got[-1][1] > 127:
                    raise RuleError("a class without Unicode may not go beyond ASCII")
                out.append(re.escape(chr(got)) if isinstance(got, int) else _class(got))
            atom = start
        elif c == "[":
            out.append(_class(_set(r, "i" in flags, "a" in flags)))
            atom = start
        elif c == "(":
            if r.take("?"):
                m = r.match(r"P?<([A-Za-z_][A-Za-z0-9_]*)>")
                if m:
                    opening = f"(?P<{m[1]}>"
                elif m := r.match(r"([imsu]*)(?:-([imsu]+))?([:)])"):
                    on, off = set(m[1] or ""), set(m[2] or "")
                    if not (on or off) and m[3] == ")" or on & off:
                        raise RuleError("bad flags")
                    named = lambda x: "".join(sorted(x & set("ims")))
                    inner = (flags | on) - off
                    inner = inner - {"a"} if "u" in on else inner | {"a"} if "u" in off else inner
                    text = "(?" + ("a" if "a" in inner and "a" not in flags else "") + named(on) + ("-" + named(off) if named(off) else "") + ":"
                    if m[3] == ")":  # to the end of the group: a flag group that | closes and opens again
                        out.append(text)
                        extra[-1] += 1
                        spans[-1] += text
                        flags, atom = frozenset(inner - {"u"}), None
                        continue
                    out.append(text)
                    groups.append((flags, start))
                    extra.append(0)
                    spans.append("")
                    flags, atom = frozenset(inner - {"u"}), None
                    continue
                else:
                    raise RuleError("look-around and other extensions are not supported")
            else:
                opening = "("
            out.append(opening)
            groups.append((flags, start))
            extra.append(0)
            spans.append("")
            atom = None
        elif c == ")":
            if not groups:
                raise RuleError("unopened group")
            out.append(")" * (extra.pop() + 1))
            spans.pop()
            flags, atom = groups.pop()
        elif c == "|":
            out.append(")" * extra[-1] + "|" + spans[-1])
            atom = None
        elif c in "*+?{":
            quantifier = c
            if c == "{":
                m = r.match(r"([0-9]+)(?:(,)([0-9]*))?\}")
                if not m or (m[3] and int(m[3]) < int(m[1])):
                    raise RuleError("bad repetition")
                quantifier = "{" + m[0]
            if atom is None:
                raise RuleError("nothing to repeat")
            lazy = "?" if r.take("?") else ""
            out[atom:] = ["(?:", *out[atom:], quantifier + lazy, ")"] if r.at < len(pattern) and pattern[r.at] in "*+?{" else [*out[atom:], quantifier + lazy]
        elif c == "$":
            out.append("$" if "m" in flags else r"\Z")
            atom = start
        elif c == "^":
            out.append("^")
            atom = start
        elif c == ".":
            if "a" in flags:
                raise RuleError("a dot without Unicode")
            out.append(".")
            atom = start
        else:
            out.append(re.escape(c))
            atom = start
    if groups:
        raise RuleError("unclosed group")
    text = "".join(out) + ")" * extra[0]
    try:
        re.compile(text)
    except (re.error, OverflowError, RecursionError) as e:
        raise RuleError(f"invalid pattern: {e}") from e
    return text
