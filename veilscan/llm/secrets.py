"""Secret scans: fixed base patterns plus a token-efficiency test for random strings.

A string that a public BPE vocabulary splits into unusually many tokens for its
length is unlike anything written by people: random. Runs of key characters are
measured, after digests, UUIDs and numbers are set aside; words joined by
separators are spared if each word alone tokenises like one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BytePairEncoder, encoder, read_ranks

# The base patterns, in their order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
CHARS_PER_TOKEN = 2.0

Span = tuple[int, int, int]  # start, index in KINDS, end


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(run: str) -> bool:
    """Known digests by size, UUIDs and numbers."""
    if len(run) in DIGEST_SIZES and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    return not re.search("[A-Za-z]", run) or bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run))


def _words_only(run: str, bpe: BytePairEncoder, ratio: float) -> bool:
    """Parts that are each a word with a number of up to 4 digits after it, or a number, and whose words tokenise like words.

    A single part is no compound: the whole run's own ratio has decided.
    """
    pieces = [p for p in re.split(r"[-_/=+]", run) if p]
    parts = [re.fullmatch(r"([A-Za-z]+)[0-9]{0,4}|[0-9]+", part) for part in pieces]
    if not all(parts):
        return False
    words = [m[1] for m in parts if m[1]]
    if len(pieces) == 1:
        return bool(words) and all(len(w) >= ratio * bpe.count(w) for w in words)
    return all(len(w) < 4 or len(w) >= ratio * bpe.count(w) for w in words)


def random_spans(text: str, bpe: BytePairEncoder, ratio: float = CHARS_PER_TOKEN) -> list[Span]:
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if not is_identifier(run) and len(run) < ratio * bpe.count(run) and not _words_only(run, bpe, ratio):
            out.append((m.start(), 3, m.end()))
    return out


def _uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """Of ascending spans that do not overlap, those of which the ascending base spans leave some character. One sweep over both."""
    out, i = [], 0
    ends: list[Span] = []
    for span in spans:
        while i < len(base) and base[i][0] < span[2]:
            if base[i][2] > span[0]:
                ends.append(base[i])
            i += 1
        at = span[0]
        ends = [b for b in ends if b[2] > span[0]]
        for s, _, e in ends:
            if s <= at:
                at = max(at, e)
        if at < span[2]:
            out.append(span)
    return out


def all_spans(text: str, bpe: BytePairEncoder) -> tuple[list[Span], list[Span]]:
    """(base spans, base and random spans). A run wholly inside the base spans is not reported twice."""
    base = base_spans(text)
    return base, sorted(base + _uncovered(random_spans(text, bpe), base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every union of overlapping spans replaced by one mask."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, ranks_path: str, pattern: str, mask: bool = False) -> DataFrame:
    """Scans the whole text of every row; all columns of docs stay.

    Adds n_assign, n_access, n_hex, base_sha256, spans; with ``mask`` instead
    the text column's secrets are replaced by [SECRET] (null stays null). Null
    and empty text: no spans, the digest of nothing. Rows are independent: no
    shuffle, repeated rows and null ids stay. A docs column with one of the
    added names is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    added = [] if mask else ["n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string"]
    names = [a.split()[0] for a in added]
    docs = docs.drop(*names)
    fields = docs.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern)
        for batch in frames:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").cast(pa.string()).to_pylist()
                if mask:
                    k = fields.index("text")
                    cols = list(part.columns)
                    cols[k] = pa.array([t and masked(t, all_spans(t, bpe)[1]) for t in texts], pa.string())
                    yield pa.record_batch(cols, names=fields)
                    continue
                found = [all_spans(t or "", bpe) for t in texts]
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
                yield pa.record_batch([*part.columns, *counts, digest, pa.array([joined(every) for _, every in found])], names=[*fields, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *added])
    return docs.mapInArrow(run, schema)
