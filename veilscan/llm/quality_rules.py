"""Quality rules by repetition coverage.

Counts of the base are exact. The method's verdict measures which share of a
text's word characters lies inside duplicated n-grams (several n at once, by
rolling hashes in numpy) and inside duplicated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import column_bytes, slices, window_hashes, word_hashes, word_spans

#: n-gram length -> largest share of word characters inside n-grams that occur before or again in the text.
COVERAGE = {5: 0.45, 7: 0.40, 10: 0.35}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_COVERAGE = 0.30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of a text's words lie in an n-gram found twice or more."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    reach = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + n, -1)
    return np.cumsum(reach[:-1]) > 0


def _exact_ids(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)


def _exact_trigrams(ids: np.ndarray) -> np.ndarray:
    """Equal exactly where three consecutive ids are equal."""
    size = np.uint64(int(ids.max()) + 1) if len(ids) else np.uint64(1)
    _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    return pair[:-1].astype(np.uint64) * size + ids[2:]


def _measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(off) - 1
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out: dict[str, np.ndarray] = {k: np.zeros(rows, np.int64) for k in names}
    out |= {f"cover_{n}": np.zeros(rows) for n in COVERAGE} | {"cover_lines": np.zeros(rows)}
    starts, ends, row = word_spans(raw, off)
    first = np.searchsorted(row, np.arange(rows + 1))
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    chars = lead[ends] - lead[starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    out["n_words"][:] = np.diff(first)
    out["n_symbols"][:] = symbols[off[1:]] - symbols[off[:-1]]
    total = np.concatenate([[0], np.cumsum(chars)])
    out["word_chars"][:] = total[first[1:]] - total[first[:-1]]
    hashes = word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = {n: window_hashes(hashes, n) for n in COVERAGE}
    data = raw.tobytes()
    for r in range(rows):
        a, b = int(first[r]), int(first[r + 1])
        if a == b:
            continue
        size = max(1, int(out["word_chars"][r]))
        if b - a >= 3:
            ids = _exact_ids(data, starts[a:b], ends[a:b])
            out["n_repeat_words"][r] = _covered(_exact_trigrams(ids), 3, b - a).sum()
        for n in COVERAGE:
            if b - a > n and out["n_repeat_words"][r] >= n:  # a repeated n-gram repeats its trigrams
                out[f"cover_{n}"][r] = chars[a:b][_covered(grams[n][a:b - n + 1], n, b - a)].sum() / size
        seen: set[bytes] = set()
        repeated = 0
        for line in data[off[r]:off[r + 1]].split(b"\n"):
            if line in seen:
                out["n_dup_lines"][r] += 1
                repeated += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            elif line.strip(b" \t\n\v\f\r"):
                seen.add(line)
        out["cover_lines"][r] = repeated / size
    return out


_ADDED = ["n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "base_failed boolean", "kept boolean"]
_NAMES = [a.split()[0] for a in _ADDED]


def quality_rules(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Measures the whole text of every row; the other columns of docs stay.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept. Null text has no words and fails the base. Rows are
    independent: no shuffle; repeated rows and null ids stay. A docs column
    with one of the added names is replaced; the text column is not returned.
    """
    docs = docs.drop(*_NAMES)
    fields = [c for c in docs.columns if c != "text"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            raw, off = column_bytes(batch.column("text"))
            others = batch.select(fields)
            for i, j in slices(off):
                m = _measure(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])
                repetitive = m["cover_lines"] > LINE_COVERAGE
                for n, most in COVERAGE.items():
                    repetitive |= m[f"cover_{n}"] > most
                yield pa.record_batch([*others.slice(i, j - i).columns, *(pa.array(m[k]) for k in _NAMES[:5]), pa.array(failed), pa.array(~failed & ~repetitive)], names=[*fields, *_NAMES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), *_ADDED])
    return docs.mapInArrow(run, schema)
