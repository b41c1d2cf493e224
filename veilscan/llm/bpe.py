"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can be last in its
encoding: the token t ending there whose neighbour, the last token of the
prefix before t, is compatible with t (the two tokens' joined bytes encode to
just these two). Storing that token for each prefix gives the encoding of every
prefix at once: appending bytes extends the table, and an edit re-encodes only
the chunks around it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import column_bytes, slices

#: Chunks in a cache's generation; two generations are kept. A worker process keeps them while it runs other operators.
CACHE = 60_000
#: Bytes of text that are encoded together (a longer text stands alone).
SLICE = 1 << 21
#: Pairs of tokens and moves of the automaton that are remembered.
KNOWN = 400_000
#: Chunks up to so many characters are remembered.
REMEMBERED = 48


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; at most 2^20 entries are accepted."""
    with open(path, "rb") as f:
        data = f.read()
    if data.count(b"\n") > 1 << 20:
        raise ValueError("rank file is too large to broadcast")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_ODD_SPACES = re.compile(r"\s | \s")


#: A state of the automaton of tokens: its number times 256, the longest end of what was read that begins a token, and
#: (token, bytes) of all tokens ending here, long ones first.
Node = tuple[int, bytes, tuple[tuple[int, int], ...]]


class PrefixTable:
    """The last token of each prefix of one growing piece."""

    __slots__ = ("bpe", "last", "nodes")

    def __init__(self, bpe: BytePairEncoder) -> None:
        self.bpe, self.nodes = bpe, [bpe.root]
        self.last = [-1]  # of the empty prefix: none

    def keep(self, size: int) -> PrefixTable:
        """Forgets all but the first ``size`` bytes."""
        del self.last[size + 1:], self.nodes[size + 1:]
        return self

    def append(self, more: bytes) -> PrefixTable:
        """Extends the table; what it holds for shorter prefixes stays."""
        bpe, last, nodes = self.bpe, self.last, self.nodes
        step, pairs, size = bpe._steps.get, bpe._pairs.get, len(bpe.tokens)
        end, node = len(last), nodes[-1]
        for byte in more:
            node = step(node[0] + byte) or bpe.step(node, byte)
            # long tokens first: exactly one fits, so the order only saves time
            for t, k in node[2]:
                before = last[end - k]
                ok = pairs(before * size + t)
                if ok or ok is None and bpe.compatible(before, t):
                    break
            else:
                raise ValueError("a byte has no token")
            last.append(t)
            nodes.append(node)
            end += 1
        return self

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes: follow last tokens backwards."""
        last, tokens, out = self.last, self.bpe.tokens, []
        at = len(last) - 1 if end is None else end
        while at:
            t = last[at]
            out.append(t)
            at -= len(tokens[t])
        out.reverse()
        return out


@dataclass
class Encoded:
    """A text as its chunks, with the characters and tokens of each, so that an edit finds its place without encoding anything."""

    chunks: list[str]
    sizes: array
    counts: array
    ids: array

    @property
    def text(self) -> str:
        return "".join(self.chunks)


class BytePairEncoder:
    """Encoder and decoder for one rank table and one pre-tokenising pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.tokens[v] = k
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._sorted = sorted(ranks)
        self._ends = {t: (t, len(k)) for k, t in ranks.items()}
        self.root: Node = (0, b"", ())
        self._nodes: dict[bytes, Node] = {b"": self.root}
        self._steps: dict[int, Node] = {}

    def step(self, node: Node, byte: int) -> Node:
        """The automaton's state after one more byte. There are no more states than beginnings of tokens."""
        at, ranks = node[1] + bytes((byte,)), self._sorted
        while at and not ((i := bisect_left(ranks, at)) < len(ranks) and ranks[i].startswith(at)):
            at = at[1:]
        got = self._nodes.get(at)
        if got is None:
            here = (self.ranks.get(at[k:]) for k in range(len(at)))
            got = self._nodes[at] = (len(self._nodes) << 8, at, tuple(self._ends[t] for t in here if t is not None))
        if len(self._steps) > KNOWN:
            self._steps.clear()
        self._steps[node[0] + byte] = got
        return got

    def merge(self, data: bytes) -> list[int]:
        """Plain lowest-rank-first merging of a short byte string; defines what is compatible."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, t: int) -> bool:
        """Whether a token's own bytes encode to it alone."""
        got = self._whole.get(t)
        if got is None:
            got = self._whole[t] = self.merge(self.tokens[t]) == [t]
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens' joined bytes encode to just these two; a = -1: whether b can come first."""
        key = a * len(self.tokens) + b
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > KNOWN:
                self._pairs.clear()
            got = self._pairs[key] = self.whole(b) if a < 0 else self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def piece(self, text: str) -> list[int]:
        """One pre-token. As in the tiktoken library, a piece that is itself a token is that token."""
        data = text.encode("utf-8", "surrogatepass")
        t = self.ranks.get(data)
        return [t] if t is not None else PrefixTable(self).append(data).ids()

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk, 4 bytes each."""
        got = self._chunks.get(text) or self._older.get(text)
        if got is None:
            got = array("I", chain.from_iterable(map(self.piece, self.pattern.findall(text)))).tobytes()
        if len(text) <= REMEMBERED:
            self._chunks[text] = got
            self._turn()
        return got

    def _turn(self) -> None:
        if len(self._chunks) >= CACHE:  # what was not used while this half filled up is forgotten
            self._older, self._chunks = self._chunks, {}

    def _learn(self, chunks: set[str]) -> None:
        """Remembers the chunks. Their pieces are encoded in order, on one table: those that begin alike share their prefixes."""
        older, known, findall = self._older, self._chunks, self.pattern.findall
        single, several, pieces = {}, {}, set()
        for c in chunks:
            if (got := older.get(c)) is not None:
                known[c] = got
                continue
            found = findall(c)
            if len(found) == 1:
                single[c] = found[0]
            else:
                several[c] = found
                pieces.update(found)
        pieces.update(single.values())
        table, before, coded = PrefixTable(self), b"", {}
        for p in sorted(pieces):
            data = p.encode("utf-8", "surrogatepass")
            t = self.ranks.get(data)
            if t is not None:
                coded[p] = array("I", (t,)).tobytes()
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            coded[p] = array("I", table.keep(same).append(data[same:]).ids()).tobytes()
            before = data
        for c, p in single.items():
            known[c] = coded[p]
        for c, found in several.items():
            known[c] = b"".join([coded[p] for p in found])

    def count(self, text: str) -> int:
        """Tokens of a chunk."""
        return len(self.chunk(text)) // 4

    def chunks(self, text: str) -> list[str]:
        """Cuts before single spaces between non-spaces, where no match of the pattern can cross."""
        words = text.split(" ")
        if not _ODD_SPACES.search(text):
            return [words[0], *[" " + w for w in words[1:]]]
        out, glue = [words[0]], not words[0] or words[0][-1].isspace()
        for w in words[1:]:
            if glue or not w or w[0].isspace():
                out[-1] += " " + w
            else:
                out.append(" " + w)
            glue = not w or w[-1].isspace()
        return out

    def encode(self, text: str) -> array:
        """Token ids of a whole text, each match of the pattern encoded separately, no special tokens."""
        recent = self._chunks.get
        return array("I", b"".join([recent(c) or self.chunk(c) for c in self.chunks(text)]))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's token ids. Every different word of the texts is looked up once, and those not known are encoded together."""
        self._turn()
        known = self._chunks
        odd = {k: self.chunks(t) for k, t in enumerate(texts) if _ODD_SPACES.search(t)}
        words = pc.split_pattern(pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.large_string()), " ")
        begin = words.offsets.to_numpy()
        different = words.flatten().dictionary_encode()
        chunks = [" " + w for w in different.dictionary.to_pylist()]
        first = [t[:n] if (n := t.find(" ")) >= 0 else t for t in ("" if k in odd else t for k, t in enumerate(texts))]
        new = {c for cut in (chunks, first, *odd.values()) for c in cut if c not in known and len(c) <= REMEMBERED}
        self._learn(new)
        coded = [known.get(c) or self.chunk(c) for c in chain(chunks, first)]
        # the first word of a text has no space before it
        at = different.indices.to_numpy().astype(np.int64)
        at[begin[:-1]] = np.arange(len(chunks), len(coded))
        ids = np.frombuffer(b"".join(coded), np.uint32)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        start, size = (np.cumsum(size) - size)[at], size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        out = [ids[a:b] for a, b in zip(ends[begin[:-1]], ends[begin[1:]])]
        for k, cut in odd.items():
            out[k] = np.frombuffer(b"".join([known.get(c) or self.chunk(c) for c in cut]), np.uint32)
        return out

    def encoded(self, text: str) -> Encoded:
        chunks = [c for c in self.chunks(text) if c]
        coded = list(map(self.chunk, chunks))
        return Encoded(chunks, array("q", map(len, chunks)), array("q", [len(c) // 4 for c in coded]), array("I", b"".join(coded)))

    def edit(self, whole: Encoded, start: int, end: int, new: str) -> Encoded:
        """The encoding with text[start:end] replaced; only the chunks around the edit are cut and encoded again.

        A border depends on the two characters at either side of it alone, so
        borders more than a chunk away from the edit stay.
        """
        ends = np.cumsum(np.frombuffer(whole.sizes, np.int64)) if whole.sizes else np.zeros(0, np.int64)
        first = max(0, int(np.searchsorted(ends, start, "right")) - 2)
        last = min(len(ends), int(np.searchsorted(ends, end, "left")) + 3)
        begin = int(ends[first - 1]) if first else 0
        old = "".join(whole.chunks[first:last])
        fresh = self.encoded(old[:start - begin] + new + old[end - begin:])
        counts = np.frombuffer(whole.counts, np.int64) if whole.counts else np.zeros(0, np.int64)
        front, back = int(counts[:first].sum()), int(counts[:last].sum())
        join = lambda x, y, i, j: x[:i] + y + x[j:]
        return Encoded(join(whole.chunks, fresh.chunks, first, last), join(whole.sizes, fresh.sizes, first, last), join(whole.counts, fresh.counts, first, last), join(whole.ids, fresh.ids, front, back))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[bytes, BytePairEncoder] = {}


def encoder(data: bytes, pattern: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary; reused by its tasks."""
    key = hashlib.blake2b(data + pattern.encode(), digest_size=16).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BytePairEncoder(parse_ranks(data), pattern)
    return _loaded[key]


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, ids: bool = True) -> DataFrame:
    """Encodes the whole text of every row; all columns of docs stay.

    Adds n_tokens; with ``ids`` token_ids array<int>; with ``digest``
    ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of the bytes that the ids decode to). Null text counts as
    empty: no tokens. Rows are independent: no shuffle, repeated rows and null
    ids stay as they are. A docs column with one of the added names is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    added = ["n_tokens long", *["token_ids array<int>"] * ids, *["ids_sha256 string", "decoded_sha256 string"] * digest]
    names = [a.split()[0] for a in added]
    docs = docs.drop(*names)
    fields = docs.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern)
        for batch in frames:
            _, off = column_bytes(batch.column("text"))
            for i, j in slices(off, SLICE):
                part = batch.slice(i, j - i)
                coded = bpe.encode_all([t or "" for t in part.column("text").cast(pa.string()).to_pylist()])
                more = [pa.array([len(x) for x in coded], pa.int64())]
                if ids:
                    ends = np.cumsum([0, *map(len, coded)])
                    flat = np.concatenate(coded)
                    more.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))))
                if digest:
                    more += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]), pa.array([hashlib.sha256(bpe.decode(x.tolist())).hexdigest() for x in coded])]
                yield pa.record_batch([*part.columns, *more], names=[*fields, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *added])
    return docs.mapInArrow(run, schema)


def detokenize(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """rows(token_ids, ...) -> rows plus decoded binary."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("binary")
    def decoded(ids):  # noqa: ANN001, ANN202
        bpe = encoder(shared.value, pattern)
        return ids.map(lambda x: b"" if x is None else bpe.decode(x))

    return rows.withColumn("decoded", decoded("token_ids"))
