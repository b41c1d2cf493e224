"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Features of a text, all from its bytes: counts of character-class trigrams, of
hashed byte 4-grams and of words that repeat one of the three words before
them, damped and weighted by inverse document frequency. A
singular value decomposition of a bounded sample of labelled texts gives the
latent space; the sample's unit vectors and labels are broadcast. Each document
is compared with all of them by exact blocked cosine products, and its nearest
neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import column_bytes, slices, word_hashes, word_spans

CLASSES = 16
TRIGRAMS = CLASSES**3
HASHED = 1 << 11
EXTRA = 3
SIZE = TRIGRAMS + HASHED + EXTRA
#: Labelled rows that the model is fitted on, at most; taken in order of a hash of doc_id.
SAMPLE = 3000
LATENT = 32
NEIGHBOURS = 15
SHARPNESS = 8

# Character classes of bytes.
_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"`()", b"|", b"<>{}[]\\", b"#*$%&", b"+=~^@_", b"-/")):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:] = 14


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Damped counts, one row per text: log(1 + count per thousand bytes)."""
    rows = len(off) - 1
    out = np.zeros((rows, SIZE), np.float32)
    if len(raw) >= 3:
        c = _CLASS[raw].astype(np.int64)
        tri = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        w = raw.astype(np.uint32)
        quad = (w[:-3] + w[1:-2] * np.uint32(0x1F35) + w[2:-1] * np.uint32(0x2C1B3C6D) + w[3:] * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B) >> np.uint32(21)
        for r in range(rows):
            a, b = int(off[r]), int(off[r + 1])
            if b - a >= 3:
                out[r, :TRIGRAMS] = np.bincount(tri[a:b - 2], minlength=TRIGRAMS)
            if b - a >= 4:
                out[r, TRIGRAMS:TRIGRAMS + HASHED] = np.bincount(quad[a:b - 3], minlength=HASHED)
    starts, ends, row = word_spans(raw, off)
    if len(starts):
        words = word_hashes(raw, starts, ends)
        for k in range(1, EXTRA + 1):
            same = (words[k:] == words[:-k]) & (row[k:] == row[:-k])
            out[:, SIZE - k] = np.bincount(row[k:][same], minlength=rows)
    size = np.maximum(np.diff(off), 50)[:, None]
    out = np.log1p(out * (1000.0 / size), dtype=np.float32)
    out[:, SIZE - EXTRA:] *= 6  # few among thousands
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Bounded: at most SIZE x LATENT weights and SAMPLE labelled vectors."""

    weights: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit(x @ self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        near = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
        sim = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        # one vote of the prior keeps scores defined where nothing is near
        return np.clip(((sim * self.labels[top]).sum(1) + 0.01 * self.prior) / (sim.sum(1) + 0.01), 0, 1)


def fit(x: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> Model:
    """Overwrites x, the one large array of the driver."""
    if not len(x):
        return Model(np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(float), 0.5)
    seen = np.count_nonzero(x, axis=0)
    idf = np.where(seen >= 2, np.log((1 + len(x)) / (1 + seen)) + 0.3, 0).astype(np.float32)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    rng = np.random.default_rng(7)
    # randomised range finder with two power rounds
    basis = x.T @ rng.standard_normal((len(x), min(latent + 16, len(x)))).astype(np.float32)
    for _ in range(2):
        basis = x.T @ (x @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    w = (q @ vt[:latent].T).astype(np.float32)
    return Model(idf[:, None] * w, _unit(x @ w), labels.astype(np.float64), float(labels.mean()))


_FEATURE_SCHEMA = "label int, at array<int>, count array<float>"


def _sparse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        raw, off = column_bytes(batch.column("text"))
        labels = batch.column("label")
        for i, j in slices(off):
            x = features(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.record_batch([labels.slice(i, j - i).cast(pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32()))], names=["label", "at", "count"])


def held_out(doc_id: str = "doc_id") -> Column:
    """The held-out fold; its labels are never learned from."""
    return F.coalesce(F.expr(f"crc32(cast({doc_id} as string)) % 4 = 2"), F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fold; docs' other columns are not read.

    Rows that repeat an id with other texts are rows of their own; those that
    repeat id and text count once.
    """
    chosen = (labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
              .groupBy("doc_id").agg(F.max("quality").alias("label")))
    # twice as many ids as rows wanted, as some may have no document
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    ids = texts.select("doc_id", F.xxhash64("text").alias("h")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    # by id and text, and rows that repeat both count once: no more rows than ids, whatever repeats
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "label")
    got = rows.mapInArrow(_sparse, _FEATURE_SCHEMA).toArrow().combine_chunks()
    at, count = (got.column(c).combine_chunks() for c in ("at", "count"))
    y = got.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
    ends = at.offsets.to_numpy() if len(at) else np.zeros(1, np.int64)
    at, count = at.values.to_numpy(), count.values.to_numpy(zero_copy_only=False)
    parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
    # rows arrive in any order; the model must not depend on it
    order = sorted(range(len(parts)), key=lambda i: (y[i], at[parts[i]].tobytes(), count[parts[i]].tobytes()))
    x = np.zeros((len(order), SIZE), np.float32)
    for r, i in enumerate(order):
        x[r, at[parts[i]]] = count[parts[i]]
    return fit(x, y[order])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds score double and predicted int to every row of docs; all its columns stay.

    Whole texts; null and empty texts get the score of empty features. Labels,
    lang, source and doc_id are not inputs. Rows are independent: no shuffle;
    repeated rows and null ids stay. A docs column named score or predicted is
    replaced.
    """
    docs = docs.drop("score", "predicted")
    shared, fields = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in frames:
            raw, off = column_bytes(batch.column("text"))
            for i, j in slices(off):
                parts = [m.score(features(raw[off[a]:off[min(a + 256, j)]], off[a:min(a + 256, j) + 1] - off[a])) for a in range(i, j, 256)]
                s = np.concatenate(parts)
                yield pa.record_batch([*batch.slice(i, j - i).columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*fields, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int"])
    return docs.mapInArrow(run, schema)
