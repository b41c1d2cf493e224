"""Nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks; every (query block, candidate
block) pair is one tile. A tile multiplies int8 codes, which gives each inner
product up to a known quantisation error: with u = u' + e and v = v' + f
(u', v' the decoded codes), |u.v - u'.v'| <= |u'||f| + |e||v|. Only pairs whose
upper bound reaches the k-th best lower bound survive; these are computed again
from the original floats in double precision and kept in one heap per query.
The result is exact. A vector that occurs many times is multiplied once per
tile and stands for its 2 k smallest ids, each k times at most: without any one
id, the query's own, k are left if there are as many.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
_STEP = 1024  # candidates of one product; also the most dimensions whose int8 products float32 sums exactly


def usable(vec: str) -> Column:
    """Not null, of finite components, not all zero."""
    return F.expr(f"coalesce(size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({vec}, x -> x <> 0), false)")


def _exponents(v: np.ndarray) -> np.ndarray:
    """Per vector, the power of two just above its largest component."""
    return np.frexp(np.abs(v).max(1))[1].astype(np.int64)


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of decoded codes, norms of errors, norms; norms are rounded up. Components are at most 1."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(decoded, axis=1) * up, np.linalg.norm(x - decoded, axis=1) * up, np.linalg.norm(x, axis=1) * up


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, by float32 multiplication of at most 1024 dimensions at a time."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], _STEP):
        out += a[:, d:d + _STEP].astype(np.float32) @ b[:, d:d + _STEP].astype(np.float32).T
    return out


def _smallest(ids: np.ndarray, k: int) -> list[int]:
    """The 2 k smallest of ascending ids, each k times at most."""
    if len(ids) > k:
        ids = ids[np.arange(len(ids)) - np.searchsorted(ids, ids) < k]
    return ids[:2 * k].tolist()


def tile(qid: np.ndarray, qv: np.ndarray, cid: np.ndarray, cv: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of each query's k best candidates of one tile."""
    order = np.argsort(cid, kind="stable")
    cid, cv = cid[order], np.ascontiguousarray(cv[order])
    _, first, which = np.unique(cv.view(np.dtype((np.void, cv.dtype.itemsize * cv.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")  # ids ascend within a vector
    ends = np.searchsorted(which[by], np.arange(len(first) + 1))
    ids = [_smallest(cid[by[a:b]], k) for a, b in zip(ends[:-1], ends[1:])]
    sole, single = np.array([x[0] for x in ids], np.int64), np.array([x[0] == x[-1] for x in ids], bool)
    c64, q64 = cv[first].astype(np.float64), qv.astype(np.float64)
    # bounds are of vectors scaled by powers of two to components of at most 1, so that no size of components can overflow them
    qe, ce = _exponents(q64), _exponents(c64)
    shift = qe + ce.max()
    qcodes, qs, qdec, qerr, _ = _quantise(np.ldexp(q64, -qe[:, None]))
    scaled = np.ldexp(c64, -ce.max())
    heaps: list[list[tuple[bool, float, int, float]]] = [[] for _ in qid]
    for at in range(0, len(c64), _STEP):
        b64 = c64[at:at + _STEP]
        codes, s, _, err, norm = _quantise(scaled[at:at + _STEP])
        for lo in range(0, len(qid), _STEP):
            rows = slice(lo, lo + _STEP)
            near = _product(qcodes[rows], codes) * (qs[rows, None] * s)
            slack = qdec[rows, None] * err + qerr[rows, None] * norm + 1e-290
            low, high = near - slack, near + slack
            wild = qe[rows, None] + ce[at:at + _STEP] > 1000  # the score itself may be infinite or not a number: always computed
            low[wild], high[wild] = -np.inf, np.inf
            low[(qid[rows, None] == sole[at:at + _STEP]) & single[at:at + _STEP]] = -np.inf  # only the query itself
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] >= k else np.full(len(low), -np.inf)
            full = [-np.inf if len(h) < k else np.inf if h[0][0] else h[0][1] for h in heaps[rows]]
            full = np.where(np.isfinite(full), np.ldexp(np.array(full), -shift[rows]) - 1e-290, full)
            full -= 1e-12 * np.abs(np.where(np.isfinite(full), full, 0))
            keep = high >= np.maximum(floor, full)[:, None]
            qi, ci = np.nonzero(keep)
            score = np.zeros(len(qi))
            old = np.seterr(over="ignore", invalid="ignore")
            for d in range(q64.shape[1]):  # in the order of the dimensions, so that a score has one value
                score += q64[lo + qi, d] * b64[ci, d]
            np.seterr(**old)
            for i, c, x in zip((lo + qi).tolist(), (at + ci).tolist(), score.tolist()):
                heap, me, odd = heaps[i], qid[i], x != x
                for v in ids[c]:
                    if v == me:
                        continue
                    entry = odd, 0.0 if odd else x, -v, x
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:3] > heap[0][:3]:
                        heapq.heapreplace(heap, entry)
                    else:
                        break
    return [(int(q), -v, x) for q, h in zip(qid, heaps) for _, _, v, x in h]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = t.column("v").combine_chunks()
    ids = t.column("id").to_numpy().astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def nearest(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product of each query row.

    ``query`` marks the query rows; every usable row is a candidate of every
    query of its dimension, except rows of the query's own id. Nearest first,
    ties to the smaller id; fewer than k if there are no more. Rows with a null
    id, or a vector that is null, zero or has null or non-finite components,
    take no part. Components of any finite size do: a score that
    overflows is infinite, or not a number, which comes before all (as in SQL). Repeated ids count: each row is a candidate of its own; each query row of a
    repeated id is answered by the best of all its rows. Other columns are
    ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))
    n, nq = rows.agg(F.count("*"), F.count(F.expr("if(q, 1, null)"))).first()
    cols, lines = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    key = F.xxhash64("id")
    qs = rows.where("q").withColumn("i", F.pmod(key, F.lit(lines))).withColumn("j", F.explode(F.expr(f"sequence(0L, {cols - 1}L)")))
    cs = rows.withColumn("j", F.pmod(key, F.lit(cols))).withColumn("i", F.explode(F.expr(f"sequence(0L, {lines - 1}L)")))
    keep = ["dim", "i", "j", "id", "v"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = tile(*_matrix(left), *_matrix(right), k) if left.num_rows and right.num_rows else []
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    tiles = qs.select(*keep).groupBy("dim", "i", "j").cogroup(cs.select(*keep).groupBy("dim", "i", "j"))
    found = tiles.applyInArrow(run, "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
