"""Main-text extraction by gradient-boosted trees over DOM nodes, decoded over the tree.

Each node's probability of belonging to the main text comes from its own tag
and attribute tokens and its surroundings. The decoder then picks the likeliest
consistent labelling of the whole tree: a node can only be kept inside kept
ancestors, and a kept container keeps at least one of its children.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted, boost
from .dom import Page, features, parse
from .sample_pages import pages

#: Made-up pages that the model is trained on.
TRAINING_PAGES = 900


def labels(page: Page, main: list[str]) -> np.ndarray:
    """1 for leaves of the main text (in order) and for everything above them."""
    out, k = np.zeros(len(page.tag)), 0
    for node, text in page.texts.items():
        if k < len(main) and text == main[k]:
            out[node] = 1
            k += 1
    if k < len(main):
        raise ValueError("main text not found in its page")
    for i in range(len(out) - 1, 0, -1):
        if page.parent[i] >= 0 and out[i]:
            out[page.parent[i]] = 1
    return out


@lru_cache(maxsize=2)
def trained(count: int = TRAINING_PAGES, seed: int = 1) -> Boosted:
    xs, ys = [], []
    for html, main in pages(count, seed):
        page = parse(html)
        wanted = [m for m in main if m]
        xs.append(features(page))
        ys.append(labels(page, wanted))
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(page: Page, logit: np.ndarray) -> list[int]:
    """The leaves that the likeliest consistent labelling keeps, in page order."""
    n = len(page.tag)
    gain = logit.tolist()  # of keeping a node over dropping it, with the best of its subtree
    best, which = [0.0] * n, [-1] * n  # sum of worthwhile children; the best child where none is
    top, some = [-np.inf] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if i not in page.texts:
            if which[i] < 0:
                gain[i] = -np.inf  # an empty container
            else:
                gain[i] += best[i] if some[i] else top[i]
        p = page.parent[i]
        if p >= 0 and gain[i] > -np.inf:
            if gain[i] > 0:
                best[p] += gain[i]
                some[p] = True
            if gain[i] >= top[p]:
                top[p], which[p] = gain[i], i
    kept, out = [False] * n, []
    for i in range(n):
        p = page.parent[i]
        if p < 0:
            kept[i] = gain[i] > 0
        else:
            kept[i] = kept[p] and (gain[i] > 0 or (not some[p] and which[p] == i))
        if kept[i] and i in page.texts:
            out.append(i)
    return out


def extract_all(htmls: list[str], model: Boosted) -> list[str]:
    parsed = [parse(h) for h in htmls]
    sizes = [len(p.tag) for p in parsed]
    logits = model.logit(np.concatenate([features(p) for p in parsed])) if sum(sizes) else np.zeros(0)
    out, at = [], 0
    for page, n in zip(parsed, sizes):
        out.append("\n\n".join(page.texts[i] for i in decode(page, logits[at:at + n])))
        at += n
    return out


def extract(pages_: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Adds text and n_chars to every row of pages(html, ...); the other columns stay, html goes.

    Null, empty or text-free html gives an empty text. Whole pages are read:
    nothing is cut or capped. Rows are independent: no shuffle; repeated rows
    and null ids stay. A column named text or n_chars is replaced.
    """
    pages_ = pages_.drop("text", "n_chars")
    shared = pages_.sparkSession.sparkContext.broadcast(model or trained())
    fields = [c for c in pages_.columns if c != "html"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract_all([h or "" for h in part.column("html").cast(pa.string()).to_pylist()], shared.value)
                yield pa.record_batch([*part.select(fields).columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*fields, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages_.schema if f.name != "html"), "text string", "n_chars long"])
    return pages_.mapInArrow(run, schema)
