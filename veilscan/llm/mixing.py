"""Soft-membership mixing: document rates that bring domains to target token shares.

A softmax regression over marker words and text-shape bins, fitted on a bounded
labelled sample, gives each document's posterior over the domains; markers are
chosen and all documents scored in SQL.
Rates r >= 0 then solve a least-squares problem: sum_d r_d t_d p_dk = T w_k for
each domain k (t tokens, p posterior, w target weight, T total), by projected
gradient steps from r = 1. With M = sum of t_d p_d p_d' over the documents whose
rate is above its bound, the step for document d is p_d . M^-1 (A r - T w),
halved until the residual falls; the projection r >= 0 makes it iterate. With an
anchor domain, documents that are likeliest of that domain have r >= 1 instead:
none of them is dropped, the others take the whole cut. Where the other domains'
shares of such documents alone exceed the targets, only the surest of them (by
the lowest of SURE that leaves room) have that bound. Every step is one
aggregation to K + K(K+1)/2 numbers; r itself is an expression over the
K-vectors of the steps so far and is never stored.

DataFrame functions only; the driver sees K x K numbers, the bounded vocabulary
and nothing per document.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, restored, shielded, written

#: Labelled documents that the classifier is fitted on, at most; taken in order of a hash of their id.
SAMPLE = 4000
#: Marker words kept, at most.
VOCABULARY = 64
#: Characters of a word that make its stem.
STEM = 5
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: What is stripped from both ends of a word before it can be a marker.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"
#: Chi-square statistic that a marker needs.
LEAST_STRENGTH = 20
#: Documents that must hold a word before it can be a marker.
MIN_DOCS = 3
STEPS = 30
#: Least posteriors of the anchor that bound a rate by 1, tried in this order.
SURE = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99)


#: Index of the domain whose documents keep a rate of 1, and the posterior they need.
Bound = tuple[int, float] | None


def _bin(part: Column, whole: Column, name: str) -> Column:
    """A share, on a logarithmic scale of 8 steps, as a pseudo-word that no text can contain (it has a space)."""
    return F.concat(F.lit(f"{name} "), F.when(part <= 0, F.lit("0")).otherwise(F.greatest(F.lit(1), F.lit(8) + F.floor(F.log2(part / F.greatest(whole, F.lit(1))))).cast("string")))


def _count(chars: str) -> Column:
    """Of ASCII characters. replace() finds single characters fast and copies only texts that have them; bytes need no counting."""
    size = F.octet_length("t")
    return sum((size - F.octet_length(F.replace(F.col("t"), F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def _pieces(text: str) -> Column:
    """The lower-case words between runs of [\\x20\\x09-\\x0D]; replace() and a split at one character do without a regular expression."""
    spaced = F.lower(text)
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _featured(docs: DataFrame) -> DataFrame:
    """docs plus t (text), tokens (words), w (the stems of distinct words without the punctuation around them; stems may repeat), shapes."""
    size = F.length("t")
    rows = docs.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("pieces", _pieces("t"))
    rows = rows.withColumn("tokens", F.size("pieces").cast("long")).withColumn("pieces", F.array_distinct("pieces"))
    rows = rows.withColumn("w", F.transform("pieces", lambda w: F.left(F.btrim(w, F.lit(PUNCTUATION)), F.lit(STEM))))
    # without A-Z, and with digits two bytes long: one pass counts both
    rows = rows.withColumn("other", F.translate("t", DIGITS + UPPER, "\u00e9" * len(DIGITS)))
    upper = size - F.length("other")
    digits = F.octet_length("other") - F.octet_length("t") + upper
    return rows.withColumn("shapes", F.array(
        _bin(upper, size, "upper"), _bin(_count("#*$%&"), size, "symbols"), _bin(_count("|"), size, "bars"), _bin(_count("!"), size, "shouts"), _bin(digits, size, "digits"),
        F.concat(_bin(F.col("tokens") - F.size("pieces"), F.col("tokens"), "repeats"), F.lit(" of "), F.floor(F.log2(F.col("tokens") + 1)).cast("string")),
    )).drop("pieces", "other")


@dataclass
class DomainModel:
    domains: list[str]
    prior: list[float]
    words: dict[str, list[float]]
    shapes: dict[str, list[float]]

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text, ...) plus t, tokens and posterior array<double> in the order of domains."""
        k = len(self.domains)
        zero = F.array(*[F.lit(0.0)] * k)
        add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)

        def summed(found: str, weights: dict[str, list[float]]) -> Column:
            if not weights:
                return zero
            values = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*[F.array(*map(F.lit, v)) for v in weights.values()]))
            return F.aggregate(found, zero, lambda a, x: add(a, F.coalesce(F.element_at(values, x), zero)))

        rows = _featured(docs)
        rows = rows.withColumn("found", F.array_intersect("w", F.array(*map(F.lit, self.words)) if self.words else F.expr("cast(array() as array<string>)")))
        rows = rows.withColumn("by_word", summed("found", self.words)).withColumn("by_shape", summed("shapes", self.shapes))
        rows = rows.withColumn("logits", add(add(F.col("by_word"), F.col("by_shape")), F.array(*map(F.lit, self.prior))))
        rows = rows.withColumn("odds", F.expr("transform(logits, x -> exp(x - array_max(logits)))"))
        rows = rows.withColumn("posterior", F.expr("transform(odds, x -> x / aggregate(odds, 0D, (a, y) -> a + y))"))
        return rows.select(*docs.columns, "t", "tokens", "posterior")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> DomainModel:
    """labelled(doc_id, domain); rows with an unknown domain, a null id or no document take no part."""
    chosen = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = cut(_featured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("domain", "shapes", F.array_distinct("w").alias("w")))
    sizes = dict(rows.groupBy("domain").count().collect())
    n, k = sum(sizes.values()), len(domains)
    total = np.array([sizes.get(d, 0) for d in domains], float)
    prior = np.log((total + 1) / (n + k))

    # markers: the words whose document rates differ most between domains (chi-square statistic)
    counts = rows.select("domain", F.explode("w").alias("f")).groupBy("f").pivot("domain", domains).count().na.fill(0)
    seen = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    overall = (seen + 0.5) / F.lit(float(n + 1))
    strength = sum((F.lit(float(total[i])) * F.pow(F.col(f"`{d}`") / F.lit(float(max(total[i], 1))) - overall, 2) for i, d in enumerate(domains)), F.lit(0.0)) / (overall * (1 - overall))
    top = counts.where(seen >= MIN_DOCS).withColumn("strength", strength).where(F.col("strength") >= LEAST_STRENGTH).orderBy(F.desc("strength"), "f").limit(VOCABULARY).collect()

    markers = [r["f"] for r in top]
    found = F.array_intersect("w", F.array(*map(F.lit, markers))) if markers else F.expr("cast(array() as array<string>)")
    # at most ``sample`` rows of at most VOCABULARY + 6 features; collect order must not matter
    sampled = sorted((domains.index(r[0]), *sorted(r[1]), " |", *sorted(r[2])) for r in rows.select("domain", found, "shapes").collect())
    names = sorted({f for r in sampled for f in r[1:] if f != " |"})
    at = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(sampled), len(names))), np.array([r[0] for r in sampled], int)
    for i, r in enumerate(sampled):
        x[i, [at[f] for f in r[1:] if f != " |"]] = 1
    bias, w = _softmax_regression(x, y, k) if len(sampled) else (prior, np.zeros((0, k)))
    pick = lambda keep: {f: [float(v) for v in w[i]] for f, i in at.items() if (f in keep)}
    known = set(markers)
    return DomainModel(domains, [float(v) for v in bias], pick(known), pick(set(names) - known))


def _softmax_regression(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 1000, penalty: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """(bias, weights) by accelerated full-batch gradient descent; deterministic."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + penalty)
    w = last = np.zeros((x.shape[1], k))
    onehot = np.eye(k)[y]
    for i in range(rounds):
        ahead = w + i / (i + 3) * (w - last)
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        last, w = w, ahead - step * (x.T @ (p - onehot) / len(x) + penalty * ahead)
    return w[-1], w[:-1]


def solve(rows: DataFrame, targets: Mapping[str, float], total: float | None = None, anchor: str | None = None, margin: float = 1.0) -> tuple[list[list[float]], Bound, dict]:
    """Steps of the projected gradient over rows(tokens, posterior), the bound they hold, and a report of what they reach."""
    domains, weight = list(targets), np.array([float(x) for x in targets.values()])
    weight = weight / weight.sum()
    k, t = len(domains), F.col("tokens")
    p = [F.col("posterior")[i] for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    steps: list[list[float]] = []
    of: Bound = None

    def measured() -> tuple[np.ndarray, np.ndarray]:
        """(tokens by domain at the present rates, sum of t p p' over documents with a rate above its bound)."""
        at = rows.withColumn("r", rate(steps, of))
        live = F.when(F.col("r") > least(of), t).otherwise(0) if steps else t
        got = at.agg(*[F.sum(F.col("r") * t * p[i]) for i in range(k)], *[F.sum(live * p[i] * p[j]) for i, j in cells]).first()
        values = [float(x or 0.0) for x in got]
        m = np.zeros((k, k))
        for (i, j), v in zip(cells, values[k:]):
            m[i, j] = m[j, i] = v
        return np.array(values[:k]), m

    have, m = measured()
    norm = np.linalg.pinv(m)  # the residual's metric
    if total is None:
        total = have.sum() if anchor is None else margin * have[domains.index(anchor)] / weight[domains.index(anchor)]
    want, got = total * weight, have
    if anchor is not None:
        a = domains.index(anchor)
        fixed = rows.agg(*[F.sum(least((a, sure)) * t * p[i]) for sure in SURE for i in range(k)]).first()
        held = np.array([float(x or 0.0) for x in fixed]).reshape(len(SURE), k)
        of = next(((a, sure) for sure, h in zip(SURE, held) if (np.delete(h, a) <= 0.99 * np.delete(want, a)).all()), None)
    off = lambda g: float((g - want) @ norm @ (g - want))
    for _ in range(STEPS):
        if np.abs(got - want).max() <= 1e-7 * max(1.0, total):
            break
        before = off(got)
        step = np.linalg.pinv(m) @ (got - want)
        so_far = list(steps)
        for _ in range(6):
            # bounds of 1 bind at the start: there one summed step, which keeps them apart from what is past them
            steps[:] = [*so_far, step.tolist()] if of is None else [(np.sum([*so_far, step], 0)).tolist()]
            got, m = measured()
            if off(got) < before:
                break
            steps[:] = so_far  # too long a step
            step = step / 2
        else:
            got, m = measured()
            break
    return steps, of, {"domains": domains, "have": have.tolist(), "want": want.tolist(), "got": got.tolist(), "steps": len(steps), "sure": of and of[1], "met": bool(np.abs(got - want).max() <= 1e-4 * max(1.0, total))}


def least(of: Bound) -> Column:
    """The bound of a document's rate: 1 if the domain is its likeliest and sure enough, else 0."""
    return F.lit(0.0) if of is None else F.when(F.col("posterior")[of[0]] >= F.greatest(F.array_max("posterior"), F.lit(of[1])), 1.0).otherwise(0.0)


def rate(steps: list[list[float]], of: Bound = None) -> Column:
    """A document's rate after the steps, from its posterior."""
    moves = F.array(*[F.array(*map(F.lit, g)) for g in steps]) if steps else F.expr("cast(array() as array<array<double>>)")
    return F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(least(of), r - F.aggregate(F.zip_with(F.col("posterior"), g, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)))


def with_rates(rows: DataFrame, steps: list[list[float]], of: Bound = None) -> DataFrame:
    """Adds rate and copies; copies rounds the rate up or down by the hash h, so that its expectation is the rate."""
    u = F.pmod(F.col("h"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("rate", rate(steps, of))
    return rows.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | None = None, anchor: str | None = None, margin: float = 1.0, sample: int = SAMPLE, keep_text: bool = True) -> tuple[DataFrame, dict]:
    """(rows, report): every row of docs with tokens, posterior array<double>, rate and copies.

    ``total`` is the wanted token total; without it, it is the corpus total, or
    with ``anchor`` what gives that domain ``margin`` times the tokens it has;
    then documents likeliest of the anchor, as sure as the report's sure, have a
    rate of 1 at least.
    With keep_text all columns of docs stay, else doc_id only. Null or empty
    text has no tokens and the rate of its posterior. Repeated rows are mixed
    each on its own (equal rows round alike). An empty table gives no rows.
    A column of docs named as an added one is replaced; any other name may occur.
    The report says what the targets want and what the rates reach; ``met`` is
    false where no rates reach them (within 1e-4 of the total) or the steps ran
    out, and a warning is given.
    """
    rows, report = _mixed(docs, labelled, targets, total, anchor, margin, sample, keep_text)
    added = "tokens", "posterior", "rate", "copies"
    return restored(rows, docs.columns, *added) if keep_text else rows.select("doc_id", *added), report


def _mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | None, anchor: str | None, margin: float, sample: int, keep_text: bool) -> tuple[DataFrame, dict]:
    model = fit_domains(docs.select("doc_id", "text"), labelled, list(targets), sample)
    measured = lambda d: model.posteriors(d).withColumn("h", F.xxhash64("doc_id", "t", F.lit("copies"))).drop("t")
    # texts are scored once; the solver reads tokens and posteriors alone
    rows = written(measured(shielded(docs)), "mixing") if keep_text else cut(measured(docs.select("doc_id", "text")).drop("text"))
    steps, of, report = solve(rows.select("tokens", "posterior"), targets, total, anchor, margin)
    if not report["met"]:
        warnings.warn(f"mixing targets not met: wanted {report['want']}, got {report['got']}", stacklevel=3)
    return with_rates(rows, steps, of), report


def mixture(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | None = None, anchor: str | None = None, margin: float = 1.0, sample: int = SAMPLE) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as its copies say, with exactly docs' columns."""
    rows, _ = _mixed(docs, labelled, targets, total, anchor, margin, sample, True)
    # an outer explode: Spark would copy the whole classifier into a filter in front of an inner one
    rows = rows.withColumn("_copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).where("_copy is not null")
    return restored(rows, docs.columns)
