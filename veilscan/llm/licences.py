"""Licence scans: a trained paragraph classifier with template comparison.

A paragraph is a line, or a line with up to three that follow it where the
line alone names no licence: statements and grants are often wrapped. It is
classified by multinomial logistic regression over sparse word 1- and 2-grams
into licence families or unknown. The model is trained on the templates below
(names, identifiers and grants) in many frames and alterations, against
sentences that only sound like licences and licences of made-up names. A
temperature fitted on held-out alterations calibrates its probabilities. A
prediction stands when its probability reaches a threshold and the paragraph
holds enough of one of the family's templates.

Scoring is DataFrame functions only, row by row: no shuffle, no Python.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import restored, shielded

# Names, identifiers and grants by which texts state their licence, by family.
TEMPLATES = {
    "agpl": ["gnu affero general public license", "gnu agpl", "agplv3", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "this program is free software under the terms of the gnu affero general public license"],
    "apache": ["apache license", "apache license, version 2.0", "apache-2.0", "apache 2.0", "apache-lizenz", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis"],
    "artistic": ["artistic license 2.0", "artistic-2.0", "perl artistic license"],
    "boost": ["boost software license, version 1.0", "boost software license", "bsl-1.0"],
    "bsd": ["bsd license", "bsd 3-clause license", "bsd 2-clause license", "bsd-3-clause", "bsd-2-clause", "bsd-lizenz", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc-by": ["cc by 4.0", "cc by 3.0", "cc-by-4.0", "cc-by-3.0", "creative commons attribution 4.0 international", "creative commons attribution license"],
    "cc-by-nc": ["cc by-nc 4.0", "cc by-nc-sa 4.0", "cc by-nc-nd 4.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "creative commons attribution-noncommercial 4.0 international", "creative commons attribution-noncommercial-sharealike 4.0 international"],
    "cc-by-nd": ["cc by-nd 4.0", "cc-by-nd-4.0", "creative commons attribution-noderivatives 4.0 international"],
    "cc-by-sa": ["cc by-sa 4.0", "cc by-sa 3.0", "cc-by-sa-4.0", "cc-by-sa-3.0", "creative commons attribution-sharealike 4.0 international", "creative commons attribution-sharealike license"],
    "cc0": ["cc0 1.0 universal", "cc0", "cc0-1.0", "dedicated to the public domain under cc0 1.0 universal"],
    "epl": ["eclipse public license 2.0", "eclipse public license", "epl-2.0", "epl-1.0", "made available under the terms of the eclipse public license"],
    "eupl": ["european union public licence", "eupl-1.2"],
    "gpl": ["gnu general public license", "gnu general public license, version 3", "gnu general public license, version 2", "gnu gpl", "gpl license", "gplv3", "gplv2", "gpl-3.0", "gpl-2.0", "gpl-3.0-only", "gpl-2.0-only", "gpl-3.0-or-later", "gpl-2.0-or-later", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license"],
    "isc": ["isc license", "spdx-license-identifier: isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu lesser general public license", "gnu lesser general public license, version 3", "gnu lgpl", "lgpl license", "lgplv3", "lgplv2.1", "lgpl-3.0", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-or-later", "you can redistribute this library under the terms of the gnu lesser general public license"],
    "mit": ["mit license", "mit licence", "mit terms", "mit-lizenz", "licence mit", "licencia mit", "spdx-license-identifier: mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["mozilla public license, version 2.0", "mozilla public license", "mpl-2.0", "mpl 2.0", "this source code form is subject to the terms of the mozilla public license, version 2.0"],
    "proprietary": ["all rights reserved", "copyright 2020 the company, all rights reserved, no part may be reproduced without permission", "confidential and proprietary, unauthorized copying of this file is strictly prohibited", "alle rechte vorbehalten", "tous droits r\u00e9serv\u00e9s", "todos los derechos reservados"],
    "unlicense": ["the unlicense", "spdx-license-identifier: unlicense", "this is free and unencumbered software released into the public domain"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl"],
    "zlib": ["zlib license", "spdx-license-identifier: zlib", "this software is provided as-is, without any express or implied warranty, in no event will the authors be held liable"],
}
# What stands around a licence's name.
FRAMES = (
    "{}", "{}", "{}", "{}", "{}", "licensed under {}", "licensed under the {}", "released under the {}", "released under {}", "distributed under the terms of the {}", "this work is licensed under a {} license", "this project is available under the {}", "license: {}", "spdx-license-identifier: {}",
    "the code is covered by the {}", "text is available under the {}", "dual-licensed under {}", "see the {} for details", "ver\u00f6ffentlicht unter der {}", "lizenziert unter {}", "publi\u00e9 sous {}", "publicado bajo la {}",
)
# Sentences with words of licences that name none.
LOOKALIKES = (
    "she renewed her driving license last week", "the license plate was stolen", "the city issued a license for the new bar", "he asked for permission to leave", "permission was granted by the teacher",
    "the apache helicopter landed", "the apache tribe lived in the south", "a professor at mit gave a talk", "the general public was invited", "the public was told in general terms", "terms of the agreement were secret",
    "copyright law is a hard subject", "a lecture on copyright and culture", "creative people work in common rooms", "the commons voted on the bill", "warranty repairs take two weeks", "the warranty of the car ended", "version 3 of the plan was better",
    "version 2.0 of the phone sold well", "use of the pool is free of charge", "free software was discussed at the meeting", "distribution of food began", "redistribution of wealth is debated", "all seats reserved", "rights of the child", "the public domain of politics",
    "the work is done under pressure", "released under pressure from the press", "released under the new rules", "licensed to drive a bus", "licensed under state law to practice medicine", "this file is too large", "the source of the river", "modify the plan and copy the letter", "gnu and zebra cross the river", "the mozilla mascot", "attribution of the painting is unclear", "proprietary trading lost money", "a confidential report", "this work is hard",
)
UNKNOWN = "unknown"
THRESHOLD = 0.6
#: Share of a template's distinct 1- and 2-grams that a paragraph must hold.
CONFIRM = 0.6
#: Maps that the weights are dealt over.
CELLS = 509

_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def grams(text: str) -> list[str]:
    w = re.findall(_TOKEN, text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


# Words that lines without a licence often hold: the gate does without them where it can, most of all the first ones.
_COMMON = {
    **dict.fromkeys("a all an and any are as at be by can for from in into is it may mit no not of on or that the this to under use want with without work you do what 3 4 1".split(), 2),
    **dict.fromkeys("1.0 2.0 3.0 4.0 file following form free general name names code copy its terms version available except held met part person program public released required software source used made basis law library holder license".split(), 1),
}


@lru_cache(maxsize=2)
def gate_words(confirm: float = CONFIRM) -> tuple[str, ...]:
    """Words of which every paragraph that holds ``confirm`` of some template has one.

    Of each template, words are taken until the grams without them are too few;
    words taken before and uncommon words come first, then those in most grams.
    """
    taken: set[str] = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        every = dict.fromkeys(grams(t))
        left = [g.split(" ") for g in every if not taken & set(g.split(" "))]
        while len(left) / len(every) >= confirm:
            best = min({w for g in left for w in g}, key=lambda w: (_COMMON.get(w, 0), -sum(w in g for g in left), w))
            taken.add(best)
            left = [g for g in left if best not in g]
    return tuple(sorted(taken))


def _altered(text: str, r: random.Random, noise: list[str]) -> str:
    words = text.split()
    if len(words) > 9 and r.random() < 0.4:
        del words[r.randrange(len(words))]
    front = [r.choice(noise) for _ in range(r.choice([0, 0, 1, 3, 8]))]
    back = [r.choice(noise) for _ in range(r.choice([0, 0, 1, 3, 8]))]
    return " ".join([*front, *words, *back])


def _made_up(r: random.Random) -> str:
    """A licence that no family knows: a statement must not be called by the nearest name."""
    name = "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    kind = r.choice(["license", "public license", "software license", "license, version 1.0", "license 2.0", "community license", "-1.0", "-2.0", " 4.0", ""])
    return r.choice(FRAMES).format(name + kind if kind[:1] in "-" else f"{name} {kind}".strip())


def _examples(r: random.Random, each: int, families: list[str]) -> tuple[list[list[str]], np.ndarray]:
    noise = "the of and to in a is that it for on was with this by der die und el la de que le et les un you may see file project code version license licensed under terms 1 2 3 2.0 4.0".split()
    x, y = [], []
    for k, f in enumerate(families):
        pool = TEMPLATES.get(f, LOOKALIKES)
        for i in range(each * (100 if f == UNKNOWN else len(pool))):
            chance = r.random()
            if f != UNKNOWN:
                name = pool[i % len(pool)]
                text = _altered(r.choice(FRAMES).format(name) if len(name.split()) < 9 else name, r, noise)
            elif chance < 0.35:
                text = _altered(_made_up(r), r, noise)
            elif chance < 0.6:
                text = " ".join(r.choice(noise) for _ in range(r.randint(1, 25)))
            else:
                text = _altered(pool[i % len(pool)], r, noise)
            x.append(grams(text))
            y.append(k)
    return x, np.array(y)


class Licences:
    def __init__(self, families: list[str], bias: np.ndarray, weights: dict[str, np.ndarray], temperature: float) -> None:
        self.families, self.bias, self.weights, self.temperature = families, bias, weights, temperature

    def probabilities(self, text: str) -> np.ndarray:
        """As the DataFrame scoring computes them; for tests."""
        z = (self.bias + sum((self.weights[g] for g in dict.fromkeys(grams(text)) if g in self.weights), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


@lru_cache(maxsize=2)
def trained(each: int = 24, seed: int = 5) -> Licences:
    """Full-batch gradient descent with an L1 step that keeps the weights sparse; deterministic."""
    r = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    x, y = _examples(r, each, families)
    counts = Counter(g for e in x for g in set(e))
    vocabulary = sorted(g for g, n in counts.items() if n >= 3)  # fewer say nothing
    at = {g: i for i, g in enumerate(vocabulary)}
    m = np.zeros((len(x), len(vocabulary)), np.float32)
    for i, e in enumerate(x):
        m[i, [at[g] for g in e if g in at]] = 1
    k = len(families)
    w, b, onehot = np.zeros((len(vocabulary), k), np.float32), np.zeros(k, np.float32), np.eye(k, dtype=np.float32)[y]
    for _ in range(400):
        z = m @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) / len(x)
        w -= 4.0 * (m.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * 1e-4, 0)
        b -= 4.0 * g.sum(0)
    hx, hy = _examples(random.Random(seed + 1), each // 2, families)
    weights = {g: w[i] for g, i in at.items() if np.abs(w[i]).max() > 0.02}
    z = np.array([b + sum((weights[g] for g in dict.fromkeys(e) if g in weights), np.zeros(k)) for e in hx])

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(hy)), hy]).mean())

    return Licences(families, b, weights, min(np.geomspace(0.2, 5, 40), key=loss))


def _doubles(values) -> Column:  # noqa: ANN001
    return F.array(*[F.lit(round(float(v), 6)) for v in values])


def _classified(line: Column, model: Licences) -> Column:
    """struct<family, probability> of a paragraph, or null where none is confirmed."""
    k = len(model.families)
    names = F.array(*map(F.lit, model.families))
    # weights lie in small maps by the gram's checksum: Spark looks a key up by going through its map
    cells: list[dict[str, list[float]]] = [{} for _ in range(CELLS)]
    for g, w in model.weights.items():
        cells[zlib.crc32(g.encode()) % CELLS][g] = [round(float(v), 6) for v in w]
    # one literal that the optimizer reads once, as tens of thousands of literals take long to hand over
    table = F.from_json(F.lit(json.dumps(cells)), "array<map<string,array<double>>>")
    weight = lambda g: F.element_at(F.get(table, (F.crc32(g.cast("binary")) % CELLS).cast("int")), g)
    on = lambda col, then: F.get(F.transform(F.array(col), then), 0)  # noqa: E731  (bind once, use often)

    def every(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.lit(0), F.size(words) - 1))))


    def scored(g: Column) -> Column:
        known = F.filter(F.transform(g, weight), lambda w: w.isNotNull())
        z = F.aggregate(known, _doubles(model.bias), lambda a, w: F.zip_with(a, w, lambda p, q: p + q))
        return on(F.transform(z, lambda v: v / F.lit(float(model.temperature))), lambda s: on(F.transform(s, lambda v: F.exp(v - F.array_max(s))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))

    def held(g: Column, family: Column) -> Column:
        best = F.lit(0.0)
        for f, templates in TEMPLATES.items():
            shares = [F.size(F.array_intersect(g, F.array(*map(F.lit, t)))) / F.lit(float(len(t))) for t in (list(dict.fromkeys(grams(x))) for x in templates)]
            best = F.when(family == f, F.greatest(*shares, F.lit(0.0))).otherwise(best)
        return best

    def judged(g: Column) -> Column:
        return on(scored(g), lambda p: on(F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1), lambda f: F.when(
            (f != UNKNOWN) & (F.array_max(p) >= THRESHOLD) & (held(g, f) >= CONFIRM), F.struct(f.alias("family"), F.round(F.array_max(p), 4).alias("probability")))))

    assert k > 1
    return on(F.regexp_extract_all(F.lower(line), F.lit(_TOKEN), 0), lambda words: on(every(words), judged))


#: Lines that a paragraph may have.
LINES = (1, 2, 4)


def _pattern(words: tuple[str, ...]) -> str:
    """An alternation that branches letter by letter, which the JVM tries faster than a flat one."""
    heads: dict[str, set[str]] = {}
    for w in words:
        heads.setdefault(w[0], set()).add(w[1:])
    return "(?:" + "|".join(re.escape(h) + ("(?:" + "|".join(map(re.escape, sorted(t))) + ")" if len(t) > 1 else re.escape(next(iter(t)))) for h, t in sorted(heads.items())) + ")"


def scan(docs: DataFrame, model: Licences | None = None) -> DataFrame:
    """Adds to every row of docs: n_paragraphs, n_licence, families, family, probability, licence_paragraphs.

    Lines end at \\n alone; n_paragraphs counts those with a character that is
    not white space. A paragraph is a line, or where the line alone names no
    licence, it and the next line, or the next three; one that holds a smaller
    one does not count. families: the distinct families found, sorted,
    comma-joined; family and probability: the most probable paragraph's (the
    first by name among equals; null if none); licence_paragraphs:
    array<struct<line, family, probability>>, lines counted from 0. Null and
    empty text: none. Whole texts; rows are independent: repeated rows and null
    ids stay. A column named as an added one is replaced; any other name may
    occur.
    """
    model = model or trained()
    added = "n_paragraphs", "n_licence", "families", "family", "probability", "licence_paragraphs"
    # the user's other columns are put away, so that no name of theirs meets one used here
    rows = shielded(docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None)))
    anchors = "(?<![a-z0-9])" + _pattern(gate_words()) + "(?![a-z0-9])"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumn("n_paragraphs", F.regexp_count(text, F.lit(r"[^\x20\t-\r][^\n]*")).cast("long"))
    # lines are cut only where the text has an anchor, and joined only from lines that have one
    rows = rows.withColumn("lines", F.when(F.lower(text).rlike(anchors), F.split(text, "\n")))
    joined = lambda i: F.array(*(F.struct((i + n - 1).alias("last"), F.array_join(F.slice("lines", i + 1, n), " ").alias("s")) for n in LINES))
    marked = F.filter(F.transform("lines", lambda s, i: F.struct(i.alias("line"), F.lower(s).rlike(anchors).alias("hit"))), lambda x: x["hit"])
    rows = rows.withColumn("marked", F.transform(marked, lambda x: F.struct(x["line"].alias("line"), joined(x["line"]).alias("spans"))))
    found = lambda x: F.struct(x["last"].alias("last"), _classified(x["s"], model).alias("c"))
    none = F.expr("cast(null as struct<last:int,c:struct<family:string,probability:double>>)")
    # longer paragraphs are tried only while none is found
    first = lambda spans: F.aggregate(spans, none, lambda got, x: F.when(got["c"].isNotNull(), got).otherwise(found(x)), lambda got: F.when(got["c"].isNotNull(), got))
    made = F.filter(F.transform("marked", lambda x: F.struct(x["line"].alias("line"), first(x["spans"]).alias("f"))), lambda x: x["f"].isNotNull())
    made = F.transform(made, lambda x: F.struct(x["line"].alias("line"), x["f"]["last"].alias("last"), x["f"]["c"]["family"].alias("family"), x["f"]["c"]["probability"].alias("probability")))
    rows = rows.withColumn("made", F.when(F.size("marked") > 0, made))
    rows = rows.withColumn("made", F.coalesce("made", F.expr("cast(array() as array<struct<line:int,last:int,family:string,probability:double>>)")))
    # of paragraphs that begin at neighbouring lines, a longer one that holds another goes; only the next few can lie inside
    inside = "exists(slice(made, i + 2, 3), y -> y.last <= x.last)"
    rows = rows.withColumn("made", F.expr(f"filter(transform(made, (x, i) -> if({inside}, null, struct(x.line as line, x.family as family, x.probability as probability))), x -> x is not null)"))
    best = F.expr("array_min(transform(made, x -> struct(-x.probability as p, x.family as f)))")
    rows = rows.withColumn("best", best)
    rows = rows.select("doc_id", "text", "_row", "n_paragraphs", F.size("made").cast("long").alias("n_licence"), F.expr("array_join(array_sort(array_distinct(transform(made, x -> x.family))), ',')").alias("families"),
                       F.col("best.f").alias("family"), (-F.col("best.p")).alias("probability"), F.col("made").alias("licence_paragraphs"))
    return restored(rows, docs.columns, *added)
