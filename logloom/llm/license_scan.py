"""Licence notices in texts, by Dice coefficient over word bigrams against templates. DataFrame functions only.

Units are the whole text, its lines, and stretches of words wherever lines begin and end. A unit and a template with a and
b distinct bigrams reach at most Dice 2*min(a, b)/(a + b), so a lies between t*b/(2-t) and b*(2-t)/t for a threshold t,
and most units meet no template, and the rest one or two. Everything happens inside a row: no shuffle, no join.

Stretches find notices inside a paragraph or wrapped over lines, and full licence texts (the files of license_texts)
inside longer ones. A stretch has as many words as its template, and stretches begin an eighth of that apart, so some
stretch misses a sixteenth of a verbatim copy at most. A stretch that reaches t shares t*b/(2-t) bigrams at least with its
template, so a text that has fewer of them is not searched for it. Before all that, a text must have one of a few telling
words of the templates that it is long enough for: so many of a template's bigrams hold one that the others are too few.
"""

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.sources import load

THRESHOLD = 0.8

# Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Full licence texts, searched in stretches of words only.
FULL_TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Stretches of a template of n words begin n/STEPS words apart; templates that are this alike are rivals for one place.
STEPS, RIVALS = 8, 0.5
#: Telling words are looked for by size of template: in a text of n words, those of templates that need fewer bigrams.
CLASSES = (30, 150, 1000)
# Words too frequent to tell a licence.
_FREQUENT = frozenset(
    "the of and to or in a this any is you for that by with be as are not on may if from at an it which such your all can use other without under no but work works including these do we will above must shall its has have was their they our who what when where so than then them there here only more some one two first new own out up into about over also each many most same part case time make made way used using who his her she he him would could should been being were does did how s b c 0 1 2 3 4".split()
)


def _plain_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()


def _plain_bigrams(text: str) -> list[str]:
    w = _plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


@dataclass
class Template:
    id: str
    words: int
    bigrams: list[str]
    need: int
    group: int = 0

    @property
    def step(self) -> int:
        return max(1, self.words // STEPS)

    def telling(self) -> set[str]:
        """Words without any of which a text has fewer than ``need`` of the bigrams."""
        left, out = {tuple(g.split(" ")) for g in self.bigrams}, set()
        while len(left) >= self.need:
            counts = Counter(w for pair in left for w in set(pair))
            word = min(counts, key=lambda w: (w in _FREQUENT, -counts[w], w))
            out.add(word)
            left = {pair for pair in left if word not in pair}
        return out


def stretch_templates(texts: dict[str, str], threshold: float = THRESHOLD) -> list[Template]:
    """The templates by id, with rivals (and rivals of rivals) in one group."""
    low = threshold / (2 - threshold)
    out = []
    for name, text in sorted(texts.items()):
        bigrams = _plain_bigrams(text)
        if bigrams:
            out.append(Template(name, len(_plain_words(text)), bigrams, max(1, math.ceil(low * len(bigrams) - 1e-9)), len(out)))
    for i, t in enumerate(out):
        for u in out[:i]:
            if 2 * len(set(t.bigrams) & set(u.bigrams)) >= RIVALS * (len(t.bigrams) + len(u.bigrams)) and t.group != u.group:
                old, new = max(t.group, u.group), min(t.group, u.group)
                for x in out:
                    x.group = new if x.group == old else x.group
    return out


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _dice(shared: Column, a: Column, b: Column) -> Column:
    return F.lit(2.0) * shared / (a + b)


def _told(templates: list[Template]) -> Column:
    """Whether ``_words`` may reach the threshold with a template, by telling words."""
    out = F.lit(False)
    for low, high in zip((0, *CLASSES), (*CLASSES, float("inf"))):
        some = [t for t in templates if low < t.need <= high]
        if some:
            telling = sorted(set().union(*(t.telling() for t in some)))
            out |= (F.size("_words") > min(t.need for t in some)) & F.arrays_overlap("_words", F.split(F.lit(" ".join(telling)), " "))
    return out


def _grams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _units(templates: list[Template], threshold: float) -> Column:
    """The whole text and the lines (``_words``, ``_lines``) that reach the threshold: structs unit, id, n_bigrams, dice."""
    slack = 1e-9
    low, high = threshold / (2 - threshold) - slack, (2 - threshold) / threshold + slack
    ids = F.split(F.lit("\n".join(t.id for t in templates)), "\n")
    sizes = [len(t.bigrams) for t in templates]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.split(F.lit("\n".join(t.bigrams)), "\n").alias("b")) for i, t in enumerate(templates)])

    def few(w: Column) -> Column:
        # Distinct words less one is a lower bound of distinct bigrams, words less one an upper bound.
        return (F.size(w) - 1 >= low * min(sizes)) & (F.size(F.array_distinct(w)) - 1 <= high * max(sizes))

    def top(x: Column) -> Column:
        def of(b: Column) -> Column:
            close = F.filter(table, lambda t: _dice(F.least(F.size(b), F.size(t["b"])), F.size(b), F.size(t["b"])) >= threshold)
            rated = F.transform(close, lambda t: F.struct(_dice(F.size(F.array_intersect(b, t["b"])), F.size(b), F.size(t["b"])).alias("dice"), (-t["i"]).alias("n")))
            return F.struct(x["unit"].alias("unit"), F.size(b).alias("n_bigrams"), F.array_max(F.filter(rated, lambda r: r["dice"] >= threshold)).alias("top"))

        return _let(F.array_distinct(_grams(x["w"])), of)

    units = F.transform(F.concat(F.array("_words"), F.col("_lines")), lambda w, i: F.struct(w.alias("w"), i.alias("unit")))
    found = F.filter(F.transform(F.filter(units, lambda x: few(x["w"])), top), lambda x: x["top"].isNotNull())
    none = F.lit(None).cast("int")
    return F.transform(
        found, lambda x: F.struct(x["unit"].alias("unit"), none.alias("first_word"), F.get(ids, -x["top"]["n"]).alias("license_id"), x["n_bigrams"].alias("n_bigrams"), x["top"]["dice"].alias("dice"))
    )


def _stretches(templates: list[Template], threshold: float) -> Column:
    """The stretches of words (``_grams``, ``_distinct``) that reach the threshold, the best of those that overlap."""
    groups: dict[int, list[Template]] = {}
    for t in templates:
        groups.setdefault(t.group, []).append(t)

    def literal(t: Template) -> Column:
        return F.struct(F.lit(t.id).alias("id"), F.lit(t.words).alias("n"), F.lit(t.step).alias("step"), F.lit(t.need).alias("need"), F.split(F.lit("\n".join(t.bigrams)), "\n").alias("b"))

    # Stretches of a group that overlap one are at most ``reach`` places away from it in their order by first word.
    reach = {g: sum(max(x.words for x in ts) // t.step + 3 for t in ts) for g, ts in groups.items()}
    table = F.array(*[F.struct(F.lit(reach[g]).alias("reach"), F.array(*map(literal, ts)).alias("ts")) for g, ts in groups.items()])
    met, n_words = F.size("_distinct"), F.size("_grams") + 1

    def near(t: Column) -> Column:
        return F.when(t["need"] <= met, F.size(F.array_intersect(F.col("_distinct"), t["b"])) >= t["need"]).otherwise(False)

    def rated(t: Column) -> Column:
        last = F.greatest(n_words - t["n"], F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, t["step"]), F.array(last)))

        def of(k: Column) -> Column:
            return _let(
                F.array_distinct(F.slice("_grams", k + 1, t["n"] - 1)),
                lambda w: F.struct(
                    k.alias("first"), t["id"].alias("id"), F.least(t["n"], n_words).alias("n"), F.size(w).alias("n_bigrams"),
                    _dice(F.size(F.array_intersect(w, t["b"])), F.size(w), F.size(t["b"])).alias("dice"),
                ),
            )

        return F.filter(F.transform(starts, of), lambda r: r["dice"] >= threshold)

    def best(found: Column, reach: Column) -> Column:
        def beaten(x: Column, y: Column) -> Column:
            overlap = (y["first"] < x["first"] + x["n"]) & (x["first"] < y["first"] + y["n"])
            earlier = (y["first"] < x["first"]) | ((y["first"] == x["first"]) & (y["id"] < x["id"]))
            return overlap & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & earlier))

        return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1), lambda y: beaten(x, y)))

    kept = F.transform(table, lambda g: _let(F.array_sort(F.flatten(F.transform(F.filter(g["ts"], near), rated))), lambda found: best(found, g["reach"])))
    none = F.lit(None).cast("int")
    return F.transform(
        F.flatten(kept), lambda x: F.struct(none.alias("unit"), x["first"].alias("first_word"), x["id"].alias("license_id"), x["n_bigrams"].alias("n_bigrams"), x["dice"].alias("dice"))
    )


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", full: dict[str, str] = FULL_TEXTS
) -> DataFrame:
    """A row for each line, or whole text, that reaches ``threshold`` with a template: the other columns of ``docs``, unit
    (0: the whole text, from 1: its lines), license_id of the best template (ties: the first by name), n_bigrams, dice;
    first_word is null.

    And a row for each stretch of words that reaches it with a template of ``templates`` or ``full`` and that no better
    stretch of the same template or a rival (one of alike text) overlaps (ties: the first, then by name): first_word counts
    the words of the text from 0, unit is null. Of a text shorter than a template the stretch is the whole text.

    Null, empty and one-word texts have no bigrams and no rows; long texts are compared whole; repeated rows give repeated
    rows; input columns of the names above give way. Templates are a bounded literal (their texts go into the plan).
    """
    added = ["unit", "first_word", "license_id", "n_bigrams", "dice"]
    names = [c for c in docs.columns if c != text_col and c not in added]
    short, every = stretch_templates(templates, threshold), stretch_templates({**templates, **{f"{k} text": v for k, v in full.items()}}, threshold)
    if not short:
        raise ValueError("no template has two words")

    def once(df: DataFrame, name: str, value: Column, *others: str) -> DataFrame:
        """A column that later ones read many times but that is made once: projects would be merged, explode is not."""
        return df.select(*others, F.explode(F.array(value)).alias(name))

    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text")).filter("_text is not null")
    at = once(at, "_words", _words(F.col("_text")), "_row", "_text").filter(_told(every))
    at = once(at, "_lines", F.transform(F.split("_text", "\n"), _words), "_row", "_words")
    at = once(at, "_grams", _grams(F.col("_words")), "_row", "_words", "_lines")
    at = once(at, "_distinct", F.array_distinct("_grams"), "_row", "_words", "_lines", "_grams")
    out = at.select("_row", F.explode(F.concat(_units(short, threshold), _stretches(every, threshold))).alias("m"))
    return out.select(*[F.col(f"_row.`{c}`") for c in names], *[F.col(f"m.{c}").alias(c) for c in added])


def query(spark, sf_dir):
    long = [F.col(c).cast("bigint").alias(c) for c in ("unit", "first_word", "n_bigrams")]
    return scan(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *long, "license_id", "dice")


def _sql() -> str:
    def quoted(texts: dict[str, str]) -> str:
        return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(texts.items()))

    norm = f"string_split(trim(regexp_replace(translate({{}}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    t = THRESHOLD
    known = stretch_templates({**TEMPLATES, **{f"{k} text": v for k, v in FULL_TEXTS.items()}})
    facts = ", ".join(f"('{x.id}', {x.words}, {x.step}, {x.need}, {x.group})" for x in known)
    return f"""
WITH template AS (SELECT id, {pairs} AS b FROM (SELECT id, {norm.format("txt")} AS w FROM (VALUES {quoted(TEMPLATES)}) v(id, txt))),
 unit AS (SELECT doc_id, 0 AS unit, text AS u FROM documents WHERE text IS NOT NULL
   UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS u
   FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
 pairs AS (SELECT doc_id, unit, {pairs} AS a FROM (SELECT doc_id, unit, {norm.format("u")} AS w FROM unit) WHERE len(w) >= 2),
 rated AS (SELECT doc_id, unit, id, len(a) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
   FROM pairs, template WHERE 2.0::DOUBLE * least(len(a), len(b)) / (len(a) + len(b)) >= {t}::DOUBLE),
 lines AS (SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(NULL AS BIGINT) AS first_word, any_value(n_bigrams) AS n_bigrams, arg_min(id, id) AS license_id, any_value(dice) AS dice
   FROM (SELECT *, rank() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC) AS r FROM rated WHERE dice >= {t}::DOUBLE) WHERE r = 1
   GROUP BY doc_id, unit),
 fact AS (SELECT * FROM (VALUES {facts}) v(id, n, step, need, grp)),
 every AS (SELECT id, n, step, need, grp, {pairs} AS b
   FROM (SELECT fact.*, {norm.format("txt")} AS w FROM fact JOIN (VALUES {quoted({**TEMPLATES, **{f"{k} text": v for k, v in FULL_TEXTS.items()}})}) v(id, txt) USING (id))),
 doc AS (SELECT row_number() OVER () AS rn, doc_id, len(w) AS nw, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g
   FROM (SELECT doc_id, {norm.format("text")} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 2),
 near AS (SELECT * FROM doc, every WHERE need <= nw AND len(list_intersect(list_distinct(g), b)) >= need),
 start AS (SELECT DISTINCT rn, doc_id, nw, g, id, n, grp, b, unnest(list_append(range(0, greatest(nw - n, 0) + 1, step), greatest(nw - n, 0))) AS k FROM near),
 stretch AS (SELECT rn, doc_id, id, grp, k, least(n, nw) AS n, b, list_distinct(g[k + 1:k + n - 1]) AS a FROM start),
 passed AS (SELECT rn, doc_id, id, grp, k, n, len(a) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM stretch),
 good AS (SELECT * FROM passed WHERE dice >= {t}::DOUBLE)
SELECT doc_id, unit, first_word, n_bigrams, license_id, dice FROM lines
UNION ALL SELECT doc_id, CAST(NULL AS BIGINT), CAST(k AS BIGINT), n_bigrams, id, dice FROM good x
WHERE NOT EXISTS (SELECT 1 FROM good y WHERE y.rn = x.rn AND y.grp = x.grp AND y.k < x.k + x.n AND x.k < y.k + y.n
  AND (y.dice > x.dice OR (y.dice = x.dice AND (y.k < x.k OR (y.k = x.k AND y.id < x.id)))))"""


QUERIES = {"op2_license_scan": query}
ORACLES = {"op2_license_scan": _sql()}
