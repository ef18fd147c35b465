"""Licence notices and texts, compared with templates by the Dice coefficient over word bigrams, in columns only.

A text's units are its lines, cut further where a sentence ends before a capital letter. A unit is normalised (ASCII
lower case, all but letters and digits as one space) and its set of word bigrams compared with each template whose
size allows the coefficient THRESHOLD: 2 * |A & B| >= t * (|A| + |B|) needs t/(2-t) * |B| <= |A| <= (2-t)/t * |B|.
Before that, texts without any key word of a template are passed over: a unit that reaches the threshold shares at
least t/(2-t) of a template's bigrams, and each template's key words touch so many of its bigrams that one is among
them.

Notices that are wrapped, headers, grant paragraphs and full licences (the files of `licence_texts`) are found in the
words of the whole text, joined over its lines. A template is a candidate if the whole text holds as many of its
bigrams as a match must share. A candidate is compared with the whole text, each paragraph, and windows of the template's number
of words that begin at every word (templates of more than 127 words: at every 1/64 of their length, which costs less than 2 % of
the coefficient). One-sentence notices found so count only outside matching units. Of places that overlap the best is
taken: greatest score, then the longer one, then first name.

Cases: null and empty texts match nothing (no licence, 0 units, score 0); of equal scores the template that sorts
first counts; a notice that repeats counts each time; n_units counts matching units, and places of joined lines that
hold none; equal texts have equal results, whatever their ids, which may repeat or be null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Common one-sentence notices of public licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words too frequent in any text to be chosen as key words while others are left.
FREQUENT = {"a", "all", "and", "any", "are", "by", "for", "general", "in", "is", "of", "or", "the", "this", "to", "under", "with", "without"}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def key_words(bigrams: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Words, infrequent and long ones first, until fewer bigrams avoid them than a match must share."""
    need, left, out = math.ceil(threshold / (2 - threshold) * len(bigrams) - 1e-9), set(bigrams), []
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in FREQUENT, -len(w), w)):
        if len(left) < need:
            break
        touched = {b for b in left if word in b.split()}
        if touched:
            left -= touched
            out.append(word)
    return out


@lru_cache(maxsize=1)
def long_texts() -> list[tuple[str, str]]:
    """Licence and text of the real headers, grant paragraphs and full licences."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [(f.name.rsplit(".", 2)[0], f.read_text(encoding="utf-8")) for f in files]


def key_pattern(threshold: float = THRESHOLD) -> str:
    texts = [*TEMPLATES.values(), *(text for _, text in long_texts())]
    words = {w for text in texts for w in key_words(template_bigrams(text), threshold)}
    first = {c: sorted(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return rf"(?i)(?:^|[^a-z0-9])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in first.items())})(?:[^a-z0-9]|$)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _template(name: str, text: str, threshold: float, notice: bool) -> Column:
    grams, size = template_bigrams(text), len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())
    least, most = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9), math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
    values = {"n": len(grams), "least": least, "most": most, "words": size, "step": max(1, size // 64), "notice": notice}
    return F.struct(F.lit(name).alias("name"), F.split(F.lit(",".join(grams)), ",").alias("grams"), *(F.lit(v).alias(k) for k, v in values.items()))


def _joined(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def places(paragraphs: Column, threshold: float) -> Column:
    """Hits (score, name, inside) of disjoint places in joined lines. inside: there is a matching unit within.

    paragraphs: the arrays of units (words and whether they match)."""
    templates = F.array(*(_template(k, v, threshold, True) for k, v in sorted(TEMPLATES.items())), *(_template(k, v, threshold, False) for k, v in long_texts()))

    def search(signs: Column, grams: Column) -> Column:
        n = F.size(signs)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(signs, i - 1)["k"] != F.get(signs, i - 2)["k"]))
        ends = F.concat(F.slice(begins, F.lit(2), F.size(begins) - 1), F.array(n + 1))
        spans = F.concat(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("at"), (e - b).alias("size"))), F.array(F.struct(F.lit(1).alias("at"), n.alias("size"))))

        def of(t: Column, spans: Column) -> Column:
            last = F.greatest(n - t["words"] + 1, F.lit(1))
            windows = F.transform(F.concat(F.sequence(F.lit(1), last, t["step"]), F.array(last)), lambda at: F.struct(at.alias("at"), F.least(t["words"], n).alias("size")))
            fit = F.filter(spans, lambda s: s["size"] > t["least"])

            def scored(s: Column) -> Column:
                return _let(F.array_distinct(F.slice(grams, s["at"], s["size"] - 1)), lambda g: F.struct(
                    F.when((F.size(g) >= t["least"]) & (F.size(g) <= t["most"]), 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).otherwise(0.0).alias("score"),
                    s["at"].alias("at"), (s["at"] + s["size"] - 1).alias("end"), F.exists(F.slice(signs, s["at"], s["size"]), lambda x: x["hit"]).alias("inside"),
                ))

            good = F.filter(F.transform(F.concat(windows, fit), scored), lambda s: (s["score"] >= threshold) & ~(t["notice"] & s["inside"]))
            return F.transform(good, lambda s: F.struct((-s["score"]).alias("rank"), (s["at"] - s["end"]).alias("short"), t["name"].alias("name"), s["at"].alias("at"), s["end"].alias("end"), s["inside"].alias("inside")))

        candidates = _let(F.array_distinct(grams), lambda own: F.filter(templates, lambda t: (F.size(own) >= t["least"]) & (F.size(F.array_intersect(own, t["grams"])) >= t["least"])))
        hits = F.array_sort(_let(candidates, lambda c: F.when(F.size(c) > 0, _let(spans, lambda s: F.flatten(F.transform(c, lambda t: of(t, s)))))))
        none = F.array().cast("array<struct<rank:double,short:int,name:string,at:int,end:int,inside:boolean>>")
        taken = F.aggregate(F.coalesce(hits, none), none, lambda kept, h: F.when(F.exists(kept, lambda k: (k["at"] <= h["end"]) & (h["at"] <= k["end"])), kept).otherwise(F.concat(kept, F.array(h))))
        return F.transform(taken, lambda h: F.struct((-h["rank"]).alias("score"), h["name"].alias("name"), h["inside"].alias("inside")))

    # every word with its paragraph and whether its unit matches
    signs = F.flatten(F.transform(paragraphs, lambda p, k: F.flatten(F.transform(p, lambda u: F.transform(u["words"], lambda w: F.struct(w.alias("w"), k.alias("k"), u["hit"].alias("hit")))))))
    return _let(signs, lambda x: F.when(F.size(x) > 1, _let(_joined(F.transform(x, lambda s: s["w"])), lambda g: search(x, g))))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the best matching licence with its score, all licences found and the number of matching units."""
    templates = F.array(*(_template(k, v, threshold, True) for k, v in sorted(TEMPLATES.items())))

    def words(unit: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.translate(unit, ascii_uppercase, ascii_lowercase), "[^a-z0-9]+", " "), " "), lambda w: w != "")

    def matches(own: Column) -> Column:
        near = F.filter(templates, lambda t: (F.size(own) >= t["least"]) & (F.size(own) <= t["most"]))
        scored = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])).alias("score"), t["name"].alias("name")))
        return F.filter(scored, lambda s: s["score"] >= threshold)

    def unit(text: Column) -> Column:
        return _let(words(text), lambda w: _let(_let(F.array_distinct(_joined(w)), matches), lambda m: F.struct(w.alias("words"), m.alias("found"), (F.size(m) > 0).alias("hit"))))

    def units(text: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+([A-Z])", "$1\n$2"), "\n"), unit)

    def both(paragraphs: Column) -> Column:
        lines = F.transform(F.filter(F.flatten(paragraphs), lambda u: u["hit"]), lambda u: u["found"])
        return F.struct(lines.alias("lines"), places(paragraphs, threshold).alias("places"))

    found = F.when(F.col("text").rlike(key_pattern(threshold)), _let(F.transform(F.split("text", r"\n[^\S\n]*\n"), units), both))
    scanned = docs.select("doc_id", found.alias("found"))
    # the best of a unit and of a text: greatest score, then first name
    better = lambda a, b: F.when(a["score"].isNull() | (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["name"] < a["name"])), b).otherwise(a)
    nothing = F.lit(None).cast("struct<score:double,name:string>")
    lines = F.coalesce("found.lines", F.array().cast("array<array<struct<score:double,name:string>>>"))
    joined = F.coalesce("found.places", F.array().cast("array<struct<score:double,name:string,inside:boolean>>"))
    bare = F.transform(joined, lambda s: F.struct(s["score"].alias("score"), s["name"].alias("name")))
    hits = scanned.select("doc_id", F.concat(F.flatten(lines), bare).alias("hits"), (F.size(lines) + F.size(F.filter(joined, lambda s: ~s["inside"]))).cast("long").alias("n_units"))
    best = F.aggregate("hits", nothing, better)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda s: s["name"]))), ",")
    chosen = hits.select("doc_id", best.alias("best"), names.alias("licences"), "n_units")
    return chosen.select("doc_id", F.col("best.name").alias("licence"), F.round(F.coalesce("best.score", F.lit(0.0)), 6).alias("score"), "licences", "n_units")


def oracle() -> str:
    """The one-sentence notices on single units in DuckDB."""
    rows = ", ".join(f"('{k}', {template_bigrams(v)!r})" for k, v in sorted(TEMPLATES.items()))
    t = THRESHOLD
    return f"""
WITH templates(name, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
units AS (
  SELECT row, generate_subscripts(u, 1) AS k, unnest(u) AS unit
  FROM (SELECT row, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', E'\\\\1\\n\\\\2', 'g'), E'\\n') AS u FROM docs)
),
words AS (
  SELECT row, k, string_split(trim(regexp_replace(translate(unit, '{ascii_uppercase}', '{ascii_lowercase}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
  WHERE regexp_matches(unit, '(?i)[a-z0-9][^a-z0-9]+[a-z0-9]')
),
grams AS (
  SELECT row, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2
),
hits AS (
  SELECT row, k, name, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score
  FROM grams, templates
  WHERE 2.0 * least(len(g), len(grams)) >= {t} * (len(g) + len(grams)) - 1e-9 AND 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) >= {t}
),
found AS (
  SELECT row, arg_min(name, (-score, name)) AS licence, max(score) AS score, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(DISTINCT k) AS n_units
  FROM hits GROUP BY row
)
SELECT d.doc_id, f.licence, round(CAST(coalesce(f.score, 0) AS DOUBLE), 6) AS score, coalesce(f.licences, '') AS licences, CAST(coalesce(f.n_units, 0) AS BIGINT) AS n_units
FROM docs d LEFT JOIN found f ON d.row = f.row"""
