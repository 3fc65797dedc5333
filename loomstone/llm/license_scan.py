"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens of the templates are ordered by how many documents of the corpus hold them, rarest first. A
block whose token set holds c = ceil(threshold * size) of a template's tokens shares a token with it
within both prefixes, of sizes block - c + 1 and template - c + 1; it has c template tokens at least
(length filter); and what follows the first shared token is long enough for c (positional filter).
What passes is counted exactly. Only documents that hold a prefix token are cut into blocks at all.
All of it is DataFrame expressions; templates are a fixed list, so nothing is shuffled but counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Containment that a block must reach. A notice of a few words differs from its siblings by one of them, so it allows for none.
THRESHOLDS = {"line": 0.95, "paragraph": 0.8}
#: The phrases of the op8 contract and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Templates, a parameter: (label, block they are held against, wording). Short notices stand on a line, license texts in a paragraph.
TEMPLATES = [
    ("mit-notice", "line", "Released under the MIT License"),
    ("mit-notice", "line", "Licensed under the MIT License"),
    ("apache-2.0", "line", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "line", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "line", "This work is licensed under the GNU General Public License, version 2"),
    ("cc-by-nc-4.0", "line", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "line", "Licensed under CC BY-SA 4.0"),
    ("mpl-2.0", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit-text", "paragraph", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-text", "paragraph", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-text", "paragraph", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-text", "paragraph", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda w: w != "")


def template_tokens(wording: str) -> list[str]:
    """The distinct words of a template, by the same rule as a text's."""
    lowered = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in wording.lower())
    return sorted(set(lowered.split()))


def _literal(tokens: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in tokens)) if tokens else F.array().cast("array<string>")


def prepared(documents: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep`, the lower-cased text and its words."""
    kept = [F.col(f"`{c}`") for c in keep]
    low = documents.select(*kept, F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), _UPPER, _LOWER).alias("__low"))
    return low.select("*", _words(F.col("__low")).alias("__words"))


def rarity_order(documents: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The vocabulary by the number of documents that hold a token, rarest first; ties by spelling."""
    held = prepared(documents, [], text).select(F.explode(F.array_intersect("__words", _literal(vocabulary))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _matches(blocks: Column, order: list[str], templates: list[tuple[str, list[str], int]]) -> Column:
    """Of an array of blocks: the (label, containment) of every block and template that reach the threshold."""
    ranked = {t: k for k, t in enumerate(order)}
    table = []
    for label, tokens, need in templates:
        mine = sorted(tokens, key=ranked.__getitem__)
        table.append(F.struct(F.lit(label).alias("label"), _literal(mine).alias("tokens"), _literal(mine[: len(mine) - need + 1]).alias("prefix"), F.lit(need).alias("need")))
    index = F.array(*table)
    used = _literal(order)

    def of_block(block: Column) -> Column:
        held = F.array_intersect(used, _words(block))  # in the order of the first: rarest first

        def passes(t: Column) -> Column:
            room = F.size(held) - t["need"]
            prefix = F.slice(held, 1, F.greatest(room + 1, F.lit(0)))
            shared = F.array_intersect(prefix, t["prefix"])
            first = F.get(shared, F.lit(0))
            left = F.least(F.size(held) - F.array_position(held, first), F.size(t["tokens"]) - F.array_position(t["tokens"], first)) + 1
            return (room >= 0) & (F.size(shared) > 0) & (left >= t["need"]) & (F.size(F.array_intersect(held, t["tokens"])) >= t["need"])

        return F.transform(F.filter(index, passes), lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(held, t["tokens"])) / F.size(t["tokens"])).alias("part")))

    return F.flatten(F.transform(blocks, of_block))


def scan(documents: DataFrame, keep: list[str], templates: list[tuple[str, str, str]] | None = None, thresholds: dict[str, float] | None = None, text: str = "text") -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    Labels of templates that some block reaches are added to the phrases'. The score is 1 with a
    phrase, else the largest containment that reached the threshold, else 0. A null or empty text has
    no words, empty labels and score 0. Rows are judged one by one, so repeated rows and null keys
    need no care.
    """
    least = THRESHOLDS | (thresholds or {})
    listed = [(label, unit, template_tokens(wording)) for label, unit, wording in (TEMPLATES if templates is None else templates)]
    listed = [(label, unit, tokens, max(1, math.ceil(round(least[unit] * len(tokens), 9)))) for label, unit, tokens in listed if tokens]
    order = rarity_order(documents, sorted({t for _, _, tokens, _ in listed for t in tokens}), text) if listed else []
    ranked = {t: k for k, t in enumerate(order)}
    prefixes = sorted({t for _, _, tokens, need in listed for t in sorted(tokens, key=ranked.__getitem__)[: len(tokens) - need + 1]})

    kept = [F.col(f"`{c}`") for c in keep]
    rows = prepared(documents, keep, text).withColumn("n_words", F.size("__words").cast("long"))
    word = lambda i: F.get("__words", i)

    def phrase_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            fits = word(i) == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                fits = fits & F.coalesce(word(i + k) == w, F.lit(False))
            out = F.when(fits, F.lit(label)).otherwise(out)
        return out

    places = F.filter(F.transform("__words", lambda _, i: F.struct(i.alias("i"), phrase_at(i).alias("label"))), lambda x: x["label"].isNotNull())
    none = F.array().cast("array<struct<i:int,label:string>>")
    rows = rows.withColumn("__places", F.when(F.col("__low").contains("license"), places).otherwise(none))
    by_unit = []
    for unit, pattern in (("line", "\n"), ("paragraph", r"\n[\x20\x09-\x0D]*\n")):
        mine = [(label, tokens, need) for label, u, tokens, need in listed if u == unit]
        if mine:
            by_unit.append(_matches(F.split("__low", pattern), order, mine))
    empty = F.array().cast("array<struct<label:string,part:double>>")
    found = F.when(F.arrays_overlap("__words", _literal(prefixes)), F.concat(*by_unit)).otherwise(empty) if by_unit else empty
    rows = rows.withColumn("__found", found).drop("__low", "__words")
    base = F.array_sort(F.array_distinct(F.transform("__places", lambda x: x["label"])))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("__places", lambda x: x["label"]), F.transform("__found", lambda x: x["label"]))))
    spots = F.transform("__places", lambda x: x["i"].cast("long"))
    return rows.select(
        *kept,
        "n_words",
        F.size("__places").cast("long").alias("n_base"),
        F.array_min(spots).alias("first_word"),
        F.array_max(spots).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("__places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__found", lambda x: x["part"])), F.lit(0.0))).alias("score"),
    )
