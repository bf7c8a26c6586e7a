"""Operator 11: licences that texts are under, by a positional index of the rare words of licence texts. Built-in expressions only.

The index holds, for each template (a phrase, or a licence's notice), its words of the highest inverse document frequency over all the documents
scanned, with their positions in the template. Of each text, the words that are in the index are looked up; a word at p, which the template
has at q, says that the template begins at p - q. The postings are intersected by this relative position:

* a phrase is found where all its words stand consecutively from the place its rarest word points to;
* a notice is found where enough of its rare words point to the same beginning, give or take SLACK words, and each of its key phrases stands
  there whole.

A row is looked at whole by one task, nothing is shuffled but the counts of the templates' words, and only these are collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rare words of a notice that are in the index, the share of them that a place needs, and words that it may lack or have between them.
RARE, LEAST_SHARE, SLACK = 12, 0.6, 6
#: Words of all templates together; a larger set is an error, as their counts are collected and looked up in each task.
MOST_WORDS = 20_000


@dataclass(frozen=True)
class Template:
    """A label and the text it stands for: a phrase (without keys), or a notice and its mandatory phrases."""

    label: str
    text: str
    keys: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


# Phrases and labels of the contract.
PHRASES = (Template("gpl", "gnu general public license"), Template("apache", "apache license"), Template("cc-by", "cc by"), Template("mit", "mit license"))

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

# Wording of public licence notices.
NOTICES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    Template("bsd", _BSD, ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    Template("bsd-3-clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("redistributions of source code must retain", "endorse or promote products derived from this software")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", _GNU.format("General Public License", 2), ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3.0", _GNU.format("General Public License", 3), ("gnu general public license", "either version 3 of the license")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl-3.0", _GNU.format("Lesser General Public License", 3), ("gnu lesser general public license", "either version 3 of the license")),
    Template("agpl-3.0", _GNU.format("Affero General Public License", 3), ("gnu affero general public license", "either version 3 of the license")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation covered by this license",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international license",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0 international license",)),
    Template("cc0-1.0", "released under CC0 1.0 Universal, a public domain dedication", ("cc0 1 0 universal",)),
)


def candidates(template: Template) -> dict[str, int]:
    """The words that can be the template's rare ones, with their positions: those it has once; of a phrase all, where they first stand."""
    words = template.words
    return {w: words.index(w) for w in words if not template.keys or words.count(w) == 1}


def rare_count(template: Template) -> int:
    """Number of the template's words that are in the index: one of a phrase; half of a notice's, RARE at most."""
    return 1 if not template.keys else min(RARE, ceil(len(candidates(template)) / 2))


def least_count(template: Template) -> int:
    """Number of its rare words that a place of the template needs."""
    return ceil(LEAST_SHARE * rare_count(template))


@dataclass(frozen=True)
class RareIndex:
    """Templates, and for each the rare words with their positions, rarest first."""

    templates: tuple[Template, ...]
    postings: tuple[dict[str, int], ...]
    idf: dict[str, float]

    @property
    def words(self) -> list[str]:
        return sorted({w for p in self.postings for w in p})


def _words(docs: DataFrame) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> RareIndex:
    """The index of the templates with frequencies from all of ``docs``: of equally rare words the first by name."""
    known = sorted({w for t in templates for w in t.words})
    if len(known) > MOST_WORDS:
        raise ValueError(f"the templates have {len(known)} words; {MOST_WORDS} are allowed")
    own = docs.select(F.array_distinct(F.filter(_words(docs), lambda w: w.isin(known))).alias("_own"))
    # The empty string, which is no word, counts the rows.
    rows = own.select(F.explode(F.concat(F.array(F.lit("")), "_own")).alias("word")).groupBy("word").count().collect()  # a row a word of the templates
    df = {r["word"]: r["count"] for r in rows}
    total = df.pop("", 0)
    idf = {w: log((1 + total) / (1 + df.get(w, 0))) for w in known}
    postings = []
    for t in templates:
        own = candidates(t)
        rarest = sorted(own, key=lambda w: (df.get(w, 0), w))[: rare_count(t)]
        postings.append({w: own[w] for w in rarest})
    return RareIndex(tuple(templates), tuple(postings), idf)


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _at(words: Column, place: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand from a place (from 0) on."""
    return (place >= 0) & (F.slice(words, F.greatest(place, F.lit(0)).cast("int") + 1, len(phrase)) == _strings(phrase))


def _match(label: str, kind: str, start: Column, size: int, share: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), F.lit(size).cast("bigint").alias("size"), share.cast("double").alias("share"))


def _phrase_places(t: Template, postings: dict[str, int]) -> Column:
    (rare, q), size = next(iter(postings.items())), len(t.words)
    starts = F.transform(F.filter("_hits", lambda h: h["w"] == rare), lambda h: h["p"] - q)
    return F.transform(F.filter(starts, lambda p: _at(F.col("_words"), p, t.words)), lambda p: _match(t.label, "phrase", p, size, F.lit(1.0)))


def _pointers(postings: dict[str, int]) -> Column:
    """Beginnings of the template that the text's rare words point to, in order, with the position each is of."""

    def pointer(h: Column) -> Column:
        q = F.coalesce(*(F.when(h["w"] == w, F.lit(k)) for w, k in postings.items()))
        return F.struct((h["p"] - q).alias("o"), q.alias("q"))

    return F.array_sort(F.transform(F.filter("_hits", lambda h: h["w"].isin(*postings)), pointer))


def _notice_places(t: Template, postings: dict[str, int], pointers: str) -> Column:
    """Places to which enough of the rare words point, with all key phrases around them."""
    need, rare, size, found = least_count(t), len(postings), len(t.words), F.col(pointers)
    last = F.size(found) - need + 1

    def begins(k: Column) -> Column:  # the first pointer to its place, and need pointers within the slack
        o = F.get(found, k - 1)["o"]
        return (F.get(found, k + need - 2)["o"] - o <= SLACK) & ((k == 1) | (F.get(found, k - 2)["o"] < o))

    def place(k: Column) -> Column:
        o = F.get(found, k - 1)["o"]
        near = F.filter(F.slice(found, k, rare * (SLACK + 1)), lambda x: x["o"] <= o + SLACK)
        return F.struct(o.alias("o"), F.size(F.array_distinct(near["q"])).alias("n"))

    def has_keys(o: Column) -> Column:
        low, high = F.greatest(o - SLACK, F.lit(0)), F.least(o + size + 2 * SLACK, F.size("_words"))

        def holds(key: list[str]) -> Column:
            return (high - low >= len(key)) & F.exists(F.sequence(low, F.greatest(high - len(key), low)), lambda i: _at(F.col("_words"), i, key))

        return reduce(Column.__and__, map(holds, map(words_of, t.keys)))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), begins)
    places = F.filter(F.transform(starts, place), lambda x: (x["n"] >= need) & has_keys(x["o"]))
    return F.when(last >= 1, F.transform(places, lambda x: _match(t.label, "notice", x["o"], size, x["n"] / F.lit(rare))))


def license_scan(docs: DataFrame, index: RareIndex) -> DataFrame:
    """doc_id, n_words and matches (label, kind phrase or notice, start word from 0, size in words, share of its rare words found) of each row.

    A null or empty text has no words and no matches. Rows stay apart whatever their ids, which keep their type and may be null or repeated; other
    columns, whatever their names, are not looked at. A match of a notice may start up to SLACK words from where it stands, and before 0.
    """
    own = docs.select("doc_id", _words(docs).alias("_words"))
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(index.words), F.struct(i.alias("p"), w.alias("w")))), lambda h: h.isNotNull())
    own = own.select("doc_id", "_words", hits.alias("_hits"))
    notices = [k for k, t in enumerate(index.templates) if t.keys]
    own = own.select("*", *(_pointers(index.postings[k]).alias(f"_p{k}") for k in notices))
    found = [_notice_places(t, p, f"_p{k}") if t.keys else _phrase_places(t, p) for k, (t, p) in enumerate(zip(index.templates, index.postings))]
    none = F.array().cast("array<struct<label: string, kind: string, start: bigint, size: bigint, share: double>>")
    matches = F.when(F.size("_hits") > 0, F.concat(*(F.coalesce(f, none) for f in found))).otherwise(none)
    return own.select("doc_id", F.size("_words").cast("bigint").alias("n_words"), matches.alias("matches"))


def scan_report(found: DataFrame) -> DataFrame:
    """Rows of :func:`license_scan` with the number, first and last of the phrases' places, the labels of phrases and all labels, and the
    greatest share of a match."""
    phrases = F.filter("matches", lambda m: m["kind"] == "phrase")
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(ms["label"])), ",")
    return found.withColumn("_phrases", phrases).select(
        "doc_id", "n_words", F.size("_phrases").cast("bigint").alias("n_base"), F.array_min("_phrases.start").alias("first_word"), F.array_max("_phrases.start").alias("last_word"),
        labels(F.col("_phrases")).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max("matches.share"), F.lit(0.0)).alias("score"),
    )
