"""Licence scans: normalised lines and paragraphs against licence templates, by Dice over word bigrams.

All of it is one projection of DataFrame functions. A text is looked at closely only if it has a probe
word; probe words are chosen so that whatever reaches the threshold has one. Of a unit's templates only
those in reach of its number of bigrams are compared: 2 * min(a, b) / (a + b) bounds the coefficient.

Texts without a match, empty and null ones too, return null, 0 and an empty list. Among templates of the
same coefficient the first by name wins. Repeated rows return repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80

#: Notices and headers by which public licences are declared.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))  # noqa: B905


def flat(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, b) for name in sorted(templates) for text in templates[name] if (b := bigrams_of(text))]


def probe_words(templates: list[tuple[str, list[str]]], percent: int) -> list[str]:
    """A few words such that each template has more bigrams with one of them than a match may miss.

    A match shares at least p / (200 - p) of the template's bigrams, so it misses at most the rest."""
    spread = Counter(w for _, bs in templates for w in {w for b in bs for w in b.split()})
    chosen: list[str] = []
    for _, bs in sorted(templates, key=lambda t: len(t[1])):
        may_miss = len(bs) - -(-len(bs) * percent // (200 - percent))
        held = lambda: sum(any(w in chosen for w in b.split()) for b in bs)  # noqa: B023, E731
        for w in sorted({w for b in bs for w in b.split()}, key=lambda w: (len(w) < 5, -spread[w], w)):
            if held() > may_miss:
                break
            if w not in chosen:
                chosen.append(w)
    return [w for w in chosen if not any(v != w and v in w for v in chosen)]


def _normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def _bigrams(unit: Column) -> Column:
    w = F.split(unit, " ")
    return F.array_distinct(F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))


def scanned(df: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``df`` with license (of the best match), dice, and license_matches: unit's text, license and dice of every match.

    Units are the lines of a text and its paragraphs of several lines."""
    known = flat(templates)
    whole = F.coalesce(F.col(text), F.lit(""))
    has_probe = lambda c: F.exists(F.array(*map(F.lit, probe_words(known, percent))), lambda w: F.contains(c, w))
    paragraphs = F.filter(F.split(whole, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.filter(F.concat(F.split(whole, "\n"), paragraphs), lambda u: has_probe(F.lower(u)))
    candidates = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("bigrams")) for name, b in known))

    def matches(unit: Column) -> Column:
        held = unit["bigrams"]
        n = F.size(held)
        in_reach = F.filter(candidates, lambda t: 200 * F.least(t["n"], n) >= percent * (t["n"] + n))
        compared = F.transform(in_reach, lambda t: F.struct(unit["text"].alias("unit"), t["license"].alias("license"), F.size(F.array_intersect(held, t["bigrams"])).alias("shared"), (t["n"] + n).alias("sum")))
        return F.filter(compared, lambda m: 200 * m["shared"] >= percent * m["sum"])

    found = F.flatten(F.transform(F.transform(units, lambda u: F.struct(u.alias("text"), _bigrams(_normal(u)).alias("bigrams"))), matches))
    found = F.transform(found, lambda m: F.struct(m["unit"].alias("unit"), m["license"].alias("license"), F.round(2 * m["shared"] / m["sum"], 6).alias("dice")))
    none = F.array().cast("array<struct<unit:string,license:string,dice:double>>")
    best = F.array_min(F.transform("license_matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return df.withColumn("license_matches", F.when(has_probe(F.lower(whole)), found).otherwise(none)).withColumns({"license": best["license"], "dice": F.coalesce(-best["d"], F.lit(0.0))})


def per_document(docs: DataFrame) -> DataFrame:
    """doc_id, license, dice and n_matches of every row."""
    return scanned(docs.select("doc_id", "text")).select("doc_id", "license", "dice", F.size("license_matches").cast("long").alias("n_matches"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same in SQL without the probes."""
    rows = ", ".join(f"({i}, {_quoted(name)}, [{', '.join(map(_quoted, b))}])" for i, (name, b) in enumerate(flat(TEMPLATES)))
    return rf"""
WITH t(k, license, bigrams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (SELECT r, unnest(string_split(text, chr(10)) || list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10)))) AS unit FROM docs),
words AS (SELECT r, row_number() OVER () AS u, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
held AS (SELECT r, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words),
matched AS (SELECT r, license, 2.0 * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice FROM held, t WHERE 200 * len(list_intersect(b, bigrams)) >= {THRESHOLD_PERCENT} * (len(b) + len(bigrams))),
best AS (SELECT r, count(*) AS n, min(struct_pack(d := -round(dice, 6), l := license)) AS m FROM matched GROUP BY r)
SELECT doc_id, m.l AS license, coalesce(-m.d, 0.0) AS dice, coalesce(n, 0) AS n_matches FROM docs LEFT JOIN best USING (r)"""
