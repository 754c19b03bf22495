"""Licence scan by sentence rules, in DataFrame functions only.

Known licence sentences have identifiers. A text is cut into sentences, each sentence is
normalised (lower case, letters and digits, single spaces) and looked up; the identifiers
found, in the order of the text, are matched against rules. A line break cuts too, and a
known sentence is also found where it is spread over lines that follow each other, blank
ones and comment marks (``*``, ``#``, ``//`` and others without letters) left out: every
line or sentence gives the identifier it has alone, then that of the longest known sentence
that begins with it and ends with a later one. A rule is an ordered list of
identifiers; it matches when they occur in this order, whatever stands between. A rule
whose identifiers are part of a longer matching rule's adds nothing.

The sentences and rules are parameters of fixed size, held in the plan; texts are only
scanned, nothing is shuffled.

Nulls and ties. A null or empty text has no sentences and no licence. Repeated sentences
give repeated identifiers; a licence is named once, in alphabetical order. Rows are never
merged, further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import fresh

# Sentences of public licence notices.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the Apache License, Version 2.0.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
       "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
       "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
       "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
       "subject to the following conditions:",
    6: "The above copyright notice and this permission notice shall be included in all copies or substantial "
       "portions of the Software.",
    7: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
       "compliance with the License.",
    8: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    9: "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
       "that the following conditions are met:",
    10: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    11: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
RULES = (
    ("MIT", (1,)),
    ("Apache-2.0", (2,)),
    ("GPL-3.0", (3,)),
    ("CC-BY-NC-4.0", (4,)),
    ("MIT", (5, 6)),
    ("Apache-2.0", (7, 8)),
    ("BSD-3-Clause", (9, 10)),
    ("BSD-2-Clause", (9,)),
    ("CC-BY-4.0", (11,)),
)
SENTENCE_END = r"(?<=[.!?:])[ \t\n\x0B\f\r]+"


def normalised(text: Column) -> Column:
    """The sentences and lines of a text, each normalised, between line breaks."""
    cut = F.regexp_replace(F.lower(text), SENTENCE_END, "\n")
    plain = F.regexp_replace(cut, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), plain, F.lit("\n")), r" ?(?:\n ?)+", "\n")


def plain(sentence: str) -> str:
    """``normalised`` for the sentences of the table."""
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def _matches(sequence: Column, ids: tuple) -> Column:
    return sequence.rlike(",(?:[0-9]+,)*?".join(f"(?<![0-9]){i}" for i in ids) + ",")


def scan_licenses(docs: DataFrame, text_col: str = "text", sentences: dict = SENTENCES,
                  rules: tuple = RULES) -> DataFrame:
    """``docs`` plus one struct ``license_scan``: ``sentence_ids`` (array) and ``licenses``
    (array of names); it takes the place of a column of that name."""
    known = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (plain(s), i)]) \
        if sentences else F.lit(None).cast("map<string,int>")
    # One match per piece: the piece, and the longest known sentence over it and later ones.
    spread = "|".join(r"[ \n]".join(x.split()) for x in
                      sorted(map(plain, sentences.values()), key=len, reverse=True) if x) or "(?!)"
    each = F.lit(rf"\n(?=([^\n]+)\n)(?:(?=({spread})\n))?")
    text = normalised(F.coalesce(F.col(text_col), F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(text, each, F.lit(1)).alias("line"),
                         F.regexp_extract_all(text, each, F.lit(2)).alias("run"))
    ids = F.filter(F.flatten(F.transform(pairs, lambda x: F.array(
        F.try_element_at(known, x["line"]),
        F.when(F.contains(x["run"], F.lit("\n")), F.try_element_at(known, F.translate(x["run"], "\n", " ")))))),
        lambda i: i.isNotNull())
    held, seq = fresh(docs, "_ids", "_seq")
    found = docs.withColumn(held, ids).withColumn(seq, F.concat(F.array_join(held, ","), F.lit(",")))
    names = []
    for name, rule in rules:
        hit = _matches(F.col(seq), rule)
        for _, other in rules:  # part of a longer rule that matches as well
            if len(other) > len(rule) and set(rule) <= set(other):
                hit = hit & ~_matches(F.col(seq), other)
        names.append(F.when(hit, F.lit(name)))
    licenses = F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))) \
        if names else F.array().cast("array<string>")
    return found.withColumn("license_scan", F.struct(
        F.col(held).alias("sentence_ids"), licenses.alias("licenses"))).drop(held, seq)
