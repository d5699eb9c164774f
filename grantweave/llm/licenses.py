r"""License scans (operator 10): a positional index of rare licence words.

Templates are the words of licence notices, whole or in the form that files
carry.  Of each template the index lists the ``ANCHORS`` mandatory words that
are rarest over all documents (their inverse document frequency is counted first,
for template words only, a bounded list), with their place in it.  In a document
these few words are looked up in one pass; a hit's place less its place in the
template is where the template would begin, and where all anchors of a template
agree it is a candidate.  A candidate counts if every word of the template's
mandatory phrases stands at its place; its share of template words found in place
is its score.  As anchors are mandatory words, no verified place is missed whichever
words are rare; how rare they are decides how few places are looked at.

Work is linear in a document's words but for the sort of its hits.  Base places
(the words of a phrase standing together) and labels are kept whatever the method
finds.  Documents without a word that some phrase needs cannot have a place or a
verified template and skip the index; which words those are follows from the
phrases, and the test is exact.  Everything stays within a document's row, so
nothing is shuffled but the word frequencies (one row per template word and task).

Defined results: a null text counts as empty: no words, no places, empty labels,
score 0; a null doc_id is carried through; repeated rows are each scanned; an
empty table yields no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, words of a notice, and the phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use "
        "or other dealings in the software",
        ("permission is hereby granted", "obtaining a copy of this software"),
    ),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that "
        "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        ("gnu general public license",),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license",),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed under cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("licensed under cc by sa",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at https mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness",
        ("permission to use copy modify",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions",
        ("permission is granted to anyone to use this software",),
    ),
)
#: Mandatory words of a template that are looked up; as many hits agree on a candidate's place.
ANCHORS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words, in lower-cased text and in text as it stands.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _vocabulary() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def _words() -> Column:
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def needed() -> list[str]:
    """Words of which every phrase, base or mandatory, holds one: the words that serve most phrases first."""
    open_ = [phrase.split() for phrase, _ in PHRASES] + [p.split() for _, _, phrases in TEMPLATES for p in phrases]
    out: list[str] = []
    while open_:
        words = sorted({w for p in open_ for w in p})
        out.append(max(words, key=lambda w: (sum(any(w in x for x in p) for p in open_), len(w))))
        open_ = [p for p in open_ if not any(out[-1] in x for x in p)]
    return out


def _may_match() -> Column:
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.lit(False)
    for word in needed():
        found = found | F.contains(low, F.lit(word))
    return found


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each template word."""
    vocabulary = _vocabulary()
    held = F.array_intersect(F.concat(_words(), F.array(F.lit(""))), F.array(*[F.lit(w) for w in [*vocabulary, ""]]))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    found = dict(counted.collect())  # one row per template word, and "" for every document
    return found.pop("", 0), found


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _mandatory(words: str, phrases: tuple[str, ...]) -> list[int]:
    """Places of the mandatory phrases' words in a notice."""
    tokens, must = words.split(), set()
    for phrase in phrases:
        p = phrase.split()
        at = next(i for i in range(len(tokens)) if tokens[i : i + len(p)] == p)
        must.update(range(at, at + len(p)))
    return sorted(must)


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _array(values: list[str]) -> str:
    return f"array({', '.join(values)})"


def _template_array() -> str:
    return _array([
        _struct(label=_literal(label), words=_array([_literal(w) for w in words.split()]), must=_array([str(m) for m in _mandatory(words, phrases)]))
        for label, words, phrases in TEMPLATES
    ])


def anchors(idf: dict[str, float]) -> list[list[tuple[str, int]]]:
    """Of each template its rarest mandatory words, as (word, place)."""
    out = []
    for _, notice, phrases in TEMPLATES:
        words = notice.split()
        must = _mandatory(notice, phrases)
        out.append([(words[i], i) for i in sorted(must, key=lambda i: (-idf[words[i]], i))[:ANCHORS]])
    return out


def _index(idf: dict[str, float]) -> str:
    """The index as a map: a word to the (template, place) pairs that it is an anchor of."""
    at: dict[str, list[str]] = {}
    for t, own in enumerate(anchors(idf)):
        for w, i in own:
            at.setdefault(w, []).append(_struct(t=str(t), i=str(i)))
    return "map(" + ", ".join(f"{_literal(w)}, {_array(places)}" for w, places in sorted(at.items())) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score per document."""
    n, df = frequencies(docs)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in _vocabulary()}
    source = docs.select(F.col("doc_id").cast("long"), "text")
    none = F.lit(None).cast("long")
    plain = source.filter(~_may_match()).select(
        "doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_WORD)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"),
        none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )

    rows = source.filter(_may_match()).select("doc_id", _words().alias("words"))
    base = " ".join(
        "WHEN " + " AND ".join(f"get(words, i + {k}) <=> {_literal(p)}" for k, p in enumerate(phrase.split())) + f" THEN {_literal(label)}"
        for phrase, label in PHRASES
    )
    places = f"filter(transform(words, (w, i) -> named_struct('at', i, 'label', CASE {base} END)), x -> x.label IS NOT NULL)"
    rows = rows.withColumn("base", F.expr(places))
    hits = f"filter(transform(words, (w, i) -> named_struct('at', i, 'places', try_element_at({_index(idf)}, w))), h -> h.places IS NOT NULL)"
    rows = rows.withColumn("hits", F.expr(hits))
    begins = "flatten(transform(hits, h -> transform(h.places, p -> named_struct('t', p.t, 'begin', h.at - p.i))))"
    rows = rows.withColumn("begins", F.array_sort(F.expr(begins)))
    # a begin that every anchor of its template says stands ANCHORS times in the sorted list
    agreed = f"filter(begins, (b, k) -> k >= {ANCHORS - 1} AND get(begins, k - {ANCHORS - 1}) <=> b)"
    rows = rows.withColumn("agreed", F.expr(agreed))
    rows = rows.withColumn("candidates", F.expr(f"transform(agreed, b -> named_struct('begin', b.begin, 'form', element_at({_template_array()}, b.t + 1)))"))
    verified = (
        "filter(candidates, c -> forall(c.form.must, m -> c.begin + m >= 0 AND get(words, c.begin + m) <=> c.form.words[m]))"
    )
    rows = rows.withColumn("verified", F.expr(verified))
    share = "transform(verified, c -> size(filter(transform(c.form.words, (w, i) -> c.begin + i >= 0 AND get(words, c.begin + i) <=> w), x -> x)) / size(c.form.words))"
    base_labels = F.sort_array(F.array_distinct(F.col("base.label")))
    found = F.sort_array(F.array_distinct(F.concat(F.col("base.label"), F.col("verified.form.label"))))
    scanned = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(found, ",").alias("labels"),
        F.coalesce(F.array_max(F.expr(share)), F.lit(0.0)).alias("score"),
    )
    return plain.unionByName(scanned)


def _sql() -> str:
    def listed(values) -> str:
        return "[" + ", ".join(values) + "]"

    forms = ", ".join(
        f"({_literal(label)}, {listed(_literal(w) for w in words.split())}, {listed(str(m + 1) for m in _mandatory(words, phrases))})"
        for label, words, phrases in TEMPLATES
    )
    cases = " ".join(
        "WHEN " + " AND ".join(f"ws[i + {k}] = {_literal(p)}" for k, p in enumerate(phrase.split())) + f" THEN {_literal(label)}"
        for phrase, label in PHRASES
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), word AS (
  SELECT rid, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), places AS (
  SELECT rid, i, CASE {cases} END AS label FROM word
), base AS (
  SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels
  FROM places WHERE label IS NOT NULL GROUP BY rid
), form(label, notice, must) AS (VALUES {forms}),
tried AS (
  SELECT rid, form.label, len(list_filter(must, lambda m: ws[i - must[1] + m] IS DISTINCT FROM notice[m])) = 0 AS verified,
         len(list_filter(range(1, len(notice) + 1), lambda k: i - must[1] + k >= 1 AND ws[i - must[1] + k] = notice[k])) / len(notice) AS share
  FROM word JOIN form ON word.w = notice[must[1]]
), found AS (
  SELECT rid, list(DISTINCT label) AS labels, max(share) AS score FROM tried WHERE verified GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""


SQL = _sql()
