"""Licence scan by a positional index of rare words, in built-in functions.

Phrases and templates are word sequences. The word of highest IDF in each phrase and in each of a template's key phrases, by document
counts over the scanned table itself, is an anchor; an index holds the anchors' offsets. A sequence with a word that stands in no
document cannot stand there itself and has no anchor. Each occurrence of an anchor in a document gives the place where the template
would start. A phrase must stand there word for word. All key phrases of a template must stand word for word too, each within SLACK
words of its place in it, so words put in, left out or changed between them do no harm; the rest of a notice may differ or be cut
off, at the document's edges too. The score is the share of the template's words that stand within SLACK words of their places.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.native import id_and_text, words_of

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: How many words a key phrase may stand off its place in a template.
SLACK = 12

_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any
claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
the documentation and or other materials provided with the distribution"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
the license for the specific language governing permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either version 3 of the license or at your option any later version this program is distributed
in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu general public license for more details"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell
or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means"""

#: Label, the licence's text or the notice that it asks for, and the key phrases in it.
TEMPLATES = (
    ("apache-2.0", _APACHE, ("apache license version 2 0",)),
    ("bsd", _BSD, ("redistribution and use", "source and binary forms")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("gpl-notice", _GPL, ("gnu general public license",)),
    ("isc", _ISC, ("with or without fee",)),
    ("mit", _MIT, ("permission is hereby granted", "free of charge")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("unlicense", _UNLICENSE, ("free and unencumbered software", "public domain")),
)


def vocabulary(phrases=PHRASES, templates=TEMPLATES) -> list[str]:
    return sorted({w for text, *_ in [*phrases, *((t,) for _, t, _ in templates)] for w in text.split()})


def document_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of a fixed list of words stands, over all documents."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*[F.lit(w) for w in words]))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each listed word at most


def _places(words: list[str], phrase: str) -> int:
    key = phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def license_index(counts: dict[str, int], phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """(word, offset, label, is_phrase, template words, [(offset, key phrase words)]), a row for each anchor: the rarest word of each
    key phrase (of a phrase: of all of it), unless some word of a key phrase stands in no document."""
    rows = []
    for text, label, keys, exact in [*((t, l, (t,), True) for t, l in phrases), *((t, l, k, False) for l, t, k in templates)]:
        words = text.split()
        at = [(_places(words, k), k.split()) for k in keys]
        if all(counts.get(w, 0) for _, key in at for w in key):
            chosen = {min(range(i, i + len(key)), key=lambda j: (counts[words[j]], words.count(words[j]), j)) for i, key in at}  # noqa: B023
            rows += [(words[i], i, label, exact, words, at) for i in sorted(chosen)]
    return rows


_INDEX = "anchor:string,offset:int,label:string,exact:boolean,template:array<string>,keys:array<struct<at:int,words:array<string>>>"


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row of docs (doc_id, text): n_words and matches, distinct (label, exact, start, score) sorted; start counts words from 0
    (0 too where a notice's first words are cut off by the document's begin), and differs between the key phrases of one notice by what
    is put in or left out between them.

    Null texts have no words and no matches. Equal rows give equal results, each its own; of words with equal counts the one that the
    template has fewer times, then the first, is the anchor; an empty table gives none; other columns, whatever their names, are
    ignored. Phrases and templates are fixed lists, so the index has a few dozen rows at any input size, and is broadcast.
    """
    docs = id_and_text(docs)
    rows = license_index(document_counts(docs, vocabulary(phrases, templates)), phrases, templates)
    listed = [{"anchor": w, "offset": o, "label": l, "exact": e, "template": t, "keys": [{"at": i, "words": k} for i, k in keys]} for w, o, l, e, t, keys in rows]
    index = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), f"array<struct<{_INDEX}>>"))))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    longest = max((len(r[4]) for r in rows), default=1) + SLACK
    # places of anchors, from 1, each with the words around it; place 0 is the document's own row
    anchors = F.filter(F.transform("words", lambda w, i: F.struct((i + 1).alias("at"), w.alias("anchor"))), lambda x: x["anchor"].isin(sorted({r[0] for r in rows})))
    nearby = F.transform(anchors, lambda x: F.struct(x["at"].alias("at"), x["anchor"].alias("anchor"), F.greatest(F.lit(1), x["at"] - longest).alias("low"), F.slice("words", F.greatest(F.lit(1), x["at"] - longest), 2 * longest).alias("words")))
    itself = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("anchor"), F.lit(1).alias("low"), F.array().cast("array<string>").alias("words"))
    sent = base.select("doc_id", "text_hash", "n", F.explode_outer(F.concat(F.array(itself), nearby)).alias("s")).select("doc_id", "text_hash", "n", "s.*")
    met = sent.join(index, "anchor", "left").where("at = 0 or label is not null").withColumn("slack", F.when(F.col("exact"), 0).otherwise(SLACK))
    start = F.col("at") - F.col("offset")
    first = start - F.col("slack")
    before = F.greatest(F.lit(0), 1 - first)  # words that lie before the document's begin
    inside = F.slice("words", F.greatest(F.lit(1), first) - F.col("low") + 1, F.greatest(F.lit(0), F.size("template") + 2 * F.col("slack") - before))
    # the words from `slack` before the template's start on; a place before the document's begin holds null, which equals no word
    met = met.withColumn("there", F.concat(F.array_repeat(F.lit(None).cast("string"), before), inside)).withColumn("start", F.greatest(F.lit(0), start - 1))
    stands = lambda k, d: F.coalesce(F.slice("there", k["at"] + d + 1, F.size(k["words"])) == k["words"], F.lit(False))
    right = F.forall("keys", lambda k: F.exists(F.sequence(F.lit(0), 2 * F.col("slack")), lambda d: stands(k, d)))
    alike = F.size(F.filter("template", lambda w, i: F.coalesce(F.array_contains(F.slice("there", i + 1, 2 * F.col("slack") + 1), w), F.lit(False))))
    met = met.withColumn("right", right).where("at = 0 or right").withColumn("score", alike / F.size("template"))
    match = F.struct("label", "exact", F.col("start").cast("bigint").alias("start"), F.col("score").alias("score"))
    kept = met.select("doc_id", "text_hash", "n", (F.col("at") == 0).cast("int").alias("own"), F.when(F.col("at") > 0, match).alias("match")).where("own = 1 or match is not null")
    per = kept.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n"), F.sum("own").alias("times"), F.array_sort(F.collect_set("match")).alias("matches"))
    return per.select("doc_id", F.col("n").cast("bigint").alias("n_words"), "matches", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).drop("time")
