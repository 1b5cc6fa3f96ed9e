"""License scans: base phrases, and an exact set-similarity join of text blocks with license notices.

A block is a line with the LINES - 1 lines after it, so that notices that are wrapped are whole in one; it is
the set of its words. It matches a template if it holds at least CONTAINMENT of the template's
words. The join is exact: words are ordered by the number of blocks of the whole corpus that hold them,
rarest first; a match must share a word within the prefixes of both sides (a set of n words that must
have k in common has one of them among its first n - k + 1), the block must have k of the templates' words
at all (length), and enough words must follow on both sides (position). Only blocks that pass all three
are compared word by word. Of templates that hold each other's words to that measure (two variants of a license), a
block matches only those of the highest score. Words that no template holds can't be in common, so blocks are cut to the
templates' vocabulary before anything is joined, and the frequencies that reach the driver are as many
as the templates have words.

DataFrame functions only. Words are runs of ASCII letters, digits and characters beyond ASCII. Nulls: a
null text is empty: 0 words, no labels, score 0. A row gets the labels of its own text, whatever rows share its id.
Labels are distinct and sorted; the score is the largest containment found, 1.0 with a base phrase.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.plans.storage import Scratch, join_small
from fewstep.sources.tables import table

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by which texts name their license.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl": "this library is free software you can redistribute it under the terms of the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "no part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher",
}
CONTAINMENT = 0.8
#: Lines in a block.
LINES = 3

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _count(text: F.Column, what: str) -> F.Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def _number_of_words(padded: F.Column) -> F.Column:
    """Of a text in which every word has a blank of its own before and after it."""
    return F.when(F.length(F.trim(padded)) == 0, F.lit(0)).otherwise(_count(padded, "  ") + 1).cast("long")


def base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word and base_labels (an array) of each row."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), _BETWEEN, "  ")), F.lit(" "))
    out = docs.select(*keep, padded.alias("_padded")).withColumn("n_words", _number_of_words(F.col("_padded")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        pattern = " " + "  ".join(words) + " "
        found = F.contains(F.col("_padded"), F.lit(pattern))
        counts.append(F.when(found, _count(F.col("_padded"), pattern)).otherwise(0))
        firsts.append(F.when(found, _number_of_words(F.substring_index("_padded", pattern, 1))))
        lasts.append(F.when(found, F.col("n_words") - len(words) - _number_of_words(F.substring_index("_padded", pattern, -1))))
        labels.append(F.when(found, F.lit(label)))
    out = out.withColumn("n_base", sum(counts[1:], counts[0]).cast("long")).withColumn("first_word", F.least(*firsts)).withColumn("last_word", F.greatest(*lasts))
    return out.withColumn("base_labels", F.array_compact(F.array(*labels))).drop("_padded")


def blocks_with(docs: DataFrame, vocabulary: list[str], least: int, keys: list[str]) -> DataFrame:
    """keys, line (of the block's first), hits: the words of the vocabulary in each block that has least of them."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    of_lines = F.transform(F.split(F.lower("text"), "\n"), lambda x: F.array_intersect(words, F.split(x, _BETWEEN)))
    lines = docs.where("text IS NOT NULL").select(*keys, of_lines.alias("_lines"))
    of_blocks = F.transform("_lines", lambda x, k: F.array_distinct(F.flatten(F.slice("_lines", k + 1, LINES))))
    return lines.select(*keys, F.posexplode(of_blocks).alias("line", "hits")).where(F.size("hits") >= least)


def rivals(templates: dict[str, str], containment: float) -> list[tuple[str, str]]:
    """The pairs of labels of which either's template holds enough of the other one's words, both ways round."""
    sets = {label: set(text.split()) for label, text in templates.items()}
    return [(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= containment * max(len(sets[a]), len(sets[b])) - 1e-9]


def contained(docs: DataFrame, templates: dict[str, str], containment: float, scratch: Scratch, keys: list[str]) -> DataFrame:
    """keys, line, label, score: every block that holds enough of a template's words."""
    spark = docs.sparkSession
    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    needs = {label: max(1, math.ceil(containment * len(words) - 1e-9)) for label, words in sets.items()}
    vocabulary = sorted(set().union(*sets.values()))
    hits = scratch.stash(blocks_with(docs, vocabulary, min(needs.values()), keys))
    often = hits.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # as many rows as the vocabulary has words
    often = {r["word"]: r["n"] for r in often}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for label, words in sets.items():
        ranked = sorted(words, key=rank.get)
        prefixes += [(w, label, at, len(ranked), needs[label], ranked) for at, w in enumerate(ranked[: len(ranked) - needs[label] + 1])]
    prefixes = spark.createDataFrame(prefixes, "word string, label string, at int, size int, need int, words array<string>")

    least = min(needs.values())
    lines = hits.select(*keys, "line", F.array_intersect(F.array(*[F.lit(w) for w in order]), "hits").alias("hits"))
    posted = lines.select(*keys, "line", "hits", F.posexplode(F.slice("hits", F.lit(1), F.size("hits") - (least - 1))).alias("place", "word"))
    met = join_small(posted, prefixes, "word")
    met = met.where((F.size("hits") >= F.col("need")) & (F.col("place") <= F.size("hits") - F.col("need")))
    met = met.where(F.least(F.col("size") - F.col("at"), F.size("hits") - F.col("place")) >= F.col("need"))
    met = met.withColumn("common", F.size(F.array_intersect("hits", "words"))).where("common >= need")
    met = met.select(*keys, "line", "label", (F.col("common") / F.col("size")).alias("score")).distinct()
    by_block = met.groupBy(*keys, "line").agg(F.collect_list(F.struct("label", "score")).alias("all"))  # as many as there are templates
    beaten = lambda x: F.exists("all", lambda y: (y["score"] > x["score"]) & F.concat_ws("\n", x["label"], y["label"]).isin(against))
    against = ["\n".join(pair) for pair in rivals(templates, containment)]
    return by_block.select(*keys, "line", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("m")).select(*keys, "line", "m.*")


def scan(docs: DataFrame, id_col: str = "doc_id", templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The columns of op7 for each row of docs (id_col, text)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    docs = docs.select(id_col, "text").withColumn("_mark", F.xxhash64("text"))
    found = contained(docs, templates, containment, scratch, [id_col, "_mark"])
    found = found.groupBy(F.col(id_col).alias("_id"), F.col("_mark").alias("_of")).agg(F.collect_set("label").alias("more"), F.max("score").alias("most"))
    out = base(docs, [id_col, "_mark"])
    out = out.join(found, out[id_col].eqNullSafe(found["_id"]) & (out["_mark"] == found["_of"]), "left")
    every = F.sort_array(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0)))
    return out.select(id_col, "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base_labels"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " UNION ALL ".join(
        f"SELECT nr, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + ")) AS place FROM split"
        for phrase, label in PHRASES.items()
    )
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))}, {math.ceil(CONTAINMENT * len(set(t.split())) - 1e-9)})" for label, t in TEMPLATES.items())
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS nr, doc_id, lower(coalesce(text, '')) AS low FROM documents),
split AS (SELECT nr, doc_id, low, regexp_extract_all(low, '{word}') AS w FROM numbered),
places AS ({places}),
based AS (SELECT nr, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY nr),
templates(label, words, need) AS (VALUES {rows}),
cut AS (SELECT nr, string_split(low, chr(10)) AS ls FROM split),
rivals(label, rival) AS (VALUES {", ".join(map(str, rivals(TEMPLATES, CONTAINMENT)))}),
blocks AS (SELECT nr, k, regexp_extract_all(array_to_string(list_slice(ls, k, k + {LINES - 1}), ' '), '{word}') AS w FROM (SELECT nr, ls, unnest(range(1, len(ls) + 1)) AS k FROM cut)),
met AS (SELECT nr, k, label, len(list_intersect(words, w)) / len(words) AS score FROM blocks, templates WHERE len(list_intersect(words, w)) >= need),
matched AS (SELECT nr, label, score FROM met m WHERE NOT EXISTS (SELECT 1 FROM met o JOIN rivals r ON r.rival = o.label WHERE o.nr = m.nr AND o.k = m.k AND r.label = m.label AND o.score > m.score)),
more AS (SELECT nr, list(DISTINCT label) AS labels, max(score) AS score FROM matched GROUP BY nr)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.score, 0)::DOUBLE END AS score
FROM split s LEFT JOIN based b USING (nr) LEFT JOIN more m USING (nr)
"""


OP7_SQL = _sql()
