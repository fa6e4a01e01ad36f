"""License scans: an exact set-similarity join of text blocks with license
templates, in DataFrame functions only.

A block is a window of consecutive words, whatever line breaks or comment signs
stand between them. A template matches a block of 100 / THRESHOLD times its own
length that holds at least THRESHOLD per cent of its distinct words. The join is a
prefix-filter join: words are ordered by their frequency in the whole corpus, and
a block that meets the threshold must hold one of the template's rarest
|T| - need + 1 words (prefix). Blocks are formed only around these words. They then
have to pass the length filter (the words around hold at least `need` of the
template's) and the positional filter (the prefix word counts as the block's rarest,
so only what follows it in the order adds), before each block's overlap is counted.
The texts are read once; a text without enough words of any template is dropped at
once, and words outside all templates only count as places.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, written

# Opening sentences of common licenses and notices, with labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
THRESHOLD = 80
#: Phrases of the base labels.
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {t: list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(UPPER, UPPER.lower()))))) for t in templates}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score (the best containment of a matching template; 1 with a base phrase; else 0).

    A-Z alone are lower-cased. Null texts are empty: no words, no labels (empty strings), null positions.
    Each row gets its own result, repeated and null ids too; columns other than
    doc_id and text are not read. The templates are a parameter of the caller
    (a fixed list), so their index is small whatever the corpus holds.
    """
    templates = TEMPLATES if templates is None else templates
    words = template_words(templates)
    vocabulary = sorted({w for ws in words.values() for w in ws})
    need = {t: -(-threshold * len(ws) // 100) for t, ws in words.items()}
    span = {t: -(-100 * len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) // threshold) for t in words}
    d = pick(docs, doc_id="doc_id", text="text").withColumn("low", F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())).drop("text")
    d = d.withColumn("all", F.array_remove(F.split("low", _BREAK), ""))
    listed = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")
    known = listed(vocabulary)
    d = d.withColumn("held", F.array_intersect("all", known))
    enough = F.lit(False)
    for t, ws in words.items():
        enough = enough | (F.size(F.array_intersect("held", listed(ws))) >= need[t])
    # places of the templates' words, by their number in the vocabulary
    numbered = F.transform("all", lambda x, i: F.struct(i.alias("i"), (F.array_position(known, x) - 1).cast("int").alias("k")))
    d = d.select(
        "doc_id",
        F.size("all").cast("long").alias("n_words"),
        F.when(F.col("low").contains("license"), F.col("all")).alias("w"),
        F.when(enough, F.filter(numbered, lambda e: e["k"] >= 0)).alias("held"),
    )
    w = F.col("w")
    d = d.withColumn("spots", F.filter(F.transform(w, lambda x, i: F.when(x == "license", i)), lambda x: x.isNotNull()))

    def places(phrase):
        back = len(phrase) - 1
        there = lambda i: F.reduce(F.array(*[F.coalesce(F.get(w, i - back + k) == p, F.lit(False)) for k, p in enumerate(phrase[:-1])]), F.lit(True), lambda a, x: a & x)
        return F.transform(F.filter("spots", there), lambda i: (i - back).cast("long"))

    d = d.select("doc_id", "n_words", "held", *[places(p).alias(f"at_{k}") for k, p in PHRASES.items()])
    starts = F.concat(*[F.coalesce(f"at_{k}", F.array().cast("array<bigint>")) for k in PHRASES])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(k)) for k in PHRASES]))
    d = d.select("doc_id", "n_words", "held", starts.alias("starts"), F.array_sort(base).alias("base"))
    d = written(d.withColumn("row", F.monotonically_increasing_id()))

    # global word frequencies, over all documents that can match
    seen = d.select(F.explode(F.array_distinct(F.col("held.k"))).alias("k")).groupBy("k").count()
    frequency = {r["k"]: r["count"] for r in seen.collect()}  # at most the templates' words
    number = {x: k for k, x in enumerate(vocabulary)}
    index = []
    for t, ws in words.items():
        ranked = sorted((number[x] for x in ws), key=lambda k: (frequency.get(k, 0), k))
        index += [(ranked[i], len(ranked), need[t], span[t], templates[t], ranked[i:]) for i in range(len(ranked) - need[t] + 1)]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(index, "k int, size int, need int, span int, label string, words array<int>")
    # the words around each prefix word, as far as a block reaches
    anchors = F.array(*[F.lit(k) for k in sorted({r[0] for r in index})]).cast("array<int>")
    far = max(span.values(), default=1)
    around = lambda e, at: F.when(F.array_contains(anchors, e["k"]), F.struct(e["i"].alias("i"), e["k"].alias("k"), F.slice("held", F.greatest(at - far + 2, F.lit(1)), 2 * far - 1).alias("near")))
    spots = d.select("row", F.explode(F.array_compact(F.transform("held", around))).alias("e")).select("row", "e.i", "e.k", "e.near")
    pairs = spots.join(F.broadcast(prefixes), "k")
    pairs = pairs.withColumn("near", F.filter("near", lambda e: (e["i"] > F.col("i") - F.col("span")) & (e["i"] < F.col("i") + F.col("span")) & F.array_contains("words", e["k"])))
    # length and positional filter, then every block that holds the prefix word
    pairs = pairs.filter(F.size(F.array_distinct(F.col("near.k"))) >= F.col("need"))
    block = lambda s: F.filter("near", lambda e: (e["i"] >= s["i"]) & (e["i"] < s["i"] + F.col("span")))
    overlap = F.transform(F.filter("near", lambda s: s["i"] <= F.col("i")), lambda s: F.size(F.array_distinct(F.transform(block(s), lambda e: e["k"]))))
    pairs = pairs.withColumn("common", F.array_max(overlap)).filter("common >= need")
    found = pairs.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    out = d.drop("held").join(found, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    words = template_words(TEMPLATES)
    rows = ", ".join(f"('{label}', {words[t]!r}, {-(-100 * len(t.split()) // THRESHOLD)})" for t, label in TEMPLATES.items())
    starts = " || ".join(
        f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i+{len(p) - 1}] = {list(p)!r}), lambda i: {{'at': i - 1, 'label': '{k}'}})" for k, p in PHRASES.items()
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
b AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, {starts} AS s FROM b),
tpl(label, ws, span) AS (VALUES {rows}),
cand AS (SELECT r, label, ws, span, w FROM b, tpl WHERE 100 * len(list_intersect(list_distinct(w), ws)) >= {THRESHOLD} * len(ws)),
block AS (SELECT r, label, len(ws) AS m, len(list_intersect(list_distinct(w[i:i+span-1]), ws)) AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM cand)),
hit AS (SELECT r, label, CAST(c AS DOUBLE) / m AS c FROM block WHERE 100 * c >= {THRESHOLD} * m),
h AS (SELECT r, list(DISTINCT label) AS ls, max(c) AS best FROM hit GROUP BY r)
SELECT doc_id, n_words, CAST(len(s) AS BIGINT) AS n_base, list_min(list_transform(s, lambda x: x.at)) AS first_word,
  list_max(list_transform(s, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x.label) || coalesce(ls, []))), ',') AS labels,
  CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score
FROM p LEFT JOIN h USING (r)
"""


SQL = _sql()
