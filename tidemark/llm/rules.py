"""Quality rules with adaptive thresholds, in DataFrame functions only.

Counts of each text become four metrics in whole steps (thousandths, or tenths of
a character). Per language and source, the metrics are summarised by quantile
sketches: counts per step, which merge by addition, have a fixed number of
entries and no rounding error. A group's cutoff for a metric lies SPREAD interquartile
ranges over its third quartile, or 1 / REACH of the way from its median to its far tail
(the 99 % quantile), whichever is more: so it follows both what is normal and how far
outliers lie for that language and source, by one rule for all metrics. A group's
quantiles are drawn towards its language's (from the merged sketch) as if the language
lent it PRIOR documents, so few documents of its own count little, and many count alone.
The cutoffs are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, written

#: name: least words for the rule
METRICS = {"symbols": 1, "repeats": 1, "lines": 1, "length": 20}
SPREAD, REACH, PRIOR = 5, 5, 200
#: Quantiles of a sketch, in per cent.
QUANTILES = {"q1": 25, "q2": 50, "q3": 75, "q9": 99}
#: Word lengths (in tenths) from the first number on are counted in steps of the second.
COARSE = {1_000: 100, 100_000: 10_000, 10_000_000: 1_000_000}
#: Cutoff rows that are broadcast, at most; more are joined by salted keys.
BROADCAST, SALTS = 50_000, 32
_WHITE = "[\\x20\\x09-\\x0D]+"


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text.

    Windows of five words that share a 64-bit hash are compared by their words.
    """
    d = pick(docs, doc_id=id_col, lang="lang", source="source", text=text_col)
    t = F.coalesce("text", F.lit(""))
    d = d.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split(t, _WHITE), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, "[^\\x20\\x09-\\x0D]+", ""))).cast("long").alias("word_chars"),
    )
    d = d.select(
        "doc_id", "lang", "source", "n_symbols", "word_chars",
        F.size("w").cast("long").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"), "w",
    )
    h = F.col("h")
    window = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))
    d = d.withColumn("v", window).drop("h")
    # only texts with a repeated window are looked at closer
    v, w = F.col("v"), F.col("w")
    repeats = F.size(F.array_distinct(v)) < F.size(v)
    d = d.withColumn("s", F.when(repeats, F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).withColumn("w", F.when(repeats, w)).drop("v")
    d = d.withColumn("s", _again("s")).withColumn("s", F.sort_array(F.transform("s", lambda e: F.struct(F.array_join(F.slice(w, e["i"] + 1, 5), " ").alias("x"), e["i"].alias("i"))))).drop("w")
    d = d.withColumn("p", F.sort_array(F.transform(_again("s"), lambda e: e["i"].cast("long")))).drop("s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("long").alias("at"))
    covered = F.aggregate("p", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(5).cast("long"), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def _again(entries: str) -> Column:
    """Of a list of (x, i) sorted by x, those whose x stands there twice or more."""
    s = F.col(entries)
    beside = lambda e, i: F.coalesce(e["x"] == F.get(s, i)["x"], F.lit(False))
    return F.filter(s, lambda e, i: beside(e, i - 1) | beside(e, i + 1))


def _steps() -> dict[str, Column]:
    share = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"),
        "lines": share("n_dup_lines", "n_lines"),
        "length": _coarse(F.floor(F.lit(10) * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)))),
    }


def _coarse(v: Column) -> Column:
    """Steps that grow with the value, so a sketch has few entries at any length."""
    out = v
    for least, step in COARSE.items():
        out = F.when(v >= least, v - v % step).otherwise(out)
    return out


def cutoffs(features: DataFrame) -> DataFrame:
    """lang, source (null-free keys kl, ks) and one cutoff per metric."""
    kl, ks = F.coalesce(F.col("lang"), F.lit("\x00")), F.coalesce(F.col("source"), F.lit("\x00"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("long").alias("step")) for k, c in _steps().items()]))
    fine = features.filter("n_words > 0").select(kl.alias("kl"), ks.alias("ks"), steps.alias("m"))
    fine = fine.groupBy("kl", "ks", "m.metric", "m.step").agg(F.count("*").alias("n"))
    by_lang = fine.groupBy("kl", "metric", "step").agg(F.sum("n").alias("n"))

    def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
        upto = Window.partitionBy(*keys, "metric").orderBy("step")
        whole = Window.partitionBy(*keys, "metric")
        c = sketch.withColumn("c", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
        at = lambda q: F.min(F.when(F.col("c") * 100 >= F.col("all") * q, F.col("step")))
        return c.groupBy(*keys, "metric").agg(*[at(q).alias(k) for k, q in QUANTILES.items()], F.max("all").alias("docs"))

    own, merged = quantiles(fine, "kl", "ks"), quantiles(by_lang, "kl").select("kl", "metric", *[F.col(k).alias(f"l_{k}") for k in QUANTILES])
    both = own.join(merged, ["kl", "metric"], "left")
    q1, q2, q3, q9 = (F.expr(f"(docs * {k} + {PRIOR} * l_{k}) DIV (docs + {PRIOR})") for k in QUANTILES)
    both = both.withColumns({"q1": q1, "q2": q2, "q3": q3, "q9": q9})
    both = both.withColumn("cut", F.greatest(F.expr(f"q3 + {SPREAD} * (q3 - q1)"), F.expr(f"q2 + (q9 - q2) DIV {REACH}")))
    return both.groupBy("kl", "ks").agg(*[F.max(F.when(F.col("metric") == k, F.col("cut"))).alias(f"cut_{k}") for k in METRICS])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept for every row.

    Null and empty texts have no words: base_failed, not kept. An empty table gives an empty result. Null languages or
    sources form a group of their own. Repeated rows are judged each. Columns
    other than doc_id, text, lang and source are not read.
    """
    features = written(base_features(docs))
    cut = written(cutoffs(features)).select(F.col("kl").alias("_kl"), F.col("ks").alias("_ks"), *[f"cut_{k}" for k in METRICS])
    f = features.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    same = (F.coalesce("lang", F.lit("\x00")) == F.col("_kl")) & (F.coalesce("source", F.lit("\x00")) == F.col("_ks"))
    if cut.count() <= BROADCAST:
        f = f.join(F.broadcast(cut), same, "left")
    else:
        f = f.withColumn("_salt", F.monotonically_increasing_id() % SALTS)
        f = f.join(cut.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_part")), "left")
    over = [F.coalesce((step > F.col(f"cut_{k}")) & (F.col("n_words") >= METRICS[k]), F.lit(False)) for k, step in _steps().items()]
    bad = over[0] | over[1] | over[2] | over[3]
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def _sql() -> str:
    quantiles = lambda c: ", ".join(f"quantile_disc(step, {q / 100}) AS {c}{k[1]}" for k, q in QUANTILES.items())
    drawn = ", ".join(f"(docs * q{k[1]} + {PRIOR} * l{k[1]}) // (docs + {PRIOR}) AS c{k[1]}" for k in QUANTILES)
    cut = ", ".join(f"max(CASE WHEN metric = '{k}' THEN cut END) AS cut_{k}" for k in METRICS)
    coarse = "CASE " + " ".join(f"WHEN tenths >= {k} THEN tenths - tenths % {v}" for k, v in reversed(COARSE.items())) + " ELSE tenths END"
    bad = " OR ".join(f"coalesce({k} > cut_{k} AND n_words >= {w}, false)" for k, w in METRICS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM dup) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
  1000 * n_dup_lines // greatest(n_lines, 1) AS lines, {coarse} AS length
  FROM (SELECT *, 10 * word_chars // greatest(n_words, 1) AS tenths FROM f)),
u AS (SELECT lang, source, metric, step FROM (SELECT lang, source, n_words, symbols, repeats, lines, length FROM m WHERE n_words > 0)
  UNPIVOT (step FOR metric IN (symbols, repeats, lines, length))),
q AS (SELECT lang, source, metric, count(*) AS docs, {quantiles('q')} FROM u GROUP BY ALL),
ql AS (SELECT lang, metric, {quantiles('l')} FROM u GROUP BY ALL),
c AS (SELECT q.lang, q.source, q.metric, {drawn} FROM q JOIN ql ON q.lang IS NOT DISTINCT FROM ql.lang AND q.metric = ql.metric),
cuts AS (SELECT lang, source, {cut} FROM (SELECT *, greatest(c3 + {SPREAD} * (c3 - c1), c2 + (c9 - c2) // {REACH}) AS cut FROM c) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept
FROM (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, cuts.* EXCLUDE (lang, source)
  FROM m LEFT JOIN cuts ON m.lang IS NOT DISTINCT FROM cuts.lang AND m.source IS NOT DISTINCT FROM cuts.source)
"""


SQL = _sql()
