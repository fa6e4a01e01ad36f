"""How filters interact: what each removes at each step of each order.

A document's failures are a mask of bits. Documents with one part and mask are a cell
with three weights: documents, good ones, toxic ones. Each cell folds along every order
of the filters (higher-order functions over one literal array of orders): a step's
struct holds the weights if the cell is kept, removed or removed again there. A part's
cells, 2^filters at most, are then summed element by element.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, written

LETTERS = "ABCDE"
#: What a step counts.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The conditions on a text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(fails: dict[str, Column], letters: str) -> Column:
    mask = F.lit(0)
    for i, k in enumerate(letters):
        if k in fails:
            mask = mask + F.when(fails[k], 1 << i).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of docs.

    A null text is an empty one, a null source the empty part. E fails for a row whose
    text stands under a smaller doc_id too (texts are compared by their SHA-256); a null
    id is smaller than none and has no smaller one; rows that repeat an id don't fail by
    one another. A label counts if any row of labels with the document's id has it.
    Other columns are not read; an empty table gives no row.
    """
    d = pick(docs, doc_id="doc_id", text="text", part="source").select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(d.select("doc_id", "part", _bits(failures(F.col("text")), LETTERS).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    # the first document of each text; joined by id and text, so no text's copies meet in one task
    first = rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    kinds = pick(labels, doc_id="doc_id", q="quality", t="toxic").filter(F.col("doc_id").isNotNull())
    kinds = kinds.groupBy("doc_id").agg(F.max(F.coalesce(F.col("q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("t") == 1, F.lit(False))).alias("toxic"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    full = rows.join(first, ["digest", "doc_id"], "left").join(kinds, "doc_id", "left")
    return full.select("part", (F.col("own") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def interactions(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley from (part, mask, good, toxic).

    Bit i of mask says that the row fails letters[i]. One row per part, order of the
    letters and step, zeros included; no part, no row. With m letters a part has m!
    orders of m steps, held in one array: keep m at 6 or less.
    """
    if not 0 < len(letters) <= 6:
        raise ValueError("one to six filters")
    m, orders = len(letters), list(itertools.permutations(range(len(letters))))
    bits = _constant([[1 << i for i in o] for o in orders], "array<array<int>>")
    names = _constant(["".join(letters[i] for i in o) for o in orders], "array<string>")
    at = _constant([i for o in orders for i in o], "array<int>")
    count = lambda c: F.count_if(F.col(c))
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good").alias("good_n"), count("toxic").alias("toxic_n"))
    none = F.lit(0).cast("long")

    def weighed(left: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        taken = left & fails
        values = (
            F.when(left & ~fails, F.col("n")), F.when(taken, F.col("n")), F.when(~left & fails, F.col("n")),
            F.when(F.col("mask") == bit, F.col("n")), F.when(taken, F.col("good_n")), F.when(taken, F.col("toxic_n")),
        )
        return F.struct(*[v.otherwise(none).alias(k) for v, k in zip(values, COUNTS, strict=True)])

    kind = "array<struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ">>"

    def step(state: Column, bit: Column) -> Column:
        left = state["left"]
        return F.struct((left & (F.col("mask").bitwiseAND(bit) == 0)).alias("left"), F.concat(state["steps"], F.array(weighed(left, bit))).alias("steps"))

    start = F.struct(F.lit(True).alias("left"), F.array().cast(kind).alias("steps"))
    folded = cells.select("part", F.flatten(F.transform(bits, lambda o: F.aggregate(o, start, step, lambda s: s["steps"]))).alias("steps"))
    plus = lambda a, b: F.struct(*[(a[k] + b[k]).alias(k) for k in COUNTS])
    zero = F.transform(F.sequence(F.lit(1), F.lit(len(orders) * m)), lambda _: F.struct(*[none.alias(k) for k in COUNTS]))
    total = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.aggregate("cells", zero, lambda a, b: F.zip_with(a, b, plus)).alias("total"))
    shares = F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)),
        lambda i: F.aggregate(F.zip_with("total", at, lambda t, k: F.when(k == i, t["removed"]).otherwise(none)), none, lambda a, x: a + x),
    )
    each = total.withColumn("shares", shares).select("part", "shares", F.posexplode("total").alias("pos", "x"))
    return each.select(
        "part", F.get(names, F.floor(F.col("pos") / m).cast("int")).alias("filter_order"), (F.col("pos") % m + 1).cast("int").alias("step"),
        *[F.col(f"x.{k}").alias(k) for k in COUNTS], F.get("shares", F.get(at, F.col("pos"))).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over whole texts; see masks() for odd rows."""
    return interactions(masks(docs, labels))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e, coalesce(q, 0) AS q, coalesce(x, 0) AS x FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(q) AS q, sum(x) AS x FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
orders AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
s AS (SELECT part, filter_order, step, filter_order[step] AS own, n, q, x, fails, contains(fails, filter_order[step]) AS hit,
    fails <> '' AND len(list_filter(string_split(fails, ''), lambda z: position(z IN filter_order) < step)) > 0 AS gone
  FROM cells, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND hit THEN q ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND hit THEN x ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
