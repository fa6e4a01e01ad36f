"""Hard negatives by slots of scores.

An anchor's positives are its best rows of the same label. The negatives of a positive
lie in a window of scores whose limits are fractions of the positive's score, so the
windows of one anchor overlap. Their upper limits, in descending order, split the scores
into disjoint slots, and both limits fall with the positive's score: the first k rows
under upper limit j are the first k of slots j, j+1, ... one after another, and the
window's lower limit only cuts their tail. So one pass over all rows keeps k rows per
slot, and each window is answered from its own slot and those below it.

Anchors and rows meet in blocks of bounded size, as in the exact search; each block
hands on its own best k rows of an anchor's slot, which are merged by anchor and slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import topk
from tidemark.llm.common import pick, written

#: Below every score (they are clipped to +-(2^63 - 1)).
LEAST = -(1 << 63)


def prepared(vectors: DataFrame, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label and q, the integers floor(scale * x), of the rows that take part:
    those without an id, label or vector, or with a null or non-finite component, don't.
    `label` may be any expression over vec_id and label."""
    rows = pick(vectors, vec_id=id_col, label=label_col, v=vector_col)
    rows = rows.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), F.transform("v", lambda x: x.cast("double") * scale).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # from 2^53 on every double is an integer, and floor() would leave the long range
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return rows.filter(F.coalesce(fine, F.lit(False))).select("vec_id", "label", F.transform("v", whole).alias("q"))


def limit(score: Column, percent: int, up: bool) -> Column:
    """floor, or ceiling if `up`, of percent / 100 * score, exact in the range of long."""
    rest = F.pmod(score, F.lit(100).cast("long"))
    hundreds = ((score.cast("decimal(20,0)") - rest.cast("decimal(20,0)")) / F.lit(100).cast("decimal(20,0)")).cast("long")
    return hundreds * percent + (F.ceil(rest * percent / 100.0) if up else F.floor(rest * percent / 100.0)).cast("long")


def first_k(s: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row among those that fit, ties to the first
    columns; in each row in no order."""
    m = np.where(fits, s, LEAST)
    kth = np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k, None] if m.shape[1] > k else np.full((len(m), 1), LEAST)
    tie = fits & (m == kth)
    return np.nonzero(fits & ((m > kth) | (tie & (np.cumsum(tie, axis=1) <= k - (m > kth).sum(axis=1, keepdims=True)))))


def _best(k: int):
    """Per block: each anchor's k best rows of its own label."""
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(c: pa.Table, q: pa.Table) -> pa.Table:
        out = [shape.empty_table()]
        if c.num_rows and q.num_rows:
            c = c.sort_by("vec_id")
            ids, own, kind, label = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy(), c.column("label").to_numpy(), q.column("label").to_numpy()
            for at, s, other in topk._scores(c, q):
                r, j = first_k(s, other & (label[at, None] == kind[None, :]), k)
                out.append(pa.table([own[at[r]], ids[j], s[r, j]], schema=shape))
        return pa.concat_tables(out)

    return work


def _slotted(k: int):
    """Per block: the k best rows of another label in each slot of each anchor. Slot j
    (from 0) ends at uppers[j] and begins over uppers[j + 1]; nothing under `least` counts."""
    shape = pa.schema([("query_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(c: pa.Table, q: pa.Table) -> pa.Table:
        out = [shape.empty_table()]
        if c.num_rows and q.num_rows:
            c = c.sort_by("vec_id")
            ids, own, kind, label = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy(), c.column("label").to_numpy(), q.column("label").to_numpy()
            uppers, least = q.column("uppers").to_pylist(), q.column("least").to_numpy()
            most = max(map(len, uppers))
            # a missing slot, like one between equal limits, holds no score
            ends = np.array([[*u, *[LEAST] * (most + 1 - len(u))] for u in uppers], np.int64)
            for at, s, other in topk._scores(c, q):
                fits = other & (label[at, None] != kind[None, :]) & (s >= least[at, None])
                for j in range(most):
                    inside = fits & (s <= ends[at, j, None]) & (s > ends[at, j + 1, None])
                    some = np.flatnonzero(inside.any(axis=1))
                    r, x = first_k(s[some], inside[some], k)
                    r = some[r]
                    out.append(pa.table([own[at[r]], np.full(len(r), j, np.int32), ids[x], s[r, x]], schema=shape))
        return pa.concat_tables(out)

    return work


def mined(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Both sides have (vec_id long, label long, q array<double> of integers), as prepared()
    gives them. An anchor's positives are its first rows of its own label, by score, then by
    smaller vec_id; a positive's negatives are the first rows of another label whose score
    lies between low and high percent of the positive's (both included; of a negative score
    none does). Rows with the anchor's own id are left out; vectors meet those of their own length; an anchor
    id that occurs twice counts once (its smallest label and vector); repeated rows count
    each. Fewer rows than asked for: all. Scores outside long count as the nearest limit.
    An empty side gives an empty result.
    """
    spark = rows.sparkSession
    anchors = anchors.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "q")).alias("x")).select("query_id", "x.label", "x.q")
    n, nq = rows.count(), topk.blocks(anchors.count(), topk.QUERY_BLOCK)
    nc = max(topk.blocks(n, topk.CANDIDATE_BLOCK), min(topk.blocks(n, topk.LEAST_BLOCK), 2 * spark.sparkContext.defaultParallelism // nq))
    cand = written(rows.select("vec_id", "label", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id", "q", F.rand(7)), F.lit(nc)).alias("cb")))
    query = written(anchors.withColumns({"dim": F.size("q"), "qb": F.pmod(F.xxhash64("query_id"), F.lit(nq))}))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ("dim", "qb", "cb")

    def meet(held: DataFrame, work, shape: str) -> DataFrame:
        spread = cand.withColumn("qb", each(nq))
        return spread.groupBy(*keys).cogroup(held.withColumn("cb", each(nc)).groupBy(*keys)).applyInArrow(work, shape)

    by_score = [F.desc("score"), F.asc("vec_id")]
    best = meet(query, _best(positives), "query_id long, vec_id long, score long")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))).filter(F.col("rank") <= positives)
    # positives of a negative score have no window
    best = best.filter("score >= 0").withColumns({"upper": limit(F.col("score"), high, False), "lower": limit(F.col("score"), low, True)})
    best = written(best)
    slots = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "upper"))).alias("u"), F.min("lower").alias("least"))
    held = query.join(slots.select("query_id", F.col("u.upper").alias("uppers"), "least"), "query_id")
    found = meet(held, _slotted(negatives), "query_id long, slot int, vec_id long, score long")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(*by_score))).filter(F.col("n") <= negatives)
    # at most positives x negatives entries an anchor, best first: slot by slot in descending order of scores
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id", "slot", "score")
    merged = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    both = best.join(merged, "query_id")
    suffix = F.filter("entries", lambda e: (e["slot"] >= F.col("rank") - 1) & (e["score"] >= F.col("lower")))
    out = both.select("query_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score"), F.posexplode(F.slice(suffix, 1, negatives)).alias("pos", "e"))
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", "positive_rank", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.k, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS positive_rank, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
