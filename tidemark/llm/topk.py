"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. A pass counts the
scores of each query in equal bins of its current range; the counts of all
blocks add up, and the bin that holds the k-th score becomes the next range. As
scores are integers, the range shrinks to one value in a few passes: the exact
k-th score. A last pass keeps what lies above it and, of the ties on it, those
with the smallest ids.

Queries and candidates meet in blocks of bounded size (a cogroup by query block
and candidate block, as Arrow tables), so nothing grows in a task or in the
driver. A score is computed in the cheapest arithmetic that is exact for its
block: floating point below 2^53, 64-bit integers, else integers of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, written

#: Rows of a query block and of a candidate block, at most.
QUERY_BLOCK, CANDIDATE_BLOCK = 32_768, 32_768
#: Rows of a candidate block, at least, where there are tasks to spare.
LEAST_BLOCK = 1024
#: Bins of a histogram pass.
BINS = 512
#: Scores computed at once in a task (queries x candidates).
TILE = 1 << 20
#: The scores' limits: one outside counts as the nearest.
TOP = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and q, the integers floor(scale * x) as doubles, exact at any size.

    Rows with a null id, a null or empty vector or a null or non-finite component
    (scaled ones too) take no part. Repeated rows stay; other columns are not read.
    """
    v = pick(vectors, vec_id=id_col, v=vector_col).select("vec_id", F.transform("v", lambda x: x.cast("double") * scale).alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # from 2^53 on every double is an integer, and floor() would leave the long range
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return v.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", whole).alias("q"))


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _reach(norm: Column, top: Column) -> Column:
    """Bound of the scores' size, by Cauchy and Schwarz (a little more, for rounding)."""
    bound = norm * top * (1 + 1e-9) + 1
    return F.when(bound < 9.0e18, bound.cast("decimal(38,0)").cast("long") + 1).otherwise(F.lit(TOP))


def _norm(q: str) -> Column:
    """Length of a vector, without overflow on the way."""
    most = F.array_max(F.transform(q, F.abs))
    return F.when(most == 0, 0.0).otherwise(most * F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates.

    Both sides have (vec_id long, q array<double> of integers). A candidate with the
    query's own id is left out; vectors meet only those of their own length; a query
    id that occurs twice counts once (its row with the smallest vector); repeated
    candidates count each. Ties go to the smaller vec_id. Fewer than k candidates:
    all of them. An empty side gives an empty result. A score outside the range of
    long counts as the nearest long.
    """
    spark = candidates.sparkSession
    queries = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("q"))
    n = candidates.count()
    nq = blocks(queries.count(), QUERY_BLOCK)
    nc = max(blocks(n, CANDIDATE_BLOCK), min(blocks(n, LEAST_BLOCK), 2 * spark.sparkContext.defaultParallelism // nq))
    cand = candidates.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id", "q", F.rand(7)), F.lit(nc)).alias("cb"))
    cand = written(cand.withColumn("norm", _norm("q")))
    top = cand.groupBy("dim").agg(F.max("norm").alias("top"))
    query = queries.withColumn("dim", F.size("q")).join(top, "dim", "left").withColumn("norm", _norm("q"))
    reach = _reach(F.col("norm"), F.coalesce("top", F.lit(0.0)))
    query = written(query.select("query_id", "q", "dim", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb"), (-reach).alias("lo"), reach.alias("hi"), F.lit(k).cast("long").alias("need")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = cand.select("vec_id", "q", "dim", "cb").withColumn("qb", each(nq))
    at = query.select("query_id", "lo", "hi", "need")
    wide = "(CAST(hi AS DECIMAL(20, 0)) - lo)"
    while not at.filter("hi > lo").isEmpty():
        counts = _meet(spread, query, at, nc, _histogram(k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        found = counts.join(at, "query_id").withColumn("over", F.sum("n").over(from_top) - F.col("n")).filter((F.col("over") < F.col("need")) & (F.col("over") + F.col("n") >= F.col("need")))
        found = found.withColumn("width", F.expr(f"CAST({wide} DIV {BINS} AS DECIMAL(20, 0)) + 1"))
        found = found.select(
            "query_id",
            F.expr("CAST(lo + bin * width AS LONG)").alias("lo2"),
            F.expr("CAST(least(hi, lo + (bin + 1) * width - 1) AS LONG)").alias("hi2"),
            (F.col("need") - F.col("over")).alias("need2"),
        )
        # a query with fewer candidates than k keeps all: its range ends at its lowest score
        at = written(at.join(found, "query_id", "left").select("query_id", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "lo").alias("hi"), F.coalesce("need2", "need").alias("need")))
    best = _meet(spread, query, at, nc, _kept(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(spread: DataFrame, query: DataFrame, at: DataFrame, nc: int, work, shape: str) -> DataFrame:
    held = query.drop("lo", "hi", "need").join(at, "query_id").withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))))
    keys = ("dim", "qb", "cb")
    return spread.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(work, shape)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in table.column("q").chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products (rows of b x rows of a) of integers held as doubles, as int64."""
    most = lambda x: np.abs(x).max(initial=0.0)
    bound = most(a) * most(b) * a.shape[1]
    if bound < 2.0**52:
        return (b @ a.T).astype(np.int64)
    if bound < 2.0**62:
        return b.astype(np.int64) @ a.astype(np.int64).T
    whole = lambda x: np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return np.clip(whole(b) @ whole(a).T, -TOP, TOP).astype(np.int64)


def by_size(x: np.ndarray) -> list[np.ndarray]:
    """Rows whose components are of like size, so that few large vectors leave the rest in fast arithmetic."""
    most = np.abs(x).max(axis=1, initial=0.0)
    kind = np.digitize(most, [2.0**22, 2.0**28])
    return [at for at in (np.flatnonzero(kind == k) for k in range(3)) if len(at)]


def _scores(c: pa.Table, q: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of q, scores against all of c, and whether a pair is one of different ids; tile by tile."""
    a, b = _matrix(c), _matrix(q)
    ids, own = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
    groups, step = by_size(a), max(1, TILE // len(a))
    for rows in by_size(b):
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            s = np.empty((len(at), len(a)), np.int64)
            for g in groups:
                s[:, g] = exact_scores(a[g], b[at])
            yield at, s, own[at, None] != ids[None, :]


def _histogram(k: int):
    shape = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])

    def work(c: pa.Table, q: pa.Table) -> pa.Table:
        out = [shape.empty_table()]
        if c.num_rows and q.num_rows:
            ids, low, high = (q.column(x).to_numpy() for x in ("query_id", "lo", "hi"))
            # ranges may be as wide as all of 64 bits: offsets and widths are unsigned
            widths = np.array([(h - x) // BINS + 1 for x, h in zip(low.tolist(), high.tolist(), strict=True)], np.uint64)
            for at, s, other in _scores(c, q):
                lo, hi = low[at, None], high[at, None]
                off = s.astype(np.uint64) - lo.astype(np.uint64)
                bins = np.where(other & (s >= lo) & (s <= hi), (off // widths[at, None]).astype(np.int64), BINS)
                m = len(bins)
                h = np.bincount((bins + np.arange(m)[:, None] * (BINS + 1)).ravel(), minlength=m * (BINS + 1)).reshape(m, -1)[:, :BINS]
                # a block's bins below its own k-th score can't hold the global one
                above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h
                r, b = np.nonzero((h > 0) & (above < k))
                out.append(pa.table([ids[at[r]], b, h[r, b]], schema=shape))
        return pa.concat_tables(out)

    return work


def _kept(k: int):
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(c: pa.Table, q: pa.Table) -> pa.Table:
        out = [shape.empty_table()]
        if c.num_rows and q.num_rows:
            c = c.sort_by("vec_id")
            ids, own, low = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy(), q.column("lo").to_numpy()
            for at, s, other in _scores(c, q):
                kth = low[at, None]
                tie = other & (s == kth)
                r, j = np.nonzero((other & (s > kth)) | (tie & (np.cumsum(tie, axis=1) <= k)))
                out.append(pa.table([own[at[r]], ids[j], s[r, j]], schema=shape))
        return pa.concat_tables(out)

    return work


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """top_k of the rows whose vec_id is divisible by `every`, against all rows.

    Rows that quantised() leaves out (nulls, non-finite components) are neither
    query nor candidate. Ties go to the smaller vec_id; a repeated candidate row
    counts each time, a repeated query id once. Columns other than vec_id and
    embedding are not read. An empty table gives an empty result.
    """
    v = quantised(vectors)
    return top_k(v, v.filter(F.col("vec_id") % every == 0), k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
