"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct five-word shingles. Each set gets SetSketch
registers: for every hash function the exponentially distributed minimum over
the set, kept as its truncated logarithm to a base near 1. Registers merge by
maximum and are locality-sensitive. Bands of register values find candidates, a
maximum-likelihood estimate from the joint counts of larger, smaller and equal
registers (with the known set sizes) drops hopeless ones far below the limit,
and the full sets confirm the rest exactly. A set's items are 128-bit hashes of
the shingles' words, and equal sets are told by a digest of all of them.

Only components are asked for, so a bucket's pairs are never listed. Equal sets
collapse first (one class, one representative). For the sets that share a bucket,
the items that stand in no other of them are counted: two sets have at most the
smaller of their other items in common, an exact bound. In a few rounds every
bucket member within it is compared with one centre, first the member with the
fewest items of its own, then one of the bucket's largest component; links join
components. What the bound leaves possible between a bucket's components after
that is compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, pick, span_hashes, steps, text_buffers, word_spans, written

WORDS = 5
#: Bands x rows = registers. A pair at 0.85 shares no band with probability 4e-7.
BANDS, ROWS = 20, 4
#: SetSketch base and rate (the registers' scale).
BASE, RATE = 1.001, 20.0
#: Per cent of the union that links two sets.
LIMIT = 85
#: Rounds in which every bucket has one centre to compare with.
STARS = 3
#: Members of a bucket that one task meets at once; a larger bucket is dealt to several.
PART, FIRST_SALTS = 500, 64
#: Estimates this far below the limit (over six standard errors) need no full comparison.
SLACK = 0.27

_STEP = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SEED = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit hashes of the distinct shingles of all texts, 2 x items, each text's
    sorted; their offsets). A text of fewer than five words has its whole sequence
    as one shingle; none without words."""
    starts, ends, first = word_spans(data, offsets)
    h = span_hashes(data, starts, ends, fold=True, families=2)
    n = np.diff(first)
    full = np.zeros((2, max(h.shape[1] - WORDS + 1, 0)), np.uint64)
    for k in range(WORDS):
        full += h[:, k : h.shape[1] - WORDS + 1 + k] * _STEP[k] if full.size else np.uint64(0)
    full = mix(full)
    parts, sizes = [], np.zeros(len(n), np.int64)
    for d in np.flatnonzero(n):
        if n[d] >= WORDS:
            s = full[:, first[d] : first[d + 1] - WORDS + 1]
            s = s[:, np.argsort(s[0])]
            like = s[0, 1:] == s[0, :-1]
            if (s[1, 1:] != s[1, :-1])[like].any():  # half of the hash may stand for several shingles
                s = s[:, np.lexsort((s[1], s[0]))]
                like = s[0, 1:] == s[0, :-1]
            s = s[:, np.concatenate([[True], ~like | (s[1, 1:] != s[1, :-1])])]
        else:
            w = h[:, first[d] : first[d + 1]]
            s = mix((w * _STEP[: w.shape[1]]).sum(1, keepdims=True) + np.uint64(w.shape[1]))
        parts.append(s)
        sizes[d] = s.shape[1]
    return (np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (texts x BANDS*ROWS, uint16) of non-empty sets."""
    out = np.empty((len(bounds) - 1, len(_SEED)), np.uint16)
    for k, seed in enumerate(_SEED):
        low = np.minimum.reduceat(sets * seed, bounds[:-1])
        e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, k] = np.clip(np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(BASE)), 0, 65535)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of sets of known sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    for j in np.linspace(0, 1, 101):
        top, under = p(u - v * j), p(v - u * j)
        ok = (u >= v * j - 1e-12) & (v >= u * j - 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(more > 0, more * np.log(top), 0) + np.where(less > 0, less * np.log(under), 0) + np.where(same > 0, same * np.log(1 - top - under), 0)
        ll = np.where(ok & ~np.isnan(ll), ll, -np.inf)
        at, best = np.where(ll > best, j, at), np.maximum(ll, best)
    return at


def packed(items: np.ndarray) -> bytes:
    """A set of 128-bit hashes: all first halves, then all second ones."""
    return items.tobytes()


def unpacked(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(2, -1)


def prints(items: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set."""
    d = hashlib.blake2b(packed(items), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets of 128-bit hashes."""
    if (x[0, 1:] == x[0, :-1]).any() or (y[0, 1:] == y[0, :-1]).any():
        return len(set(zip(*x.tolist(), strict=True)) & set(zip(*y.tolist(), strict=True)))
    at = np.minimum(np.searchsorted(y[0], x[0]), y.shape[1] - 1)
    return int(((y[0, at] == x[0]) & (y[1, at] == x[1])).sum())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128-bit digest of the set), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in steps(offsets):
                part = data[offsets[a] : offsets[b]]
                sets, bounds = shingles(part, offsets[a : b + 1] - offsets[a])
                n = np.diff(bounds)
                has = np.flatnonzero(n)
                f, regs = np.zeros((b - a, 2), np.int64), [b""] * (b - a)
                if len(has):
                    tight = np.concatenate([bounds[:-1][has], bounds[-1:]])
                    for d, r in zip(has, registers(sets[0], tight), strict=True):
                        f[d], regs[d] = prints(sets[:, bounds[d] : bounds[d + 1]]), r.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "regs"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, regs binary")


def bands(classes: DataFrame) -> DataFrame:
    """cid and its band keys, one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.reshape(-1).view(np.int64))], names=["cid", "band"])

    return classes.select("cid", "regs").mapInArrow(run, "cid long, band long")


def full_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(cid, items): the whole sets of the classes asked for, from their
    representatives' texts (one shuffle of the texts)."""
    asked = classes.join(asked, "cid").select("cid", "rep", "f1", "f2")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            f1, f2 = (batch.column(i).to_numpy() for i in (2, 3))
            for a, b in steps(offsets):
                sets, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                # an id may stand on several rows: take the one with the class's set
                raw = [packed(x) if prints(x) == (f1[a + i], f2[a + i]) else None for i, x in enumerate(np.split(sets, bounds[1:-1], axis=1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(raw, pa.binary())], names=["cid", "items"])

    found = pick(docs, rep="doc_id", text="text").join(asked, "rep").select("cid", "text", "f1", "f2").mapInArrow(full, "cid long, items binary")
    return found.filter("items IS NOT NULL").dropDuplicates(["cid"])


def common_sizes(sets: DataFrame) -> DataFrame:
    """(cid, shared): how many of a set's items stand in another of these sets too.
    No pair of them can have more in common than the smaller of its two numbers."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = unpacked(x.as_buffer())[0].view(np.int64)  # a half: alike by chance only widens the bound
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), cid))], names=["item", "cid"])

    lone = sets.mapInArrow(items, "item long, cid long").groupBy("item").agg(F.min("cid").alias("cid"), F.count("*").alias("n")).filter("n = 1")
    lone = lone.groupBy("cid").agg(F.count("*").alias("alone"))
    return sets.select("cid", F.expr("octet_length(items) DIV 16").alias("size")).join(lone, "cid", "left").select("cid", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def compared(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the distinct pairs (a, b) the hopeful ones: how many items their full sets share, and whether they are linked."""
    size = classes.select("cid", "n_shingles", "regs")
    side = lambda x: size.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {LIMIT} * greatest(na, nb)")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
                j = estimate(a, b, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(j >= LIMIT / 100 - SLACK))

    near = written(near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(hopeful, "a long, b long"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, ok = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = in_common(x, y)
                share.append(both)
                ok.append(100 * both >= LIMIT * (x.shape[1] + y.shape[1] - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "both", "linked"])

    side = lambda x: sets.select(F.col("cid").alias(x), F.col("items").alias(f"s{x}"))
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(same, "a long, b long, both long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest id reachable, for every id in a link.

    Every round takes the smallest label among neighbours and then that label's
    own label, until nothing changes; labels only fall, so the end is exact.
    """
    links = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
    while True:
        label = written(label)
        low = links.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(low, "node").select("node", "comp", F.least("comp", "m").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        step = written(step.join(jump, "new", "left").select("node", "comp", F.least("new", "far").alias("new")))
        if step.filter("new < comp").isEmpty():
            return label
        label = step.select("node", F.col("new").alias("comp"))


def salted(keys: DataFrame) -> DataFrame:
    """band, cid, parts, salt of the buckets with several members: a bucket is dealt
    to `parts` tasks by the salt, so no task gets a hot bucket whole."""
    deal = keys.withColumn("s0", F.pmod(F.xxhash64("cid"), F.lit(FIRST_SALTS)))
    some = deal.groupBy("band", "s0").agg(F.count("*").alias("n"))
    all_ = some.groupBy("band").agg(F.sum("n").alias("n")).filter("n > 1")
    parts = some.select("band", "s0").join(all_, "band").select("band", "s0", F.ceil(F.col("n") / PART).alias("parts"))
    return deal.join(parts, ["band", "s0"]).select("band", "cid", "parts", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).alias("salt"))


def per_part(buckets: DataFrame) -> DataFrame:
    """One row a bucket -> one a part of it (band, salt), to meet its members."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def mixed(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """The members of the buckets that hold several components, with theirs."""
    at = keys.join(comp, F.col("cid") == F.col("node"), "left").select("band", "cid", "parts", "salt", F.coalesce("comp", "cid").alias("comp"))
    several = at.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.first("parts").alias("parts")).filter("x < y").select("band", "parts")
    return at.join(per_part(several), ["band", "salt"])


def largest(at: DataFrame) -> DataFrame:
    """(band, salt, major): each bucket's component with most members."""
    sizes = at.groupBy("band", "comp").agg(F.count("*").alias("n"), F.first("parts").alias("parts"))
    return per_part(sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("m"), F.first("parts").alias("parts")).select("band", "parts", F.col("m.comp").alias("major")))


def possible(size: str, shared: str, other_size: str, other_shared: str):
    """Whether two sets can be linked, as at most the smaller shared number is in both."""
    return F.expr(f"100 * least({shared}, {other_shared}) >= {LIMIT} * ({size} + {other_size} - least({shared}, {other_shared}))")


def possible_beside():
    """The same, knowing what both share with a third set: in common are at most the
    smaller part inside it and the smaller shared part outside it."""
    return F.expr(f"coalesce(100 * (least(both, pb) + least(shared - both, pc - pb)) >= {LIMIT} * (size + ps - least(both, pb) - least(shared - both, pc - pb)), true)")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    A document without words is its own component. Rows without id link with
    nothing: null component, not kept. Rows that repeat an id share its component
    (through each of their texts). Other columns are not read.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    s = written(sketches(d))
    real = s.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # one class per set; its smallest id stands for it
    same = ["f1", "f2", "n_shingles"]
    classes = real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("regs").alias("regs"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    member = written(real.select("doc_id", *same).join(classes.select("cid", *same), same).select("doc_id", "cid"))
    keys = written(bands(classes))
    shared = written(salted(keys))
    sets = written(full_sets(d, classes, shared.select("cid").distinct()))
    # what a set shares with any other bounds its similarity to each of them
    held = written(common_sizes(sets))
    # rows that share an id are one document
    twice = member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a < z").select("doc_id", "a")
    links = written(member.join(twice, "doc_id").filter("a < cid").select("a", F.col("cid").alias("b")).distinct())
    at, tested = shared.join(held, "cid").withColumn("comp", F.col("cid")), None
    for star in range(STARS):
        # the centre: first whoever has the least of its own, then the same, or any one, of the bucket's largest component
        rank = F.xxhash64("cid") if star == STARS - 1 else F.col("size") - F.col("shared")
        held_by = at if star == 0 else at.join(largest(at), ["band", "salt"]).filter("comp = major")
        centre = held_by.groupBy("band").agg(F.min(F.struct(rank.alias("rank"), "cid", "size", "shared", "comp")).alias("m"), F.first("parts").alias("parts"))
        centre = centre.select("band", "parts", *[F.col(f"m.{x}").alias(y) for x, y in (("cid", "p"), ("size", "ps"), ("shared", "pc"), ("comp", "pp"))])
        near = at.filter(f"100 * shared >= {LIMIT} * size").join(per_part(centre), ["band", "salt"]).filter((F.col("comp") != F.col("pp")) & possible("size", "shared", "ps", "pc"))
        pairs = near.select(F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        seen = written(compared(pairs, classes, sets))
        links = written(links.union(seen.filter("linked").select("a", "b")))
        if star == 0:
            # what each member shares with its bucket's first centre
            known = near.select("band", "cid", F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b")).join(seen, ["a", "b"]).select("band", "cid", "both")
            known = written(known.union(centre.select("band", F.col("p").alias("cid"), F.col("pc").alias("both"))))
        at = written(mixed(shared, components(links)).join(held, "cid"))
    # all that may still be linked inside a bucket, between its components
    major = largest(at)
    at = at.join(known, ["band", "cid"], "left").withColumn("both", F.least("both", "shared"))
    minor = at.join(major, ["band", "salt"]).filter("comp <> major").select("band", "parts", F.col("cid").alias("p"), F.col("comp").alias("pp"), "major", F.col("size").alias("ps"), F.col("shared").alias("pc"), F.col("both").alias("pb"))
    minor = minor.filter(f"100 * pc >= {LIMIT} * ps")  # else nothing is near enough, whatever its size
    rest = per_part(minor).join(at, ["band", "salt"]).filter(F.expr("pp <> comp AND (comp = major OR p < cid)") & possible("size", "shared", "ps", "pc") & possible_beside())
    rest = rest.select(F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    every = written(links.union(compared(written(rest), classes, sets).filter("linked").select("a", "b")))
    comp = components(every)
    least = comp.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    least = least.join(least.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select(F.col("node").alias("cid"), "least")
    lone = classes.select("cid", *same, "rep").join(least, "cid", "left").select(*same, F.coalesce("least", "rep").alias("component_id"))
    out = s.select("doc_id", *same).join(lone, same, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
