"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text, all hashed to one space of 2^18 weights: words and word
pairs; the same of word shapes (runs of letters, capitals, digits and each symbol
folded to one character), which generalise to unseen words; and whether a word
pair or a word was already in the text, or a word stands twice in a row. Each n-gram's value is its share of the
text's words, under a square root. Training rows are spread over tasks; each task runs
FTRL-proximal over its share, and the tasks' weights are averaged (one round of
parameter mixing), so the driver sees one bounded weight vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, pick, remainder, span_hashes, steps, text_buffers, word_spans

#: Hashed weights.
DIMENSIONS = 1 << 18
#: Labelled rows (about) that train the model, and tasks that share them.
SAMPLE, SHARDS = 12_000, 4
#: FTRL-proximal: learning rate, its smoothing, L1 and L2; passes over the rows.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.3, 0.5, 3

_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _SHAPE[_c] = _c


def _classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape, equal neighbours folded."""
    s = _SHAPE[data]
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(s[keep], at[starts], at[ends])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, index, value), sorted by text and index."""
    starts, ends, first = word_spans(data, offsets)
    texts = len(offsets) - 1
    doc = np.repeat(np.arange(texts), np.diff(first))
    word, shape = span_hashes(data, starts, ends, fold=True), _classes(data, starts, ends)
    pair = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    two = mix(word[:-1] * np.uint64(3) + word[1:])[pair]
    shapes = mix(shape[:-1] * np.uint64(5) + shape[1:])[pair]
    again = lambda d, h: _again(d, h, texts)
    marks = np.array([11, 12, 13, 14, 15, 16], np.uint64)
    by_text = [(doc, word), (doc[1:][pair], two), (doc, shape), (doc[1:][pair], shapes)]
    seen_pair, seen_word = again(by_text[1][0], two), again(doc, word)
    by_text += [(by_text[1][0], marks[seen_pair.astype(int)]), (doc, marks[2 + seen_word.astype(int)]), (by_text[1][0], marks[4 + (word[1:] == word[:-1])[pair].astype(int)])]
    d = np.concatenate([x for x, _ in by_text])
    f = np.concatenate([mix(h + np.uint64(k + 1)) & np.uint64(DIMENSIONS - 1) for k, (_, h) in enumerate(by_text)])
    key, n = np.unique(d.astype(np.uint64) * np.uint64(DIMENSIONS) + f, return_counts=True)
    d, f = (key // np.uint64(DIMENSIONS)).astype(np.int64), (key % np.uint64(DIMENSIONS)).astype(np.int64)
    return d, f, np.sqrt(n / np.maximum(np.diff(first), 1)[d])


def _again(doc: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """Whether the same hash stood earlier in the text."""
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        a, b = order[1:], order[:-1]
        same[a] = (doc[a] == doc[b]) & (h[a] == h[b])
    return same


class Ftrl:
    """FTRL-proximal for logistic loss."""

    def __init__(self, n: int):
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x * weight
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def trained(rows: DataFrame) -> np.ndarray:
    """Weights (DIMENSIONS, and the intercept last) from a bounded sample of rows
    (doc_id, text, y). Without rows all weights are 0 and every score is 0.5."""
    chosen = rows.select("doc_id", "text", F.col("y").cast("double").alias("y")).repartition(SHARDS, F.xxhash64("doc_id", F.length("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(DIMENSIONS + 1), []
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            y = batch.column(2).to_numpy()
            ids = [str(i) for i in batch.column(0).to_pylist()]
            for a, b in steps(offsets):
                d, f, v = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cut = np.searchsorted(d, np.arange(b - a + 1))
                for i in range(b - a):
                    x = slice(cut[i], cut[i + 1])
                    held.append((ids[a + i], np.append(f[x], DIMENSIONS).astype(np.int32), np.append(v[x], 1.0).astype(np.float32), y[a + i]))
        held.sort(key=lambda r: (hash_of(r[0]), r[0], len(r[1])))  # an order that no shuffle changes
        for _ in range(PASSES):
            for _, at, x, label in held:
                model.learn(at, x, label, 1.0)
        w = model.weights(slice(None))
        at = np.flatnonzero(w) if held else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], float(len(held))))], names=["at", "w"])

    parts = chosen.mapInArrow(run, "at long, w double")
    # weights of a shard without rows count for nothing
    got = parts.groupBy("at").agg(F.sum("w").alias("w"), F.sum((F.col("w") > 0).cast("long")).alias("n")).toPandas()
    out = np.zeros(DIMENSIONS + 1)
    shards = int(got.loc[got["at"] == -1, "n"].sum())
    real = got[got["at"] >= 0]
    out[real["at"].to_numpy(np.int64)] = real["w"].to_numpy() / max(shards, 1)
    return out.astype(np.float32)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def scored(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: float | None = None) -> DataFrame:
    """The columns `keep` and score (0 to 1) of every whole text; a null or empty
    text is scored by the intercept alone. With `least`, only the columns `keep` of
    the rows with at least that score come back from the workers."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            for a, b in steps(offsets):
                d, f, v = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                z = np.bincount(d, w[f] * v, b - a) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                own = [c.slice(a, b - a) for c in batch.columns[: len(keep)]]
                if least is None:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(score)], names=[*keep, "score"])
                else:
                    yield pa.RecordBatch.from_arrays(own, names=list(keep)).filter(pa.array(score >= least))

    sent = keep if text_col in keep else (*keep, text_col)
    held, text_at = docs.select(*[F.col(f"`{c}`") for c in sent]), sent.index(text_col)
    shape = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep])
    return held.mapInArrow(run, shape.add("score", "double") if least is None else shape)


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, out: int, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of labelled training rows: crc32 remainder by `folds` is
    not `out`. About `sample` ids, by hash over the whole table; as
    so few ids are broadcast, no text is shuffled. An id labelled twice counts
    once, by its highest label; null labels and ids are left out."""
    y = pick(labels, doc_id="doc_id", y=column).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(remainder(F.col("doc_id"), folds) != out)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(y.count(), 1))
    y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    return pick(docs, doc_id="doc_id", text="text").join(F.broadcast(y), "doc_id")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null id is not held out."""
    weights = trained(labelled(docs, labels, "quality", 3, 1))
    s = scored(pick(docs, doc_id="doc_id", text="text"), weights)
    return s.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
