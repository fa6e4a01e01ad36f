"""Language identification of mixed-language text.

A word's letters give its script, by ranges; only languages that use the script
in the training rows stay candidates. Per word, each candidate gets the log
likelihood of the word's letter n-grams. A Viterbi pass over the words of a text,
with a penalty for each switch of language, labels spans; the text's language is
the one that labels most letters.

For most texts the path needs no table: if no run of words favours another
language by more than half the penalty, staying in the best language is optimal
(a path with m departures pays at least m - 1 switches and gains less than m
halves). That test is vectorised over all texts of a batch; the others are walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import code_points, letters, pick, remainder, steps, text_buffers

#: Buckets of n-gram hashes; n-grams of up to three letters, with word edges.
BITS = 15
BUCKETS = 1 << BITS
#: Labelled rows (at most about) that train the model, taken by hash over the whole table.
SAMPLE = 8000
#: Log-likelihood cost of a switch.
SWITCH = 14.0
#: A language uses a script if so much of its training letters are in it.
SCRIPT_SHARE = 0.001
UNDETERMINED = "und"

# First code points of script ranges, and the script from there on.
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in _SCRIPTS})
_FROM = np.array([a for a, _ in _SCRIPTS])
_WHICH = np.array([SCRIPTS.index(s) for _, s in _SCRIPTS])


@dataclass
class Words:
    """Words of some texts, and the hash buckets of their n-grams."""

    starts: np.ndarray  # code points from the first text's begin
    ends: np.ndarray
    first: np.ndarray  # first word of each text; len = texts + 1
    at: np.ndarray  # code point offset of each text
    inner: list[np.ndarray]  # per code point, by n: bucket, or BUCKETS for none
    edges: list[np.ndarray]  # per word: bucket, or BUCKETS
    script: np.ndarray  # per word


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    points, at = code_points(data, offsets)
    letter, _, lower = letters(points)
    c = lower.astype(np.uint64)
    new = np.zeros(len(points) + 1, bool)
    new[at] = True
    before = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
    after = np.concatenate([letter[1:], [False]]) if len(letter) else letter
    starts = np.flatnonzero(letter & (~before | new[:-1]))
    ends = np.flatnonzero(letter & (~after | new[1:])) + 1
    word = np.zeros(len(points) + 2, np.int32)
    word[starts] = 1
    word = np.cumsum(word)
    word[:-2][~letter] = 0
    word[-2:] = 0
    c2 = np.concatenate([c, np.zeros(2, np.uint64)])

    def bucket(kind: int, *gram: np.ndarray) -> np.ndarray:
        h = np.full(len(gram[0]), kind, np.uint64)
        for x in gram:
            h = (h + x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)

    none = np.int32(BUCKETS)
    w0, w1, w2 = word[:-2], word[1:-1], word[2:]
    inner = [
        np.where(letter, bucket(1, c), none),
        np.where(letter & (w0 == w1), bucket(2, c, c2[1:-1]), none),
        np.where(letter & (w0 == w2), bucket(3, c, c2[1:-1], c2[2:]), none),
    ]
    n = ends - starts
    a, b = c2[starts], c2[starts + 1]
    y, z = c2[ends - 1], c2[np.maximum(ends - 2, 0)]
    edges = [bucket(4, a), np.where(n > 1, bucket(5, a, b), none), bucket(6, y), np.where(n > 1, bucket(7, z, y), none), np.where(n == 2, bucket(8, a, b), none), np.where(n == 3, bucket(9, a, b, y), none)]
    script = _WHICH[np.searchsorted(_FROM, points[starts], "right") - 1]
    return Words(starts, ends, np.searchsorted(starts, at), at, inner, edges, script)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS + 1) x languages; the last row is 0
    uses: np.ndarray  # scripts x languages

    def scores(self, w: Words) -> np.ndarray:
        """Words x languages."""
        if not len(w.starts):
            return np.zeros((0, len(self.langs)))
        p = self.weights[w.inner[0]]
        for b in w.inner[1:]:
            p += self.weights[b]
        s = np.add.reduceat(p, w.starts, axis=0)
        for b in w.edges:
            s += self.weights[b]
        return np.where(self.uses[w.script], s, s - 1000.0).astype(np.float64)


def counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of (lang, text); buckets from BUCKETS on count letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        size = BUCKETS + 1 + len(SCRIPTS)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_buffers(batch.column(1))
            for a, b in steps(offsets):
                w = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(a, b):
                    t = total.setdefault(langs[i], np.zeros(size, np.int64))
                    x, y = w.at[i - a], w.at[i - a + 1]
                    f, g = w.first[i - a], w.first[i - a + 1]
                    for e in w.inner:
                        t[: BUCKETS + 1] += np.bincount(e[x:y], minlength=BUCKETS + 1)
                    for e in w.edges:
                        t[: BUCKETS + 1] += np.bincount(e[f:g], minlength=BUCKETS + 1)
                    t[BUCKETS + 1 :] += np.bincount(w.script[f:g], (w.ends - w.starts)[f:g], len(SCRIPTS)).astype(np.int64)
        for lang, t in total.items():
            t[BUCKETS] = 0
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(t[at], pa.int64())], names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of rows (doc_id, lang, text) whose crc32 remainder by 4 is not 2
    and whose lang is not null: about `sample` of them, by hash of the id.

    What comes to the driver is BUCKETS counts a language at most.
    """
    d = pick(docs, doc_id="doc_id", lang="lang", text="text")
    d = d.filter(F.col("lang").isNotNull() & ~F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    n = d.select("doc_id").count()
    share = min(1.0, sample / max(n, 1))
    d = d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = counts(d.select("lang", "text")).toPandas()
    langs = sorted(rows["lang"].unique())
    c = np.zeros((BUCKETS + 1 + len(SCRIPTS), max(len(langs), 1)))
    for k, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        c[mine["bucket"].to_numpy(np.int64), k] = mine["n"].to_numpy()
    grams, script = c[:BUCKETS], c[BUCKETS + 1 :]
    weights = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    if langs:
        weights[:BUCKETS] = np.log((grams + 0.2) / (grams.sum(0) + 0.2 * BUCKETS))
    uses = script >= SCRIPT_SHARE * np.maximum(script.sum(0), 1)
    uses &= script > 0
    uses[~uses.any(1)] = True  # a script that no learned language uses
    return Model(langs, weights, uses[:, : len(langs)])


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word of one text."""
    v = list(s[0])
    back = np.empty(s.shape, np.int32)
    stay = list(range(len(v)))
    for t, row in enumerate(s.tolist()):
        if t == 0:
            continue
        top = max(v)
        j = v.index(top)
        from_top = top - switch
        back[t] = [k if v[k] >= from_top else j for k in stay]
        v = [(v[k] if v[k] >= from_top else from_top) + row[k] for k in stay]
    path = np.empty(len(s), np.int32)
    k = v.index(max(v))
    for t in range(len(s) - 1, -1, -1):
        path[t] = k
        if t:
            k = back[t, k]
    return path


def paths(s: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """(language of every word, sums of each text), for texts' words first[i]:first[i+1]."""
    n = np.diff(first)
    run = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)])
    total = run[first[1:]] - run[first[:-1]]
    best = total.argmax(1)
    path = np.repeat(best, n)
    # largest sum of any run of words in favour of another language
    doc = np.repeat(np.arange(len(n)), n)
    gap = np.zeros(len(n))
    has = np.flatnonzero(n)
    if len(has):
        own = s[np.arange(len(s)), path]
        for k in range(s.shape[1]):
            d = s[:, k] - own
            c = np.concatenate([[0.0], np.cumsum(d)])
            fall = doc * -(2 * np.abs(d).sum() + 1.0)
            low = np.minimum.accumulate(c[:-1] + fall) - fall
            gap[has] = np.maximum(gap[has], np.maximum.reduceat(c[1:] - low, first[:-1][has]))
    for i in np.flatnonzero(gap > switch / 2):
        path[first[i] : first[i + 1]] = viterbi(s[first[i] : first[i + 1]], switch)
    return path, total


def labelled(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", switch: float = SWITCH, least: float | None = None) -> DataFrame:
    """The columns `keep`, lang_pred, score, spans (start, end, lang; in code points) and sure.

    `und`, score and sure 0 and no spans where the text is null or has no letter, or no
    language was learned. The score is the share of letters in the predicted
    language times how clearly its words favour it over the next language. `sure` is how
    likely the spans' languages are among all learned ones (log likelihood over the
    square root of a span's words), by their letters: whatever the languages' shares.

    With `least`, only the columns `keep` of the rows that have a language and are at
    least so sure come back from the workers, so a text travels once each way.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sent = keep if text_col in keep else (*keep, text_col)
    held, text_at = docs.select(*[F.col(f"`{c}`") for c in sent]), sent.index(text_col)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            for a, b in steps(offsets):
                pred, score, spans, clear = [UNDETERMINED] * (b - a), [0.0] * (b - a), [[] for _ in range(b - a)], np.zeros(b - a)
                w = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if m.langs and len(w.starts):
                    words = m.scores(w)
                    path, total = paths(words, w.first, switch)
                    length = (w.ends - w.starts).astype(np.float64)
                    n = np.diff(w.first)
                    doc = np.repeat(np.arange(b - a), n)
                    held = np.bincount(doc * len(m.langs) + path, length, (b - a) * len(m.langs)).reshape(b - a, -1)
                    lang = held.argmax(1)
                    ranked = np.sort(total, axis=1)
                    lead = total[np.arange(b - a), lang] - (ranked[:, -2] if len(m.langs) > 1 else -np.inf)
                    sure = 1 / (1 + np.exp(-np.clip(np.where(lead > 0, lead, 0) / np.sqrt(np.maximum(n, 1)), 0, 50)))
                    share = held.max(1) / np.maximum(held.sum(1), 1)
                    turn = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
                    last = np.concatenate([turn[1:], [len(path)]]) - 1
                    fit = np.add.reduceat(words, turn, axis=0) / np.sqrt(last - turn + 1)[:, None]
                    odds = np.exp(fit - fit.max(1, keepdims=True))
                    odds = odds[np.arange(len(turn)), path[turn]] / odds.sum(1)
                    clear = np.bincount(doc[turn], odds * np.add.reduceat(length, turn), b - a) / np.maximum(held.sum(1), 1)
                    if least is None:
                        for x, y in zip(turn, last, strict=True):
                            i = doc[x]
                            spans[i].append({"start": int(w.starts[x] - w.at[i]), "end": int(w.ends[y] - w.at[i]), "lang": m.langs[path[x]]})
                        for i in np.flatnonzero(n):
                            pred[i], score[i] = m.langs[lang[i]], float(share[i] * sure[i])
                own = [c.slice(a, b - a) for c in batch.columns[: len(keep)]]
                if least is not None:
                    known = np.diff(w.first) > 0 if m.langs else np.zeros(b - a, bool)
                    yield pa.RecordBatch.from_arrays(own, names=list(keep)).filter(pa.array(known & (clear >= least)))
                    continue
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span)), pa.array(clear)], names=[*keep, "lang_pred", "score", "spans", "sure"])

    out = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep])
    if least is not None:
        return held.mapInArrow(run, out)
    out = out.add("lang_pred", "string").add("score", "double")
    out.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("lang", "string"))).add("sure", "double")
    return held.mapInArrow(run, out)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Null texts and texts without a letter: `und` and 0. A null id is not held
    out. Repeated rows are predicted each. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="doc_id", lang="lang", text="text")
    p = labelled(d, trained(d))
    return p.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
