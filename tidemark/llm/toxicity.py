"""Toxicity: a learned lexicon matched with its misspellings, and context.

Lexicon: from labelled training rows, whole words and word beginnings (stems) that
stand in many toxic texts and hardly any clean one, by document counts and a
log-likelihood ratio; evidence alone decides how many there are. Matching: one
edit of a letter is accepted. The Levenshtein automaton is run over the lexicon's
trie (states: trie node and edits so far) and made deterministic once; all words of
a batch then walk its table together, one lower-cased letter a step, most of them
dying after a few. Context: each hit looks at the words around it. A hit inside a
pair of quotation marks, or near a word that reports speech, is quoted; one near a
word in the second person is directed; a near hit of a short entry counts only
beside another hit or a directed word. A small logistic model over the counts of
plain, misspelt, quoted and directed hits gives the score; fixed prior weights
stand where the training rows say nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import code_points, letters, pick, remainder, runs, steps, text_buffers, written
from tidemark.llm.quality import labelled

#: Labelled rows (about) to learn from.
SAMPLE = 16_000
#: Letters of a stem; least toxic texts, least rate against clean texts, least log-likelihood ratio.
STEM, SUPPORT, RATIO, EVIDENCE = (4, 5, 6, 7), 4, 20.0, 15.0
#: Toxic texts with a stem, against those with its most frequent extension.
WIDER = 1.3
#: Letters from which a word, or a stem, may be misspelt anywhere, and from which only in context.
FUZZY_WORD, SHORT_WORD, FUZZY_STEM, SHORT_STEM = 5, 4, 6, 5
#: Words around a hit that are its context; letters that a quotation spans at most.
WINDOW, QUOTATION = 8, 400
EXACT, MISSPELT, IN_CONTEXT = 1, 2, 3

# Words that report speech and words that address someone.
REPORTING = set("said says say called calls quote quoted quotes word words term wrote wort wörter sagte sagt nannte zitat mot mots dit disait cite palabra palabras dijo dice cita".split())
ADDRESS = set("you your yours youre du dich dir dein deine ihr euch vous votre vos tu toi ton ta tú tus eres usted ustedes".split())
# Quotation marks, and what closes each.
CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "”": "”", "「": "」", "『": "』"}
_MARKS = np.array(sorted({ord(c) for k, v in CLOSES.items() for c in k + v}), np.uint32)
#: Prior weights: intercept; plain, misspelt, quoted, directed hits.
PRIOR = np.array([-4.0, 5.0, 2.5, 1.0, 1.0])

_LOOSE = np.array([ord(c) for c in "*@$'"], np.uint32)


@dataclass
class Tokens:
    """Words of some texts: letters and digits, with * @ $ ' inside only."""

    points: np.ndarray  # code points
    lower: np.ndarray
    at: np.ndarray  # code point offset of each text
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of each text; len = texts + 1

    def word(self, k: int) -> str:
        return self.lower[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    points, at = code_points(data, offsets)
    _, tight, lower = letters(points)
    starts, ends, first = runs(tight | np.isin(points, _LOOSE), at)
    if len(starts):
        # the nearest tight letter from each place on, and up to it
        place = np.arange(len(points))
        ahead = np.minimum.accumulate(np.where(tight, place, len(points))[::-1])[::-1]
        back = np.maximum.accumulate(np.where(tight, place, -1))
        starts = np.minimum(ahead[starts], ends)
        ends = np.maximum(back[ends - 1] + 1, starts)
    return Tokens(points, lower, at, starts, ends, first)


# ------------------------------------------------------------------ lexicon


_WORD = re.compile(r"[^\W_](?:[^\W_]|[*@$'])*")


def _terms(text: str) -> set[tuple[str, int]]:
    """Whole words (kind 0) and stems of k letters (kind k) of a text, each once."""
    out = set()
    low = text.lower() if text.isascii() else "".join([x if len(x := c.lower()) == 1 else c for c in text])
    for w in {m.rstrip("*@$'") for m in _WORD.findall(low)}:
        if len(w) >= 3:
            out.add((w, 0))
            out.update((w[:k], k) for k in STEM if len(w) >= k)
    return out


def lexicon(rows: DataFrame) -> list[tuple[str, int]]:
    """(term, kind) from training rows (doc_id, text, y): kind 0 a whole word, else a stem.
    What comes to the driver are terms of toxic rows of the bounded sample."""
    toxic, clean = rows.filter("y = 1"), rows.filter("y <> 1")
    n1, n0 = toxic.count(), clean.count()

    def counter(known):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    found = _terms(text.as_py() or "")
                    total.update(found if known is None else found & known.value)
            for part in _chunks(list(total.items()), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([t for (t, _), _ in part], pa.string()), pa.array([k for (_, k), _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["term", "kind", "n"])

        return run

    count = lambda side, known: side.select("text").mapInArrow(counter(known), "term string, kind long, n long").groupBy("term", "kind").agg(F.sum("n").alias("n"))
    least = max(SUPPORT, n1 // 400)
    seen = count(toxic, None).filter(F.col("n") >= least).toPandas()
    if not len(seen):
        return []
    terms = list(zip(seen["term"], seen["kind"].tolist(), strict=True))
    against = count(clean, rows.sparkSession.sparkContext.broadcast(set(terms))).toPandas()
    rare = {(t, k): n for t, k, n in zip(against["term"], against["kind"].tolist(), against["n"].tolist(), strict=True)}
    x1, x0 = seen["n"].to_numpy(float), np.array([rare.get(t, 0) for t in terms], float)
    r1, r0 = x1 / max(n1, 1), (x0 + 0.5) / (n0 + 1)
    base = n1 / max(n1 + n0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        llr = 2 * (x1 * np.log(x1 / ((x1 + x0) * base)) + np.where(x0 > 0, x0 * np.log(x0 / ((x1 + x0) * (1 - base))), 0))
    good = np.flatnonzero((r1 >= RATIO * r0) & (llr >= EVIDENCE))
    # a stem has to stand for several words: more texts than its most frequent extension
    best: dict[str, float] = {}
    for i in good:
        t, kind = terms[i]
        for k in STEM:
            if len(t) > k or (kind == 0 and len(t) == k):
                best[t[:k]] = max(best.get(t[:k], 0), x1[i])
    good = [i for i in good if terms[i][1] == 0 or x1[i] >= WIDER * best.get(terms[i][0], 0)]
    stems: set[str] = set()
    out = []
    for i in sorted(good, key=lambda i: (terms[i][1] == 0, terms[i][1], -llr[i], terms[i][0])):
        t, kind = terms[i]
        covered = any(t[:k] in stems for k in STEM)
        if kind and not covered:
            stems.add(t)
        if (kind and not covered) or (kind == 0 and (not covered or len(t) >= SHORT_WORD)):
            out.append((-llr[i], t, kind))
    return [(t, k) for _, t, k in sorted(out)]


def _chunks(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a : a + size]


# ---------------------------------------------------------------- automaton


@dataclass
class Matcher:
    letters: np.ndarray  # code points in the lexicon, sorted; letter k has class k + 1, all others 0
    table: np.ndarray  # state x class -> state; 0 is dead, 1 accepts whatever follows
    accept: np.ndarray  # state -> 0 no, EXACT, MISSPELT or IN_CONTEXT


def automaton(entries: list[tuple[str, int]]) -> Matcher:
    """The lexicon's trie under a Levenshtein automaton of one edit, made deterministic."""
    trie: list[dict[str, int]] = [{}]
    word_end, stem_end, may_err = {}, {}, {0}  # ends: node -> mark of a near match, or 0
    for term, kind in entries:
        node, path = 0, [0]
        for c in term:
            node = trie[node].setdefault(c, len(trie))
            if node == len(trie):
                trie.append({})
            path.append(node)
        sure, short = (FUZZY_STEM, SHORT_STEM) if kind else (FUZZY_WORD, SHORT_WORD)
        mark = MISSPELT if len(term) >= sure else IN_CONTEXT if len(term) >= short else 0
        (stem_end if kind else word_end)[node] = mark
        if mark:
            may_err.update(path)
    alphabet = sorted({c for t in trie for c in t})

    def step(states: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, err in states:
            if c in trie[node]:
                out.add((trie[node][c], err))
            if err == 0 and node in may_err:
                out.add((node, 1))  # an extra letter
                for child in trie[node].values():
                    if child in may_err:
                        out.add((child, 1))  # another letter
                        if c in trie[child]:
                            out.add((trie[child][c], 1))  # a missing letter
        return frozenset(x for x in out if x[1] == 0 or x[0] in may_err)

    def near_ends(ends: dict[int, int], states: frozenset) -> list[int]:
        """Marks of the ends reached with one edit (a last letter may be missing)."""
        return [m for node, err in states for n in ([node] if err else trie[node].values()) if (m := ends.get(n, 0))]

    def accepts(states: frozenset, begun: int) -> int:
        if any(err == 0 and node in word_end for node, err in states):
            return EXACT
        return min([m for m in (*near_ends(word_end, states), begun) if m], default=0)

    # a state: trie nodes with their edits, and the mark of a near stem already passed
    start = (frozenset({(0, 0)}), 0)
    ids, rows, marks, todo = {start: 2}, [[0] * (len(alphabet) + 1), [1] * (len(alphabet) + 1)], [0, EXACT], [start]
    at = 0
    while at < len(todo):
        states, begun = todo[at]
        at += 1
        row = []
        for c in [None, *alphabet]:
            t = step(states, c)
            if any(err == 0 and node in stem_end for node, err in t):
                row.append(1)
                continue
            now = min([m for m in (begun, *(stem_end.get(node, 0) for node, err in t if err)) if m], default=0)
            if not t and not now:
                row.append(0)
                continue
            if (t, now) not in ids:
                ids[t, now] = len(ids) + 2
                todo.append((t, now))
            row.append(ids[t, now])
        rows.append(row)
        marks.append(accepts(states, begun))
    return Matcher(np.array([ord(c) for c in alphabet], np.uint32), np.array(rows, np.int32), np.array(marks, np.int8))


def matches(m: Matcher, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0, EXACT, MISSPELT or IN_CONTEXT for each word."""
    state = np.full(len(starts), 2, np.int32)
    if len(m.letters):
        at = np.minimum(np.searchsorted(m.letters, lower), len(m.letters) - 1)
        letter = np.where(m.letters[at] == lower, at + 1, 0)
    else:
        letter = np.zeros(len(lower), np.int64)
    live, k = np.flatnonzero(ends > starts), 0
    state[ends <= starts] = 0
    while len(live):
        state[live] = m.table[state[live], letter[starts[live] + k]]
        k += 1
        live = live[(state[live] > 1) & (starts[live] + k < ends[live])]
    return m.accept[state]


# ------------------------------------------------------------------ scoring


@dataclass
class Model:
    matcher: Matcher
    weights: np.ndarray
    terms: list[tuple[str, int]]


def quotations(points: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the pairs of quotation marks in one text: an opening mark and the
    next one that closes it, at most QUOTATION letters on. A plain mark opens only
    before, and closes only behind, a letter or sign."""
    out, opened, begin = [], "", 0
    blank = lambda i: not 0 <= i < len(points) or chr(points[i]).isspace()
    for i in np.flatnonzero(np.isin(points, _MARKS)).tolist():
        c = chr(points[i])
        closes = opened and c in CLOSES[opened] and i - begin <= QUOTATION and not (c == '"' and blank(i - 1))
        if closes:
            out.append((begin, i))
            opened = ""
        elif c in CLOSES and not (c == '"' and blank(i + 1)):
            opened, begin = c, i
    return out


def hits(m: Matcher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, misspelt, quoted, directed) of each hit; start and end in
    code points of the text."""
    t = tokens(data, offsets)
    kind = matches(m, t.lower, t.starts, t.ends)
    at = np.flatnonzero(kind)
    doc = np.searchsorted(t.first, at, "right") - 1
    quoted, directed, counts = np.zeros(len(at), bool), np.zeros(len(at), bool), np.ones(len(at), bool)
    pairs: dict[int, list[tuple[int, int]]] = {}
    for i, (k, d) in enumerate(zip(at.tolist(), doc.tolist(), strict=True)):
        near = range(max(k - WINDOW, t.first[d]), min(k + WINDOW + 1, t.first[d + 1]))
        around = {t.word(j) for j in near if j != k}
        if d not in pairs:
            pairs = {d: quotations(t.points[t.at[d] : t.at[d + 1]])}
        begin = t.starts[k] - t.at[d]
        quoted[i] = bool(around & REPORTING) or any(a < begin < b for a, b in pairs[d])
        directed[i] = bool(around & ADDRESS)
        if kind[k] == IN_CONTEXT:
            counts[i] = directed[i] or any(0 < kind[j] < IN_CONTEXT for j in near)
    at, doc, quoted, directed = at[counts], doc[counts], quoted[counts], directed[counts]
    return doc, t.starts[at] - t.at[doc], t.ends[at] - t.at[doc], kind[at] > EXACT, quoted, directed


def _evidence(found: tuple[np.ndarray, ...], texts: int) -> np.ndarray:
    """texts x 4: log1p of plain, misspelt, quoted and directed hits."""
    doc, _, _, fuzzy, quoted, directed = found
    count = lambda which: np.log1p(np.bincount(doc[which], minlength=texts).astype(float))
    return np.stack([count(~fuzzy & ~quoted), count(fuzzy & ~quoted), count(quoted), count(directed & ~quoted)], axis=1)


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a Gaussian prior around PRIOR."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, tight = PRIOR.copy(), np.array([0.1, 0.3, 1.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - tight * (w - PRIOR)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(tight)
        move = np.linalg.solve(h, g)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    w[1:3] = np.maximum(w[1:3], 0)  # a hit never speaks for a text
    return w


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence and hits (start, end in code points, misspelt, quoted, directed)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("misspelt", pa.bool_()), ("quoted", pa.bool_()), ("directed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in steps(offsets):
                found = hits(m.matcher, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                x = _evidence(found, b - a)
                score = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30)))
                per = [[] for _ in range(b - a)]
                for d, s, e, f, q, t in zip(*[c.tolist() for c in found], strict=True):
                    per[d].append({"start": s, "end": e, "misspelt": f, "quoted": q, "directed": t})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(per, pa.list_(hit))], names=["doc_id", "score", "evidence", "hits"])

    shape = T.StructType().add("start", "long").add("end", "long").add("misspelt", "boolean").add("quoted", "boolean").add("directed", "boolean")
    out = T.StructType().add("doc_id", "long").add("score", "double").add("evidence", T.ArrayType(T.DoubleType())).add("hits", T.ArrayType(shape))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col).mapInArrow(run, out)


def trained(rows: DataFrame) -> Model:
    """Lexicon, automaton and weights of a bounded sample of rows (doc_id, text, y)."""
    rows = written(rows)
    terms = lexicon(rows)
    first = Model(automaton(terms), PRIOR, terms)
    seen = scored(rows, first).select("doc_id", "evidence").join(F.broadcast(rows.select("doc_id", "y").dropDuplicates(["doc_id"])), "doc_id")
    got = seen.groupBy("evidence", "y").agg(F.count("*").alias("n")).toPandas()
    if not len(got):
        return first
    x = np.array(got["evidence"].tolist())
    return Model(first.matcher, fitted(x, (got["y"] == 1).to_numpy(float), got["n"].to_numpy(float)), terms)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have no hit and the lowest score. A null id is not held
    out. Repeated rows are scored each; an id labelled twice counts by its highest
    label. Without labels the prior weights and an empty lexicon score all texts alike.
    """
    model = trained(labelled(docs, labels, "toxic", 5, 0, SAMPLE))
    s = scored(pick(docs, doc_id="doc_id", text="text"), model)
    return s.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
