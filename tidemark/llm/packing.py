"""Packing by lexical retrieval.

Documents become token ids. Full windows of a long document stand alone; what is
left of each document (less than a window) goes to one of many shards of bounded
size. Shards are ranges of pieces ordered by their rarest shared tokens, so pieces
that share these meet, and a hot token's pieces are split by the next rarest. A
shard is one BM25 index over its pieces' tokens, with document frequencies and mean
length of the whole corpus: a seed piece opens a window, its own rarest tokens
query the index, and the unused neighbours fill the window, best first. A used-up
list is asked for again, at last with all of the seed's tokens; only where no unused
piece of the shard shares any does the next in order follow. What fits whole is
preferred; else the best neighbour is cut
and its rest is the next seed. The last, unfilled window of a shard is cut at
powers of two, which need no padding; so there is no padding at all.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import read_vocabulary
from tidemark.llm.common import mix, pick, steps, text_buffers, written

WINDOW = 2048
#: Id that ends a document.
END = 1
#: Documents of a shard (on average); tokens of a query; neighbours looked at.
SHARD_DOCS, QUERY, NEIGHBOURS = 2000, 24, 48
#: Tokens of the order that shards are ranges of; pieces of each shard looked at for its bounds.
ORDER, BOUNDS = 3, 50
#: BM25.
K1, B = 1.2, 0.75
#: Words and parts of words remembered by a Python worker, at most; their bytes, at most.
CACHE_WORDS, CACHE_BYTES = 600_000, 1 << 26

_ROWS = "place long, doc_id long, start long, length long, ids binary, crc long, doc_tokens long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# A word of plain and Western European letters, digits and signs; its pre-tokens.
_EASY = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_EASY_WORDS = re.compile("[ -~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile("\x01|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9\x01]+")


class Ids:
    """Keys and their ids, in flat arrays."""

    def __init__(self):
        self.known: dict = {}
        self.flat, self.at, self.used, self.held = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def __len__(self) -> int:
        return len(self.known)

    def add(self, keys: list, ids: np.ndarray, size: np.ndarray) -> None:
        n, first = len(ids), len(self.known)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + n] = ids
        self.at[first + 1 : first + len(keys) + 1] = self.used + np.cumsum(size)
        self.used += n
        self.held += 4 * n + sum(map(len, keys))
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))

    def index(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the keys one after another, offsets)."""
        size = self.at[index + 1] - self.at[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.at[index] - upto[:-1], size) + np.arange(upto[-1])], upto


class Merges:
    """Byte-level BPE of many pre-tokens at once. In a round each pre-token's merge of least rank, the
    leftmost of equal ones, is done, as the tokenizer does one after another; all of them as numpy vectors."""

    #: Longest pre-token (in bytes): its merges are as many rounds.
    LONGEST = 64
    NONE = 1 << 30

    def __init__(self, source: str):
        model = json.loads(source)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.first = np.array([vocab.get(letter[b], -1) for b in range(256)])
        self.last = np.array([vocab.get(letter[b] + suffix, -1) for b in range(256)])
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        prefix = len(model.get("continuing_subword_prefix") or "")
        # what these rounds don't cover is left to the tokenizer
        self.usable = model["type"] == "BPE" and not (model.get("dropout") or model.get("ignore_merges") or prefix) and min(self.first.min(), self.last.min()) >= 0 and len(set(map(tuple, pairs))) == len(pairs) > 0
        if self.usable:
            self.made = np.array([vocab[a + b] for a, b in pairs])
            self._place(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray) -> None:
        """A hash table of pairs: slots one after another are tried until one is free."""
        self.bits = int(4 * len(keys)).bit_length()
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            self.key[slot[free[one]]], self.rank[slot[free[one]]] = keys[free[one]], free[one]
            left = np.setdiff1d(left, free[one], assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or NONE."""
        key = left << 32 | right
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.rank[slot], self.NONE)
        ask = np.flatnonzero((found != key) & (found >= 0))
        while len(ask):
            slot[ask] = (slot[ask] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[ask]]
            hit = found == key[ask]
            out[ask[hit]] = self.rank[slot[ask[hit]]]
            ask = ask[~hit & (found >= 0)]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, their number per piece). No piece is empty."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end, which = np.cumsum(size), np.arange(len(pieces))
        ids = self.first[data]
        ids[end - 1] = self.last[data[end - 1]]
        rank = np.full(len(ids), self.NONE, np.int64)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[end - 1] = self.NONE
        done = []
        while len(which):
            begin = end - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), begin)
            go = best < self.NONE << 32
            if not go.all():
                of = np.repeat(go, size)
                done.append((which[~go], size[~go], ids[~of]))
                # positions move down by the symbols of finished pieces before them
                best = best[go] - np.cumsum(np.where(go, 0, size))[go]
                ids, rank, which, size = ids[of], rank[of], which[go], size[go]
            at = best & 0xFFFFFFFF
            ids[at] = self.made[best >> 32]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, at, size = ids[keep], rank[keep], at - np.arange(len(at)), size - 1
            end = np.cumsum(size)
            rank[at] = self.NONE
            x = at[at < end - 1]
            rank[x] = self.ranks(ids[x], ids[x + 1])
            x = at[at > end - size] - 1
            rank[x] = self.ranks(ids[x], ids[x + 1])
        number, place = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        upto = 0
        for w, n, _ in done:
            number[w], place[w] = n, upto + np.cumsum(n) - n
            upto += int(n.sum())
        flat = np.concatenate([x for *_, x in done]) if done else ids
        first = np.cumsum(number) - number
        return flat[np.repeat(place - first, number) + np.arange(upto)].astype(np.uint32), number


class Tokens:
    """Ids of texts. The tokenizer never joins over white space, so each distinct
    word goes through it once and is then looked up."""

    def __init__(self, source: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.outer = Tokenizer.from_str(source)
        self.outer.no_padding()
        self.outer.no_truncation()
        vocabulary = self.outer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        (self.mark,) = self.outer.encode("\x01", add_special_tokens=False).ids
        self.merges = Merges(source)
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = Ids(), Ids()
        self.pieces.add(["\x01"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def outright(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number per word): many words in one call, with a mark of one id between them."""
        ids = self.ids(" \x01 ".join(words) + " \x01")
        return ids[ids != self.mark], np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.outer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn_pieces(self, pieces: list[str]) -> None:
        """Lower-case pre-tokens, none known."""
        short, long = pieces, []
        coded = [p.encode() for p in pieces]
        if not self.merges.usable:
            short, coded, long = [], [], pieces
        elif coded and max(map(len, coded)) > Merges.LONGEST:
            long = [p for p, c in zip(pieces, coded, strict=True) if len(c) > Merges.LONGEST]
            short = [p for p, c in zip(pieces, coded, strict=True) if len(c) <= Merges.LONGEST]
            coded = [c for c in coded if len(c) <= Merges.LONGEST]
        if short:
            self.pieces.add(short, *self.merges.encode(coded))
        if long:
            # each is one pre-token, so its last id, and no other, ends a word
            ids = self.ids(" ".join(long))
            self.pieces.add(long, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))

    def learn_easy(self, words: list[bytes], marked: str) -> None:
        """Words that fall into pieces (letters, digit, signs), of which fewer are new; `marked`: each followed by a mark."""
        pieces = _PIECE.findall(marked)
        unknown = list(set(pieces).difference(self.pieces.known))
        if unknown:
            self.learn_pieces(unknown)
        index = self.pieces.index(pieces)
        ids, upto = self.pieces.gather(index)
        ends = upto[1:][index == 0]
        self.words.add(words, ids, np.diff(ends, prepend=0))

    def learn(self, new: list[bytes]) -> None:
        joined = b" ".join(new).decode()
        if new and _EASY_WORDS.fullmatch(joined) and "<|" not in joined:
            self.learn_easy(new, joined.lower().replace(" ", " \x01 ") + " \x01")
            return
        words = [w.decode() for w in new]
        easy = [i for i, w in enumerate(words) if _EASY.fullmatch(w) and "<|" not in w]
        if easy:
            self.learn_easy([new[i] for i in easy], " \x01 ".join([words[i] for i in easy]).lower() + " \x01")
        taken = set(easy)
        rest = [i for i in range(len(words)) if i not in taken and "\x01" not in words[i]]
        if rest:
            self.words.add([new[i] for i in rest], *self.outright([words[i] for i in rest]))
        for i in sorted(set(range(len(words))) - taken - set(rest)):
            ids = np.array(self.outer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            self.words.add([new[i]], ids, np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by END; offsets). No text is null."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        data, offsets = text_buffers(coded.dictionary)
        data, offsets = data.tobytes(), offsets.tolist()
        words = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        index = np.fromiter(map(self.words.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            if len(self.words) + len(self.pieces) + len(missing) > CACHE_WORDS or self.words.held + self.pieces.held > CACHE_BYTES:
                self.clear()
                missing = np.arange(len(words))
            new = [words[i] for i in missing]
            self.learn(new)
            index[missing] = self.words.index(new)
        ids, upto = self.words.gather(index[coded.indices.to_numpy()])
        at = split.offsets.to_numpy()
        ends = upto[at - at[0]]
        return np.insert(ids, ends[1:], END), ends + np.arange(len(ends))


_held: dict[str, Tokens] = {}


def tokens(source: str) -> Tokens:
    """The tokenizer of a vocabulary; a Python worker keeps it for its next tasks."""
    if source not in _held:
        _held.clear()
        _held[source] = Tokens(source)
    return _held[source]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, source) -> DataFrame:
    """Full windows (finished: ids null) and the rest of each document, with their place in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = tokens(source.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, doc_ids = batch.column(1).fill_null(""), batch.column(0).to_pylist()
            for a, b in steps(text_buffers(texts)[1]):
                ids, at = enc.encode(texts.slice(a, b - a))
                rows = []
                for i in range(b - a):
                    x = ids[at[i] : at[i + 1]]
                    n = len(x)
                    full = n - n % WINDOW
                    rows += [(doc_ids[a + i], s, WINDOW, None, crc(x[s : s + WINDOW]), n) for s in range(0, full, WINDOW)]
                    if full < n:
                        rows.append((doc_ids[a + i], full, n - full, x[full:].astype("<u4").tobytes() if x.max() > 65535 else x[full:].astype("<u2").tobytes(), None, n))
                place = np.arange(done, done + len(rows))
                done += len(rows)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["place", "doc_id", "start", "length", "ids", "crc", "doc_tokens"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, _ROWS)


def tokens_of(ids: bytes, length: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4")


def narrow(keys: np.ndarray, most: int) -> np.ndarray:
    """Keys below `most` in four bytes where they fit: these sort in half the time."""
    return keys.astype(np.int32) if most < 1 << 31 else keys


class Corpus:
    """Number and mean length of all pieces, and how many hold each token."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.n, self.mean, self.df = n, total / max(n, 1), df
        shared = np.flatnonzero(df > 1)
        self.rank = np.full(len(df), 0xFFFF, np.int64)
        self.rank[shared[np.lexsort((shared, df[shared]))]] = np.minimum(np.arange(len(shared)), 0xFFFE)

    def keys(self, pieces: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """The rarest shared tokens of each piece (never empty), then a hash of its place."""
        first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        rank, key = self.rank[np.concatenate(pieces)], np.zeros(len(pieces), np.int64)
        for _ in range(ORDER):
            least = np.minimum.reduceat(rank, first[:-1])
            key = key << 16 | least
            rank[rank == np.repeat(least, np.diff(first))] = 0xFFFF
        return key << 15 | (mix(place.astype(np.uint64)) >> np.uint64(49)).astype(np.int64)


def pieces_of(batch: pa.RecordBatch, size: int = 500) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and token ids of up to `size` unfinished pieces at a time."""
    at, n = batch.schema.get_field_index("ids"), batch.schema.get_field_index("length")
    for a in range(0, batch.num_rows, size):
        part = batch.slice(a, size)
        yield a, [tokens_of(x, k) for x, k in zip(part.column(at).to_pylist(), part.column(n).to_pylist(), strict=True)]


def corpus(pieces: DataFrame) -> Corpus:
    """What comes to the driver is one row a token of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for _, ids in pieces_of(batch):
                size = [len(p) for p in ids]
                term = np.concatenate(ids).astype(np.int64)
                span = int(term.max()) + 1
                # with counts numpy sorts, which is many times faster here than its hash table
                held, _ = np.unique(narrow(np.repeat(np.arange(len(ids)), size) * span + term, len(ids) * span), return_counts=True)
                count = np.bincount(held % span, minlength=len(df))
                count[: len(df)] += df
                df, n, total = count, n + len(ids), total + len(term)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())], names=["term", "n"])

    rows = {r["term"]: r["n"] for r in pieces.select("length", "ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = rows.pop(-2, 0), rows.pop(-1, 0)
    df = np.zeros(max(rows, default=0) + 1, np.int64)
    df[list(rows)] = list(rows.values())
    return Corpus(n, total, df)


def keyed(pieces: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            keys = [shared.value.keys(ids, place[a : a + len(ids)]) for a, ids in pieces_of(batch)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    return pieces.select("place", "length", "ids").mapInArrow(run, "key long")


def dealt(rows: DataFrame, shards: int, shared) -> DataFrame:
    """Rows with their shard: pieces by the range of their key, full windows by place."""
    held = rows.filter("ids IS NOT NULL")
    if shards > 1:
        share = min(1.0, BOUNDS * shards / max(shared.value.n, 1))
        sample = held.filter(F.pmod(F.xxhash64("place"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        seen = np.sort(np.array([r["key"] for r in keyed(sample, shared).collect()], np.int64))
        bounds = seen[np.arange(1, shards) * len(seen) // shards] if len(seen) else np.zeros(0, np.int64)
    else:
        bounds = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            for a, ids in pieces_of(batch):
                part = batch.slice(a, len(ids))
                shard = np.searchsorted(bounds, shared.value.keys(ids, place[a : a + len(ids)]), "right")
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *part.columns[1:]], names=["shard", *part.schema.names[1:]])

    full = rows.filter("ids IS NULL").withColumn("place", F.pmod(F.xxhash64("place"), F.lit(shards))).withColumnRenamed("place", "shard")
    return held.mapInArrow(run, _ROWS.replace("place", "shard")).unionByName(full)


class Index:
    """BM25 over the pieces of a shard."""

    def __init__(self, pieces: list[np.ndarray], corpus: Corpus):
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.float64)
        owner, term = np.repeat(np.arange(n), size.astype(np.int64)), np.concatenate(pieces).astype(np.int64)
        span = int(term.max()) + 1
        key, tf = np.unique(narrow(owner * span + term, n * span), return_counts=True)
        owner, term = np.divmod(key.astype(np.int64), span)
        df = np.bincount(term, minlength=span)
        idf = np.log1p((corpus.n - corpus.df[:span] + 0.5) / (corpus.df[:span] + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / corpus.mean))
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(df)]).tolist()
        # a piece's query: its tokens that another piece has too, heaviest first
        shared = df[term] > 1
        o, t, w = owner[shared], term[shared], weight[shared]
        by = np.lexsort((t, -w, o))
        o, t = o[by], t[by]
        begin = np.searchsorted(o, np.arange(n + 1))
        self.query = [t[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]

    def neighbours(self, piece: int, unused: np.ndarray) -> np.ndarray:
        """The best unused pieces, best first, ties in order: by the heaviest
        tokens, or by all where those have none left."""
        found = self.asked(self.query[piece][:QUERY], unused)
        return found if len(found) else self.asked(self.query[piece][QUERY:], unused)

    def asked(self, query: np.ndarray, unused: np.ndarray) -> np.ndarray:
        spans = [slice(self.first[t], self.first[t + 1]) for t in query.tolist()]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.owner[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), len(unused))
        score *= unused
        found = np.flatnonzero(score)
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-score[found], NEIGHBOURS - 1)[:NEIGHBOURS]]
        return found[np.lexsort((found, -score[found]))]


def fill(pieces: list[np.ndarray], corpus: Corpus) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, to)."""
    unused = np.ones(len(pieces), bool)
    index, windows, window, room, rest, turn = Index(pieces, corpus), [], [], WINDOW, None, 0
    size = [len(p) for p in pieces]
    while True:
        if rest is None:
            while turn < len(pieces) and not unused[turn]:
                turn += 1
            if turn == len(pieces):
                break
            rest = (turn, 0)
            unused[turn] = False
        seed, at = rest
        rest = None
        window.append((seed, at, size[seed]))
        room = WINDOW - (size[seed] - at)
        near: list[int] = []
        while room:
            if not near:
                near = index.neighbours(seed, unused).tolist()
            k = next((k for k in near if size[k] <= room), near[0] if near else None)
            if k is None:
                while turn < len(pieces) and not unused[turn]:
                    turn += 1
                if turn == len(pieces):
                    break
                k = turn
            else:
                near.remove(k)
            unused[k] = False
            take = min(room, size[k])
            window.append((k, 0, take))
            room -= take
            if take < size[k]:
                rest = (k, take)
        if room:
            break
        windows.append(window)
        window = []
    # the open window, at powers of two
    left = sum(b - a for _, a, b in window)
    while left:
        want, part = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            k, a, b = window.pop(0)
            take = min(want, b - a)
            part.append((k, a, a + take))
            want -= take
            if a + take < b:
                window.insert(0, (k, a + take, b))
        windows.append(part)
    return windows


def pack(table: pa.Table, corpus: Corpus) -> pa.Table:
    """The pieces of one shard."""
    table = table.combine_chunks()
    shard = table.column("shard")[0].as_py() if table.num_rows else 0
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids", "crc", "doc_tokens")], strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or b"", r[4] or 0))
    out, held = [], [r for r in rows if r[3] is not None]
    sequence = shard << 24
    for d, start, length, _, c, n in (r for r in rows if r[3] is None):
        out.append((d, start, length, c, n, sequence, 0))
        sequence += 1
    if held:
        ids = [tokens_of(r[3], r[2]) for r in held]
        for window in fill(ids, corpus):
            offset = 0
            for k, a, b in window:
                out.append((held[k][0], held[k][1] + a, b - a, crc(ids[k][a:b]), held[k][5], sequence, offset))
                offset += b - a
            sequence += 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Rows with a null or repeated id are
    packed each (their pieces carry that id). An empty table has no pieces. The
    number of shards follows the rows, so a shard stays small at any size; pieces
    go to shards by their tokens, equal ones by their place in the input.
    """
    spark = docs.sparkSession
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    rows = written(cut(docs, spark.sparkContext.broadcast(read_vocabulary(vocabulary))))
    shared = spark.sparkContext.broadcast(corpus(rows.filter("ids IS NOT NULL")))
    return dealt(rows, shards, shared).groupBy("shard").applyInArrow(lambda table: pack(table, shared.value), _PIECES)
