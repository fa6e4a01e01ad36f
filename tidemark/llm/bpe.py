"""BPE encoding by backtracking, decoding by an offset table.

A pre-token is encoded left to right. An Aho-Corasick automaton over the
vocabulary gives, in one pass, the longest token that starts at each position.
The encoder takes that token if the merge rules could leave it beside the token
before it (a memoised pair-compatibility table, found by undoing merges from
the boundary outwards); else it tries the next shorter token, and with none left
it steps back. The result is exactly what rank-ordered merging gives, without a
priority queue. Whole words are remembered, with a bound on the memory.

Decoding copies slices of one string of all token texts, by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pick

#: Words remembered by a task; the memory is emptied when full.
CACHE_WORDS = 150_000
#: Pairs remembered by a task, likewise.
PAIRS = 400_000
#: Byte levels of the vocabulary's alphabet; the second half ends a word.
WORD_END = "</w>"
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_vocabulary(path: str | None = None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        import ahocorasick
        from tokenizers import Tokenizer

        model = json.loads(source)
        self.outer = Tokenizer.from_str(source)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # A symbol with the word-end mark is one letter of the automaton's alphabet.
        letters = sorted(k for k in vocab if len(k) == 1)
        self.end = {c: chr(0xE000 + i) for i, c in enumerate(letters)}
        inner = lambda k: k[: -len(WORD_END) - 1] + self.end[k[-len(WORD_END) - 1]] if k.endswith(WORD_END) and len(k) > len(WORD_END) else k
        self.text = {v: inner(k) for k, v in vocab.items()}
        self.ids = {s: i for i, s in self.text.items()}
        self.made: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = (rank, whole)
            self.made.setdefault(whole, (left, right))
        # order of the merge that makes a token; a letter precedes all merges
        self.order = {i: self.rank[p][0] for i, p in self.made.items()}
        usable = [i for s, i in self.ids.items() if len(s) == 1 or i in self.made]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        kept = set(usable)
        self.size = {i: len(x) for i, x in self.text.items()}
        self.shorter: dict[int, int] = {}
        for i in usable:
            s = self.text[i]
            for k in range(len(s) - 1, 0, -1):
                j = self.ids.get(s[:k])
                if j is not None and j in kept:
                    self.shorter[i] = j
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        shown = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for k, v in [*vocab.items(), *self.special.items()]:
            shown[v] = k
        self.table, self.offset = "".join(shown), [0]
        for s in shown:
            self.offset.append(self.offset[-1] + len(s))
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}
        self.raw: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.raw_old: dict[bytes, tuple[int, bytes, bytes]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves left and right side by side: no merge
        across their boundary comes before the merges that made them. Remembered."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            across = self.rank.get((a, b))
            if across is not None and across[0] < limit:
                return False
            ra, rb = self.order.get(a, -1), self.order.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later merge; of equal ones the right one, as merging runs
            # from the left. What stands at the boundary then must not merge first.
            if ra > rb:
                limit, a = ra, self.made[a][1]
            else:
                limit, b = rb + 1, self.made[b][0]

    def pretoken(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-token, given as byte letters with the marked end."""
        n, fits, matches = len(word), self.fits, self.automaton.iter_long
        out: list[int] = []
        dead: set[int] = set()  # positions from which no continuation fits
        at, before, token = 0, -1, next(matches(word))[1][0]
        while True:
            while token >= 0:
                stop = at + self.size[token]
                if stop not in dead and (before < 0 or (fits[before, token] if (before, token) in fits else self.compatible(before, token))):
                    break
                token = self.shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                at, before = stop, token
                if at == n:
                    return tuple(out)
                token = next(matches(word, at))[1][0]
            else:
                dead.add(at)
                last = out.pop()
                before = out[-1] if out else -1
                at -= self.size[last]
                token = self.shorter.get(last, -1)

    def pieces(self, raw: str) -> list[str]:
        """The pre-tokens of a run without white space, as byte letters with the
        end marked; a special token as itself."""
        out: list[str] = []
        for part in self.cut.split(raw) if self.cut and "<|" in raw else [raw]:
            if part in self.special:
                out.append(part)
            elif part.isascii() and part.isprintable():
                out += [p[:-1] + self.end[p[-1]] for p in _PLAIN.findall(part.lower())]
            elif part:
                out += [p[:-1] + self.end[p[-1]] for p, _ in self.outer.pre_tokenizer.pre_tokenize_str(self.outer.normalizer.normalize_str(part))]
        return out

    def ids_of(self, piece: str) -> tuple[int, ...]:
        special = self.special.get(piece)
        return self.pretoken(piece) if special is None else (special,)

    def piece(self, piece: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids as text, decoded text) of a piece, remembered: a full
        memory becomes the old one, from which what is asked for again is kept."""
        known = self.words.get(piece)
        if known is None:
            known = self.old.get(piece)
            if known is None:
                ids = self.ids_of(piece)
                known = (len(ids), " ".join([str(i) for i in ids]).encode(), self.decode(ids).encode())
            if len(self.words) >= CACHE_WORDS:
                self.old, self.words = self.words, {}
            self.words[piece] = known
        return known

    def word(self, raw: str) -> tuple[int, bytes, bytes]:
        """What piece() gives, of a run without white space."""
        got = [self.piece(p) for p in self.pieces(raw)]
        if len(got) == 1:
            return got[0]
        return sum([g[0] for g in got]), b" ".join([g[1] for g in got]), b" ".join([g[2] for g in got])

    def encode(self, text: str) -> list[int]:
        return [i for w in text.encode().split() for p in self.pieces(w.decode()) for i in self.ids_of(p)]

    def decode(self, ids) -> str:
        """Token texts, joined by a blank: the tokenizer names no decoder."""
        t, o = self.table, self.offset
        return " ".join([t[o[i] : o[i + 1]] for i in ids])


_held: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The encoder of a vocabulary; a Python worker keeps it for its next tasks."""
    if source not in _held:
        _held.clear()
        _held[source] = Encoder(source)
    return _held[source]


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no tokens and the digest of the empty string. A
    null id stays null; repeated rows give repeated results; other columns are
    not read. A task remembers at most CACHE_WORDS words.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(source.value)
        seen, old = enc.raw, enc.raw_old

        def learn(w: bytes) -> tuple[int, bytes, bytes]:
            nonlocal seen, old, get
            known = old.get(w) or enc.word(w.decode())
            if len(seen) >= CACHE_WORDS:
                old, seen = seen, {}
                enc.raw, enc.raw_old, get = seen, old, seen.get
            seen[w] = known
            return known

        get = seen.get
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1):
                h1, h2, count, lead = hashlib.sha256(), hashlib.sha256(), 0, b""
                # blocks of words bound the memory of a very long text
                words = (text.as_py() or "").encode().split()
                for a in range(0, len(words), 100_000):
                    got = [x for x in [get(w) or learn(w) for w in words[a : a + 100_000]] if x[0]]
                    if got:
                        h1.update(lead + b" ".join([x[1] for x in got]))
                        h2.update(lead + b" ".join([x[2] for x in got]))
                        lead = b" "
                        count += sum([x[0] for x in got])
                n.append(count)
                first.append(h1.hexdigest())
                second.append(h2.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
