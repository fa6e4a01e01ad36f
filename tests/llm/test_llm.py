"""Text operators against brute force, round trips and held-out accuracy; odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tidemark.llm import bpe, chat, common, langid, licenses, neardup, packing, quality, rules, topk, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, lang_pred string"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, lang="en"):
    """Documents with columns that clash with results."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 9.0, None, "zz") for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and a long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None,) * 8, (1, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1.0, True, ""), (3, " \n\t ", "en", "s", 4, 1.0, True, "")]
    return spark.createDataFrame([*rows, (4, "same text here", "en", "s", 1, 0.0, None, None), (4, "same text here", "en", "s", 1, 0.0, None, None), (4, "another text", None, "s", 1, 0.0, None, None), (5, long, "en", "s", 1, 0.0, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_odd_rows_and_empty_tables(spark):
    d, e, none = odd(spark), empty(spark), labels(spark, [(1, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)])
    for run in (rules.judged, neardup.grouped, langid.predictions, bpe.digests, licenses.scan, lambda x: toxicity.predictions(x, none), lambda x: quality.predictions(x, none)):
        assert run(d).count() == 8
        assert run(e).count() == 0
    assert packing.packed(e).count() == 0
    assert packing.packed(d).select("doc_id").distinct().count() == 6


def test_encoder_is_exact_and_round_trips():
    enc = bpe.encoder(bpe.read_vocabulary())
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij 'sdtre\tÉéΣσßİ́漢🙂123#$%&</w>\n!<|endoftext|> ") for _ in range(120)) for _ in range(150)]
    for t in [*texts, "", "I'm we'll", "<|startoftext|>x", "thethetheing", "a" * 3000]:
        ids = enc.outer.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids
        assert enc.decode(ids) == enc.outer.decode(ids, skip_special_tokens=False)


def test_digests(spark):
    enc = bpe.encoder(bpe.read_vocabulary())
    texts = ["Hello, World!", None, "", "ünïcode  ß 12"]
    for row in bpe.digests(docs(spark, texts)).collect():
        ids = enc.outer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(enc.outer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_keeps_every_id_once(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeo") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice([0, 3, 40, 900, 5000]))) for _ in range(60)]
    tok, by, seq = bpe.encoder(bpe.read_vocabulary()).outer, defaultdict(list), defaultdict(list)
    for p in packing.packed(docs(spark, texts)).collect():
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for i, t in enumerate(texts):
        ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == packing.WINDOW or at & (at - 1) == 0


def test_packing_lets_relatives_meet_across_shards(spark, monkeypatch):
    """Families of 8 documents among 24 shards' worth: frequencies are the corpus's, relatives share shards."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("bcdfghklmnprstvwxz") for _ in range(n))
    common, own = [word(4) for _ in range(60)], [[word(9) for _ in range(12)] for _ in range(60)]
    order = [k % 60 for k in range(480)]
    texts = [" ".join(r.choices(common, k=20) + own[k] * 2) for k in order]
    pieces = packing.packed(docs(spark, texts)).collect()
    shard = {p.doc_id: p.sequence_id >> 24 for p in pieces}
    assert len(set(shard.values())) > 12 and max(Counter(shard.values()).values()) < 100
    together = [Counter(shard[i] for i in range(480) if order[i] == k).most_common(1)[0][1] for k in range(60)]
    assert sum(together) / 480 > 0.8


def test_packing_asks_again_and_counts_the_corpus():
    """More than NEIGHBOURS short relatives are all used before a stranger that stands first."""
    ids = [np.array([7, 8, 9, 1])] + [np.array([30 + k, 31 + k]) for k in range(0, 40, 2)] + [np.array([7, 8, 200 + k]) for k in range(200)]
    df = np.bincount(np.concatenate([np.unique(p) for p in ids]))
    c = packing.Corpus(len(ids), sum(map(len, ids)), df)
    first = list(dict.fromkeys(k for w in packing.fill(ids, c) for k, _, _ in w))
    assert set(first[:201]) == {0, *range(21, 221)}
    rare = packing.Corpus(10**6, 3 * 10**6, np.where(np.arange(len(df)) == 8, 2, np.maximum(df, 10**5)))
    assert packing.Index(ids, rare).query[0][0] == 8


def test_bm25_matches_brute_force():
    """Scores of all pairs, and the order of neighbours, against the formula."""
    r = random.Random(14)
    ids = [np.array([r.choice([1, 2, 3, *range(10, 60)]) for _ in range(r.randint(1, 40))]) for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(p) for p in ids]), minlength=61)
    c = packing.Corpus(len(ids), sum(map(len, ids)), df)
    index = packing.Index(ids, c)
    mean = sum(map(len, ids)) / len(ids)

    def score(tokens, piece):
        total = 0.0
        for t in tokens:
            tf = int((piece == t).sum())
            idf = np.log(1 + (len(ids) - df[t] + 0.5) / (df[t] + 0.5))
            total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(piece) / mean))
        return total

    unused = np.ones(len(ids), bool)
    unused[::7] = False
    for k in range(len(ids)):
        tokens = index.query[k]
        assert set(tokens.tolist()) == {t for t in ids[k].tolist() if sum((p == t).any() for p in ids) > 1}
        weight = [score([t], ids[k]) for t in tokens]
        assert weight == sorted(weight, reverse=True)
        want = sorted((-round(score(tokens[: packing.QUERY], p), 9), i) for i, p in enumerate(ids) if unused[i])
        got = index.neighbours(k, unused).tolist()
        assert got == [i for s, i in want if s < 0][: packing.NEIGHBOURS]


def brute_groups(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_match_brute_force(spark):
    """A group of near copies edited more and more, chains, exact copies, short and empty texts."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = []
    for k in range(220):
        w = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain[k * 9] = word()
        texts.append(" ".join(chain))
    texts += [texts[3]] * 4 + ["a b c", "A  b\nc", "", None, "a b c d"] + [" ".join(word() for _ in range(30)) for _ in range(20)]
    comp, size = brute_groups(texts)
    got = {x.doc_id: x for x in neardup.grouped(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == size
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_hashes_tell_structured_words_apart(spark):
    """Thue-Morse words, which polynomial hashes modulo a power of two confuse, and long words that differ in one letter."""
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    words = [morse[:k] for k in (32, 64, 65, 1024, 2048)] + [morse[:k].translate(str.maketrans("ab", "ba")) for k in (32, 64, 65, 1024, 2048)]
    words += ["x" * 70 + c for c in "abc"] + ["q" * k for k in range(1, 80)]
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    h = common.span_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:], families=2)
    assert len(set(h[0].tolist())) == len(set(h[1].tolist())) == len(words)
    up = common.span_hashes(np.frombuffer(b"".join(raw).upper(), np.uint8), at[:-1], at[1:], fold=True, families=2)
    assert (up == h).all()
    got = {x.doc_id: x.component_id for x in neardup.grouped(docs(spark, [morse, morse.translate(str.maketrans("ab", "ba"))])).collect()}
    assert got == {0: 0, 1: 1}


def test_common_items_are_counted_exactly():
    one = np.array([[1, 2, 2, 5], [9, 3, 4, 0]], np.uint64)
    two = np.array([[1, 2, 2, 5], [9, 4, 7, 1]], np.uint64)
    assert neardup.in_common(one, two) == 2
    assert neardup.in_common(one[:, [0, 1, 3]], two[:, [0, 1, 3]]) == 1


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    one, two = x[:1000], x[150:1150]
    reg = lambda s: neardup.registers(s, np.array([0, len(s)]))
    assert (np.maximum(reg(one), reg(two)) == reg(np.union1d(one, two))).all()
    j = neardup.estimate(reg(one), reg(two), np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(j - 850 / 1150) < 0.2


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    r = random.Random(2)
    vec = lambda: [r.choice([-0.5, 0.0, 0.25, 0.4]) for _ in range(4)]
    rows = [(i, vec()) for i in range(0, 400)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan"), 0.0, 0.0, 0.0]), (450, [0.1, 0.2])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows[:400]}
    want = set()
    for i in range(0, 400, 50):
        best = sorted((-sum(a * b for a, b in zip(q[i], v, strict=True)), j) for j, v in q.items() if j != i)[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(x) for x in got} == want
    few = topk.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert [x.rank for x in sorted(few)] == [1, 2]
    assert topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_is_exact_at_any_size(spark):
    """Components near 1e6, 1e9, 1e30 and beyond double's integers, negative ones, clashing columns, repeats."""
    r = random.Random(6)
    sizes = [1.0, 1.0, 1e4, 1e6, 1e9, 1e15, 1e30]
    rows = [(i, [r.uniform(-1, 1) * r.choice(sizes) for _ in range(3)], i, "x", 0.5, -1) for i in range(260)]
    rows += [(500, [1e6 + 1, 1e6, 1e6], 0, "", 0.0, 0), (501, [1e6, 1e6, 1e6 + 1], 0, "", 0.0, 0), (501, [1e6, 1e6, 1e6 + 1], 0, "", 0.0, 0), (550, [1.7e308, 1.0, 1.0], 0, "", 0.0, 0)]
    rows += [(None, [1.0, 1.0, 1.0], None, None, None, None), (600, [], None, None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id long, q string, score double, rank int")
    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if i is not None and i < 550]
    want = Counter()
    for i, v in q:
        if i % 50 == 0:
            clip = lambda s: max(-topk.TOP, min(topk.TOP, s))
            best = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in q if j != i)[:5]
            want += Counter((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    assert Counter(tuple(x) for x in topk.nearest(frame).collect()) == want


def test_chat_round_trip(spark):
    bits = ["\\", "###", "</turn>", ":", "\n", "### Assistant: ", "a", "#", "<", "</tur"]
    r = random.Random(4)
    for _ in range(500):
        role, body = ("".join(r.choices(bits, k=r.randint(0, 5))) for _ in range(2))
        out = chat.render_turn(role, body) + chat.render_turn("user", body)
        one = chat.read_turn(out)
        assert one[:2] == (role, body)
        assert chat.read_turn(out, one[2]) == ("user", body, len(out))
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    got = {x.conv_id: x for x in chat.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert (got[2].n_turns, got[2].loss_chars, got[None].n_turns, got[-7].n_turns) == (2, 2, 1, 2)


def test_chat_odd_tables(spark):
    """Very long texts, clashing columns, an empty table; the mask spans the assistant's texts alone."""
    shape = "conv_id long, turn int, role string, text string, rendered string, n_turns int, loss_start string"
    long = "### </turn> \\ " * 120_000
    rows = [(1, 0, "user", long, "r", 5, "x"), (1, 1, "assistant", long, None, None, None), (1, 2, "tool</turn>: ###", "t", None, None, None)]
    t = spark.createDataFrame(rows, shape)
    got = {x.conv_id: x for x in chat.formatted_conversations(t).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x, *_ in rows).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    spans = [(x.loss_start, x.loss_end and x.rendered[x.loss_start : x.loss_end]) for x in chat.formatted(t).orderBy("turn").collect()]
    assert spans[0] == spans[2] == (None, None) and spans[1][1] == chat.escaped(long, chat.BODY)
    assert [x.conv_id for x in chat.formatted_conversations(spark.createDataFrame([], shape)).collect()] == [-7]


def test_rules_base_counts(spark):
    texts = ["a b c d e f a b c d e x", "l one\nl one\n\nl one", "#*$ x", None, ""]
    got = {x.doc_id: x for x in rules.judged(docs(spark, texts)).collect()}
    w = texts[0].split()
    seen, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    assert got[0].n_repeat_words == len(cover) == 10
    assert (got[1].n_dup_lines, got[2].n_symbols, got[2].word_chars, got[3].n_words) == (2, 3, 4, 0)
    assert got[3].base_failed and not got[3].kept


def test_license_scan_finds_reordered_and_partial_notices(spark):
    texts = ["x\nLicense MIT the under released!", "Released under the MIT License.", "permission granted free of charge", "general public\nlicense mit license", None]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, texts)).collect()}
    assert (got[0].base_labels, got[0].labels) == ("", "mit")
    assert (got[1].labels, got[1].first_word, got[1].n_base) == ("mit", 3, 1)
    assert got[2].labels == ""
    assert (got[3].base_labels, got[3].n_base, got[3].first_word, got[3].last_word) == ("gpl,mit", 2, 0, 3)


def test_license_scan_finds_wrapped_notices(spark):
    texts = [
        "int x;\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the x)\n",
        "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions\n// are met:",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is\nhereby granted",
        " ".join(w + " and so it went on until the evening of a long day" for w in "this is free and unencumbered software released into the public domain".split()),
    ]
    r = random.Random(9)
    vocabulary = [*{w for ws in licenses.template_words(licenses.TEMPLATES).values() for w in ws}]
    for t in [*licenses.TEMPLATES] * 6:
        w = t.split()
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice([*vocabulary, "other"])
        for _ in range(r.randint(0, 6)):
            w.insert(r.randrange(len(w) + 1), r.choice([*vocabulary, "other", "\n"]))
        texts.append(" ".join([*r.choices([*vocabulary, "other"], k=30), *w, *r.choices([*vocabulary, "\n"], k=30)]))
    want = []
    for t in texts:
        w, labels, best = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()), set(), 0.0
        for template, ws in licenses.template_words(licenses.TEMPLATES).items():
            n = -(-len(template.split()) * 100 // licenses.THRESHOLD)
            c = max(len(set(w[i : i + n]) & set(ws)) for i in range(len(w)))
            if 100 * c >= licenses.THRESHOLD * len(ws):
                labels.add(licenses.TEMPLATES[template])
                best = max(best, c / len(ws))
        want.append((labels, best))
    got = {x.doc_id: x for x in licenses.scan(docs(spark, texts)).collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(texts)), "text": texts}))
    for x in con.sql(licenses.SQL).to_arrow_table().to_pylist():
        assert x == got[x["doc_id"]].asDict() | {"score": pytest.approx(got[x["doc_id"]].score)}
    assert [got[i].labels for i in range(4)] == ["mit", "bsd", "isc", ""]
    for i, (labels, best) in enumerate(want):
        base = {x for x in got[i].base_labels.split(",") if x}
        assert {x for x in got[i].labels.split(",") if x} == labels | base
        assert got[i].score == (1.0 if base else pytest.approx(best))


def test_viterbi_matches_brute_force():
    """The best of all paths, for short texts."""
    r = np.random.default_rng(5)
    for _ in range(40):
        s = r.normal(0, 12, (r.integers(1, 7), 3))
        cost = lambda p: s[np.arange(len(s)), p].sum() - langid.SWITCH * (np.diff(p) != 0).sum()  # noqa: B023, E731
        best = max(cost(np.array(p)) for p in itertools.product(range(3), repeat=len(s)))
        assert cost(langid.viterbi(s)) == pytest.approx(best)


def test_word_scores_are_sums_of_gram_weights():
    """Words, scripts and n-gram sums of a mixed text against a plain version."""
    text = "Hello ΣΟΦΙΑ дом🙂 \U00010400\U00010428x 12a é"
    w = langid.words_of(*buffers([text, "", "zwei Wörter"]))
    words = re.findall(r"[^\W\d_]+", text) + ["zwei", "Wörter"]
    whole = text + "zwei Wörter"
    assert [whole[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == words
    assert w.first.tolist() == [0, len(words) - 2, len(words) - 2, len(words)]
    assert [langid.SCRIPTS[k] for k in w.script] == ["latin", "greek", "cyrillic", "other", "latin", "latin", "latin", "latin"]
    r = np.random.default_rng(2)
    weights = r.normal(size=(langid.BUCKETS + 1, 2)).astype(np.float32)
    weights[-1] = 0
    model = langid.Model(["a", "b"], weights, np.ones((len(langid.SCRIPTS), 2), bool))
    got = model.scores(w)
    for k, (a, b) in enumerate(zip(w.starts, w.ends, strict=True)):
        want = sum(weights[g[i]] for g in w.inner for i in range(a, b)) + sum(weights[e[k]] for e in w.edges)
        assert got[k] == pytest.approx(want, abs=1e-3)
    # n-grams stay inside their word: of a word of n letters, n ones, n - 1 pairs, n - 2 triples
    sizes = w.ends - w.starts
    assert [int((g < langid.BUCKETS).sum()) for g in w.inner] == [int(np.maximum(sizes - k, 0).sum()) for k in range(3)]


def test_paths_equal_viterbi():
    r = np.random.default_rng(3)
    sizes = [1, 2, 30, 200, 80, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = r.normal(0, 6, (first[-1], 3))
    s[40:90, 1] += 9
    path, _ = langid.paths(s, first)
    cost = lambda p, x: x[np.arange(len(x)), p].sum() - langid.SWITCH * (p[1:] != p[:-1]).sum()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert cost(path[a:b], s[a:b]) == pytest.approx(cost(langid.viterbi(s[a:b]), s[a:b]))


def test_language_spans(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.trained(d)
    en, de = (d.filter(f"lang = '{x}' AND n_chars BETWEEN 900 AND 4000").orderBy("doc_id").first().text[:600] for x in ("en", "de"))
    row = langid.labelled(docs(spark, [en + " " + de]), model).first()
    assert {x.lang for x in row.spans} == {"en", "de"}
    p = langid.predictions(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert p.filter("lang = lang_pred").count() / p.count() > 0.9


def test_pipeline_keeps_clean_mixed_texts(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.trained(d)
    monkeypatch.setattr(langid, "trained", lambda docs: model)
    # a little more of the first, so that the main language's lead is small
    part = [d.filter(f"lang = '{x}' AND n_chars BETWEEN 900 AND 4000").orderBy("doc_id").first().text for x in model.langs[:3]]
    two, three = part[0][:410] + " " + part[1][:400], " ".join(p[:300] for p in part)
    texts = [two, three, " ".join([three] * 3), part[0], None, "", "12 34 !"]
    got = {x.doc_id for x in pipeline.language(spark, docs(spark, texts), SF).collect()}
    assert got == {0, 1, 2, 3}
    blank = langid.Model(model.langs, np.zeros_like(model.weights), np.ones_like(model.uses))
    monkeypatch.setattr(langid, "trained", lambda docs: blank)
    assert pipeline.language(spark, docs(spark, texts), SF).count() == 0


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_levenshtein_automaton_matches_brute_force():
    """Exact, near and short entries, stems, accented and Cyrillic letters, against edit distances."""
    entries = [("idiot", 0), ("moron", 0), ("scum", 0), ("ass", 0), ("gruml", 5), ("défaut", 6), ("дурак", 0), ("crétin", 0), ("grub", 4)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def brute(w):
        marks = []
        for term, kind in entries:
            near = distance(w, term) <= 1 if not kind else any(distance(w[:k], term) <= 1 for k in range(len(w) + 1))
            if w == term or (kind and w.startswith(term)):
                marks.append(toxicity.EXACT)
            elif near:
                sure, short = (toxicity.FUZZY_STEM, toxicity.SHORT_STEM) if kind else (toxicity.FUZZY_WORD, toxicity.SHORT_WORD)
                marks += [toxicity.MISSPELT] if len(term) >= sure else [toxicity.IN_CONTEXT] if len(term) >= short else []
        return min(marks, default=0)

    r = random.Random(12)
    words = ["Idiot", "idi0t", "idit", "iidiot", "idiots", "idots", "scun", "as", "asse", "ДУРАК", "дурок", "cretin", "CRÉTIN", "defauts", "dfaut", "défaux", "grumling", "grulm", "moronic", "mron", "x"]
    for term, _ in entries * 40:
        w = list(term)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choices("adeioémт", k=r.randint(0, 1))
        words.append("".join(w) + r.choice(["", "", "en", "s"]))
    words = [w for w in words if w and w[0].isalpha()]
    t = toxicity.tokens(*buffers([" ".join(words)]))
    got = toxicity.matches(toxicity.automaton(entries), t.lower, t.starts, t.ends)
    assert [t.word(k) for k in range(len(t.starts))] == [w.lower() for w in words]
    assert got.tolist() == [brute(w.lower()) for w in words]


def test_toxic_context():
    """Quotation needs a pair of marks or a reporting word; letters are no marks in any language."""
    m = toxicity.automaton([("idiot", 0), ("scum", 0)])
    cases = [
        ("Über alles idiot nach Übung", False), ("goût noël idiot goût noël", False), ("er rief „Sie idiot dort“ laut", True), ("il cria « pauvre idiot » hier", True),
        ("sie rief »ein idiot« laut", True), ("she shouted “what an idiot” there", True), ('a "big idiot" there', True), ('5" pipes and an idiot with 6" pipes', False),
        ("“ never closed idiot", False), ("he said idiot", True), ("idiot", False), ("“" + "x " * 300 + "idiot”", False),
    ]
    doc, start, end, misspelt, quoted, _ = toxicity.hits(m, *buffers([t for t, _ in cases]))
    assert doc.tolist() == list(range(len(cases)))
    assert quoted.tolist() == [q for _, q in cases]
    assert [t[a:b] for (t, _), a, b in zip(cases, start, end, strict=True)] == ["idiot"] * len(cases)
    # marks around a word, however many; a short word's near form only in context
    texts = ["*" * 10 + "idiot", "*" * 70 + "idiot" + "'" * 90, "***", "", "the scun", "you scun", "idiot and scun", "idio"]
    found = toxicity.hits(m, *buffers(texts))
    assert Counter(found[0].tolist()) == {0: 1, 1: 1, 5: 1, 6: 2, 7: 1}
    assert found[5].tolist() == [False, False, True, False, False, False]


def held_out(spark, run, column, sf):
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = run(d, l).join(l, "doc_id").filter("held_out").select("score", "predicted", F.col(column).alias("y")).filter("y IS NOT NULL").collect()
    one, zero = [x.score for x in rows if x.y == 1], [x.score for x in rows if x.y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))
    return auc, sum(x.predicted for x in rows if x.y == 1) / len(one), sum(1 - x.predicted for x in rows if x.y == 0) / len(zero)


def test_classifiers_hold_out(spark):
    """Area under the curve, and the share found of either class: no constant answer passes."""
    auc, found, left = held_out(spark, quality.predictions, "quality", "/root/testdata/sf0.01")
    assert auc > 0.95 and found > 0.9 and left > 0.7
    auc, found, left = held_out(spark, toxicity.predictions, "toxic", "/root/testdata/sf0.1")
    assert auc > 0.95 and found > 0.85 and left > 0.97


def test_features_are_hashed_n_grams():
    """The sparse vector of a text equals a plain count of its words, pairs, shapes and repeats."""
    texts = ["The cat sat. The cat sat on 12 Mats mats", "", "one", "a a a"]
    d, f, v = quality.features(*buffers(texts))
    one = lambda words: common.span_hashes(*_spans(words), fold=True)
    shape_of = lambda w: re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in w))

    def _spans(words):
        raw = [w.encode() for w in words]
        at = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]

    for i, t in enumerate(texts):
        w, count = t.split(), Counter()
        if w:
            h, s = one(w), common.span_hashes(*_spans([shape_of(x) for x in w]))
            low, pairs = [x.lower() for x in w], list(zip(w[:-1], w[1:], strict=True))
            two = common.mix(h[:-1] * np.uint64(3) + h[1:])
            grams = [(1, h), (2, two), (3, s), (4, common.mix(s[:-1] * np.uint64(5) + s[1:]))]
            lowp = [(a.lower(), b.lower()) for a, b in pairs]
            grams += [(5, np.array([11 + (p in lowp[:k]) for k, p in enumerate(lowp)], np.uint64)), (6, np.array([13 + (x in low[:k]) for k, x in enumerate(low)], np.uint64)), (7, np.array([15 + (a == b) for a, b in lowp], np.uint64))]
            for k, x in grams:
                count.update((common.mix(x + np.uint64(k)) & np.uint64(quality.DIMENSIONS - 1)).tolist())
        at = d == i
        assert dict(zip(f[at].tolist(), v[at].tolist(), strict=True)) == pytest.approx({k: (n / max(len(w), 1)) ** 0.5 for k, n in count.items()})


def test_ftrl_matches_the_published_updates():
    """Per-coordinate FTRL-proximal, written out one coordinate at a time."""
    r = random.Random(4)
    model, z, n = quality.Ftrl(6), [0.0] * 6, [0.0] * 6

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(300):
        at = sorted(r.sample(range(6), 3))
        x, y = [r.random() for _ in at], float(0 in at)
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, xi, wi in zip(at, x, w, strict=True):
            g = (p - y) * xi
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
            z[i] += g - sigma * wi
            n[i] += g * g
        model.learn(np.array(at), np.array(x), y, 1.0)
    assert model.weights(slice(None)) == pytest.approx([weight(i) for i in range(6)])
    assert weight(0) > 0


def test_rules_match_brute_force(spark):
    """Groups far below and above PRIOR; each metric rejects a text that the base rule passes."""
    r = random.Random(21)
    word = lambda n=6: "".join(r.choice("abcdefgh") for _ in range(n))
    plain = lambda: "\n".join(" ".join(word() for _ in range(10)) for _ in range(5))
    rows = [(f"b{k}", plain(), "en", "big") for k in range(450)] + [(f"s{k}", plain() + " #" * k, "en", "small") for k in range(12)]
    phrase, line = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(4))
    bad = {
        "symbols": plain() + " ###### $$$$$$ %%%%%% ######" * 3,
        "repeats": " ".join([phrase, *[word() for _ in range(70)], phrase]),
        "lines": "\n".join([line, *[word() for _ in range(3)], *[line.split()[k] for k in (0, 0, 0, 1, 1, 1, 2, 2, 2)]]),
        "length": " ".join(word(30) for _ in range(40)),
    }
    rows += [(k, t, "en", s) for k, t in bad.items() for s in ("big", "small")] + [("o", plain(), None, None), ("o", plain(), "de", None), ("long", "x" * 9000 + " y" * 30, "en", "big")]
    table = spark.createDataFrame([(i, t, l, s) for i, (_, t, l, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    metrics = []
    for _, t, _, _ in rows:
        w, lines = t.split(), [x for x in t.split("\n") if x.split()]
        seen, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                cover |= set(range(i, i + 5))
        chars, tenths = sum(map(len, w)), 10 * sum(map(len, w)) // len(w)
        tenths -= tenths % next((g for least, g in reversed(rules.COARSE.items()) if tenths >= least), 1)
        metrics.append({"symbols": 1000 * sum(t.count(c) for c in "#*$%&|<>") // chars, "repeats": 1000 * len(cover) // len(w), "lines": 1000 * (len(lines) - len(set(lines))) // len(lines), "length": tenths, "words": len(w), "covered": len(cover)})

    def quantile(values, q):
        return sorted(values)[-(-len(values) * q // 100) - 1]

    want = []
    for (_, _, lang, source), m in zip(rows, metrics, strict=True):
        own, merged = ([x for (_, _, l, s), x in zip(rows, metrics, strict=True) if l == lang and (s == source or not same)] for same in (True, False))
        ok = m["words"] >= 10 and not 100 * m["covered"] > 20 * m["words"]
        for k, least in rules.METRICS.items():
            a, mid, b, far = ((len(own) * quantile([x[k] for x in own], q) + rules.PRIOR * quantile([x[k] for x in merged], q)) // (len(own) + rules.PRIOR) for q in (25, 50, 75, 99))
            ok &= not (m["words"] >= least and m[k] > max(b + rules.SPREAD * (b - a), mid + (far - mid) // rules.REACH))
        want.append(ok)
    got = {x.doc_id: x for x in rules.judged(table).collect()}
    assert [got[i].kept for i in range(len(rows))] == want
    for i, (name, *_) in enumerate(rows):
        assert not (name in bad and (got[i].kept or got[i].base_failed)), name
    assert sum(want) > 400


def test_cutoffs_differ_between_groups(spark):
    """Each source's cutoffs follow its own texts: one with many signs, one with long words, one plain."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    text = {"signs": lambda: " ".join(word(5) + "#" * r.choice([0, 0, 1]) for _ in range(60)), "long": lambda: " ".join(word(r.randint(9, 15)) for _ in range(60)), "plain": lambda: " ".join(word(5) for _ in range(60))}
    rows = [(i, text[s](), "en", s) for i, s in enumerate([*text] * 400)]
    f = rules.base_features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    cut = {x.ks: x for x in rules.cutoffs(f).collect()}
    assert cut["signs"].cut_symbols > cut["plain"].cut_symbols + 50
    assert len({x.cut_length for x in cut.values()}) == 3


def test_rules_join_many_groups_by_salted_keys(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(rules.judged(d).collect())
    monkeypatch.setattr(rules, "BROADCAST", 0)
    assert sorted(rules.judged(d).collect()) == one


def test_licenses_fold_only_a_to_z(spark):
    got = licenses.scan(docs(spark, ["MIT LICENSE", "mit LI\u0307CENSE", "\u212Aelvin MIT License"])).collect()
    assert [x.n_base for x in sorted(got)] == [1, 0, 1]


def test_pipeline_is_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    n = d.count()
    for name, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, SF).cache()
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert d.count() <= n, name
        n = d.count()
    pieces = pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == n
    o = odd(spark)
    for _, stage in pipeline.STAGES:
        stage(spark, o, SF).count()


def test_packing_merges_new_words_together_as_the_tokenizer_does(monkeypatch):
    source = bpe.read_vocabulary()
    t, r = packing.Tokens(source), random.Random(8)
    words = ["".join(r.choice("aehinorstß éñ'&#.7"[: r.randint(3, 18)]) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts = [*words, "thththth" * 8, "a" * 64, "é" * 32, "&" * 64, "", "  x\t\n y ", "The theatre"]
    want = [[*t.outer.encode(x, add_special_tokens=False).ids, packing.END] for x in texts]
    # words of letters, digits and signs need no call of the tokenizer
    monkeypatch.setattr(t, "ids", None)
    ids, at = t.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_packing_leaves_long_and_other_words_to_the_tokenizer():
    t = packing.Tokens(bpe.read_vocabulary())
    texts = ["a" * 65, "ab" * 500 + "!", "İstanbul ŁÓDŹ", "x\x01y", "<|endoftext|>a", "日本", "é" * 33]
    ids, at = t.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*t.outer.encode(x, add_special_tokens=False).ids, packing.END] for x in texts]
