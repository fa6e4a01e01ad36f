"""Token files by round trip, filter audits and hard negatives against brute force; odd rows."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import audit, bpe, negatives, tokenfiles  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, start long, part string, mask int"


def docs(spark, rows):
    """(doc_id, text, source) with columns that clash with results."""
    return spark.createDataFrame([(i, t, "en", s, 7, "zz", 3) for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- token files


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    """Starts, counts and sums against the tokenizers library; small files, so that documents cross batches and files."""
    monkeypatch.setattr(tokenfiles, "BATCH", 2)
    monkeypatch.setattr(tokenfiles, "FILE_BATCHES", 2)
    r = random.Random(11)
    words = ["".join(r.choice("abcdeoé#漢") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = {i: " ".join(r.choices(words, k=r.choice([0, 1, 9, 80, 700]))) for i in r.sample(range(-50, 1000), 120)}
    manifest = tokenfiles.write(docs(spark, [(i, t, "s") for i, t in texts.items()]).repartition(3), str(tmp_path / "out"), sequence=16)
    got = {x.doc_id: x for x in tokenfiles.documents(spark, manifest).collect()}
    tok, at, run = bpe.encoder(bpe.read_vocabulary()).outer, 0, []
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        run.append(ids)
    run, done = np.concatenate(run), 0
    for row in manifest.orderBy("shard").collect():
        shard = tokenfiles.Shard(row.path, row.sequence, row.batch, row.file_batches)
        n = -(-row.n_ids // 16)
        ids, mask = (np.concatenate(x) for x in zip(*[(i.copy(), m.to_numpy(zero_copy_only=False)) for i, m in map(shard.sequence_at, range(n))], strict=True))
        assert (ids[: row.n_ids] == run[done : done + row.n_ids]).all() and not ids[row.n_ids :].any()
        assert mask[: row.n_ids].all() and not mask[row.n_ids :].any()
        assert sum(b.num_rows for b in shard.documents()) == row.n_docs
        done += row.n_ids
    assert done == len(run)


def test_memory_of_words_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokenfiles, "WORDS", 40)
    r, enc, tok = random.Random(3), tokenfiles.Remembered(bpe.read_vocabulary()), bpe.encoder(bpe.read_vocabulary()).outer
    words = ["".join(r.choice("abcßé漢1#\x01") for _ in range(r.randint(1, 6))) for _ in range(150)] + ["<|endoftext|>", "i'm"]
    for _ in range(60):
        texts = [r.choice(["", " ", "\n\x0b"]) + r.choice([" ", "\t", "\x1c", "\x85"]).join(r.choices(words, k=r.choice([0, 1, 5, 60]))) for _ in range(3)]
        ids, at = enc.encode(pa.array(["skipped", *texts], pa.string()).slice(1))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences_are_views_of_the_file(tmp_path):
    w = tokenfiles.ShardWriter(str(tmp_path / "s"), pa.uint16(), 64, 4, 3)
    ids = np.arange(3000, dtype=np.uint32)
    w.add(pa.array([5, 6], pa.int64()), ids, np.array([0, 1000, 3000]))
    w.close()
    shard = tokenfiles.Shard(str(tmp_path / "s"), 64, 4, 3)
    for k in (0, 3, 4, 11, 12, 30, 46):
        x, _ = shard.sequence_at(k)
        assert not x.flags.owndata and not x.flags.writeable
        n = min(64, 3000 - 64 * k)
        assert (x[:n] == ids[64 * k : 64 * k + n]).all()
    before = pa.total_allocated_bytes()
    held = [shard.sequence_at(k) for k in range(47)]
    assert pa.total_allocated_bytes() - before < 4096 and len(held) == 47
    assert (shard.ids(250, 1700) == ids[250:1950]).all()
    with pa.memory_map(str(tmp_path / "s-00000.arrow")) as f:
        assert pa.ipc.open_file(f).schema.field("ids").type == pa.list_(pa.uint16(), 64)


def test_token_files_odd_rows(spark):
    """Null ids first; null and empty texts are their end id; repeated rows and a hot id stay; an empty table has none."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, "b", None), (None, None, None), (3, "", "s"), (2, None, "s"), (5, long, "s"), *[(4, "same text", "s")] * 50, (4, "other", "s")]
    out = tokenfiles.documents(spark, tokenfiles.write(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    out.sort(key=lambda x: x.start)
    assert [x.doc_id for x in out] == [None, None, 2, 3, *[4] * 51, 5]
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(out))
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    assert [(x.n_tokens, x.ids_crc32) for x in out if x.doc_id in (2, 3)] == [(1, end)] * 2
    assert sorted(Counter(x.ids_crc32 for x in out if x.doc_id == 4).values()) == [1, 50]
    assert out[-1].n_tokens == len(bpe.encoder(bpe.read_vocabulary()).encode(long)) + 1
    assert tokenfiles.documents(spark, tokenfiles.write(docs(spark, []))).count() == 0


# ---------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    first, parts = {}, defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        words, fails = re.findall(r"[^\x20\x09-\x0D]+", t), ""
        fails += "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and first[t] < i)
        own = [x for x in labels if x[0] == i and i is not None]
        parts[s or ""].append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, Counter()
    for p, held in parts.items():
        for o in map("".join, itertools.permutations("ABCDE")):
            left = held
            for k, f in enumerate(o, 1):
                gone, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in held) - len(gone)
                out[p, o, k] = [len(kept), len(gone), redundant, sum(x[0] == f for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                total[p, f] += len(gone)
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    return {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in df.collect()}


def test_audit_matches_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choices(["one", "Two", "THREE", "four", "a#b", "x|", *[f"w{i}" for i in range(r.choice([3, 90]))]], k=r.choice([0, 10, 49, 50, 70, 200]))) for _ in range(60)]
    rows = [(i, r.choice(base), r.choice(["a", "b", None, ""])) for i in range(200)]
    # nulls, spaces, repeated ids and rows, a very long text, a letter of two bytes on the threshold
    rows += [(None, base[0], "a"), (None, None, None), (7, None, "a"), (9, " \t\x0b ", "b"), (9, " \t\x0b ", "b"), (300, "é" * 19 + "A", "a"), (301, "é" * 18 + "A", "a"), (302, "Word " * 40_000, "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 0), (None, 1, 1)]
    got = as_dict(audit.audited(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, labels)
    assert len(got) == 3 * 600


def test_audit_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(docs(spark, []), none).count() == 0
    rows = [(1, "x", None), (None, "x", None)]
    assert as_dict(audit.audited(docs(spark, rows), none)) == brute_audit(rows, [])
    two = audit.interactions(spark.createDataFrame([("p", 3, True, False), ("p", 1, False, True)], "part string, mask int, good boolean, toxic boolean"), "XY")
    assert as_dict(two) == {("p", "XY", 1): (0, 2, 0, 1, 1, 1, 3), ("p", "XY", 2): (0, 0, 1, 0, 0, 0, 1), ("p", "YX", 1): (1, 1, 0, 0, 1, 0, 1), ("p", "YX", 2): (0, 1, 1, 1, 0, 1, 3)}
    with pytest.raises(ValueError):
        audit.interactions(two, "ABCDEFG")


# ---------------------------------------------------------------- hard negatives


def brute_mined(rows, anchors, k, m):
    out, seen = [], {}
    for a in sorted(anchors, key=lambda x: (x[1], x[2])):
        seen.setdefault(a[0], a)
    for a in seen.values():
        scored = [(-sum(int(x) * int(y) for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2])]
        for p, (s, i, _) in enumerate(sorted(x for x in scored if x[2] == a[1])[:k], 1):
            fits = sorted(x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(a[0], i, p, n, x[1], -s, -x[0]) for n, x in enumerate(fits[:m], 1)]
    return sorted(out)


SHAPE = "vec_id long, label int, embedding array<double>, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*x, 0.5, 1) for x in rows], SHAPE)


def found(df):
    return sorted(tuple(x) for x in df.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_negatives_match_brute_force(spark, monkeypatch, block):
    """Many ties, equal and negative limits, one label with a third of the rows; small blocks and large."""
    monkeypatch.setattr(negatives.topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(negatives.topk, "CANDIDATE_BLOCK", 5 * block)
    monkeypatch.setattr(negatives.topk, "LEAST_BLOCK", 5 * block)
    r = random.Random(2)
    rows = [(i, r.choice([0, 0, 0, 1, 2, 3]), [float(r.randint(-3, 6)) for _ in range(r.choice([3, 3, 3, 2]))]) for i in range(160)]
    rows += [rows[5], rows[5], rows[10], (10, 3, [1.0, 1.0, 1.0])]
    v = negatives.prepared(table(spark, rows), scale=1)
    got = found(negatives.mined(v, v.filter("vec_id % 5 = 0"), 4, 3))
    assert got == brute_mined(rows, [x for x in rows if x[0] % 5 == 0], 4, 3)
    assert len(got) > 100


def test_negatives_odd_rows(spark):
    bad = [(None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [None]), (4, 1, [float("nan")]), (5, 1, [float("inf")]), (6, 1, [])]
    v = negatives.prepared(table(spark, bad))
    assert v.count() == 0 and negatives.mined(v, v).count() == 0
    v = negatives.prepared(table(spark, [*bad, (7, 1, [1.0])]))
    assert negatives.mined(v, v).count() == 0
    # huge components: scores stay whole numbers, clipped to 64 bits
    rows = [(1, 0, [2.0**31, 1.0]), (2, 0, [2.0**31, 0.0]), (3, 1, [2.0**30, 3.0]), (4, 1, [2.0**31 - 1, 0.0])]
    v = negatives.prepared(table(spark, rows), scale=1)
    assert found(negatives.mined(v, v.filter("vec_id = 1"))) == brute_mined(rows, rows[:1], 5, 3)


def test_limits_are_exact(spark):
    scores = [0, 1, 99, 100, 101, 199, 9_007_199_254_740_993, (1 << 63) - 1]
    df = spark.createDataFrame([(s,) for s in scores], "s long")
    got = df.select("s", negatives.limit(df.s, 95, False).alias("u"), negatives.limit(df.s, 50, True).alias("l")).collect()
    assert [(x.u, x.l) for x in got] == [(95 * x.s // 100, -(-50 * x.s // 100)) for x in got]
