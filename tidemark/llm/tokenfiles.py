"""Token ids as Arrow files with random access.

A corpus is written as shards, one per Spark partition, in ascending order of ids.
A shard's ids are one run, cut into sequences of equal length. Its files are in the
Arrow file format (a stream of record batches, then a footer with their places); a
row of `ids` and of `mask` is a fixed-size list, so sequence k lies at a place that
arithmetic gives and is read from a memory map without a copy. The last sequence of a
shard is filled up with zeros; `mask` holds a bit per place, set where an id is. Ids take
two bytes where the vocabulary allows, else four.

Beside them lies the shard's document file: doc_id, start in the shard, n_tokens.

Tasks write files under names of their own attempt and return their shard's row of the
manifest, which Spark commits: a lost or repeated task leaves at most files that no
manifest names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import read_vocabulary
from tidemark.llm.common import pick, scratch_dir, steps, text_buffers, written
from tidemark.llm.packing import Ids, Tokens

#: Ids of a sequence; sequences of a record batch; record batches of a file.
SEQUENCE, BATCH, FILE_BATCHES = 2048, 256, 16
#: Id that ends a document here.
END = 2
#: Documents of a record batch of the document file.
DOCS = 8192
#: Bytes of text encoded at once (a longer text is one step).
STEP_BYTES = 1 << 22
#: Words that a generation of a worker's memory holds, at most; their bytes, at most.
WORDS, WORD_BYTES = 250_000, 1 << 25

_MANIFEST = "shard int, path string, n_files int, n_docs long, n_ids long, sequence int, batch int, file_batches int"
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path)


def width(vocabulary: str) -> pa.DataType:
    """Type of the ids of a tokenizer file (its JSON text)."""
    model = json.loads(vocabulary)
    most = max([*model["model"]["vocab"].values(), *[t["id"] for t in model["added_tokens"]], END])
    return pa.uint16() if most < 1 << 16 else pa.uint32()


class Remembered(Tokens):
    """Ids of texts, each word encoded once. A full memory becomes the old one, from which
    what is asked for again is taken over; so words that recur stay."""

    def clear(self) -> None:
        super().clear()
        self.old = Ids()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another; offsets). No text is null."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
        index = np.fromiter(map(self.words.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            if len(self.words) + len(missing) > WORDS or self.words.held > WORD_BYTES:
                self.old, self.words = self.words, Ids()
                missing = np.arange(len(words))
            if len(self.pieces) > WORDS or self.pieces.held > WORD_BYTES:
                kept = self.words, self.old
                self.clear()
                self.words, self.old = kept
            known, new = self.old.known, [words[i] for i in missing]
            again = [w for w in new if w in known]
            if again:
                ids, upto = self.old.gather(self.old.index(again))
                self.words.add(again, ids, np.diff(upto))
            self.learn([w for w in new if w not in known])
            index[missing] = self.words.index(new)
        ids, upto = self.words.gather(index[coded.indices.to_numpy()])
        at = split.offsets.to_numpy()
        return ids, upto[at - at[0]]


_held: dict[str, Remembered] = {}


def remembered(source: str) -> Remembered:
    """The encoder of a vocabulary; a Python worker keeps it for its next tasks."""
    if source not in _held:
        _held.clear()
        _held[source] = Remembered(source)
    return _held[source]


def ended(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each document's, and their offsets."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


class ShardWriter:
    """Writes one shard: runs of ids, and the documents they are made of. Holds at most a
    record batch and the run it is given."""

    def __init__(self, path: str, kind: pa.DataType, sequence: int = SEQUENCE, batch: int = BATCH, file_batches: int = FILE_BATCHES):
        self.path, self.sequence, self.batch, self.file_batches = path, sequence, batch, file_batches
        self.fs, self.place = located(path)
        self.fs.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.kind = kind
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.ids = np.zeros(batch * sequence, kind.to_pandas_dtype())
        self.held = self.n_ids = self.n_docs = self.n_files = self.in_file = 0
        self.out = self.sink = None
        self.doc_sink = self.fs.open_output_stream(f"{self.place}-docs.arrow")
        self.doc_out = pa.ipc.new_file(self.doc_sink, _DOCUMENTS)
        self.docs: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents whose ids follow one another, document i at offsets[i] to offsets[i + 1]."""
        size = np.diff(offsets)
        self.docs.append((doc_ids, self.n_ids + offsets[:-1], size))
        if sum(len(d[0]) for d in self.docs) >= DOCS:
            self._write_docs()
        at, full = 0, len(self.ids)
        while at < len(ids):
            n = min(full - self.held, len(ids) - at)
            self.ids[self.held : self.held + n] = ids[at : at + n]
            self.held, at = self.held + n, at + n
            if self.held == full:
                self._write(self.batch)
        self.n_ids += len(ids)
        self.n_docs += len(size)

    def _write_docs(self) -> None:
        ids, start, size = zip(*self.docs, strict=True)
        self.doc_out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(start)), pa.array(np.concatenate(size))], schema=_DOCUMENTS))
        self.docs = []

    def _write(self, rows: int) -> None:
        if self.out is None:
            self.sink = self.fs.open_output_stream(f"{self.place}-{self.n_files:05d}.arrow")
            self.out, self.in_file = pa.ipc.new_file(self.sink, self.schema), 0
            self.n_files += 1
        n = rows * self.sequence
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (self.ids[:n], np.arange(n) < self.held)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.in_file, self.held = self.in_file + 1, 0
        self.ids[:] = 0
        if self.in_file == self.file_batches:
            self._end()

    def _end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.sink.close()
            self.out = None

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.sequence))
        self._end()
        if self.docs:
            self._write_docs()
        self.doc_out.close()
        self.doc_sink.close()


class Shard:
    """Random access to one shard by its manifest row. Local files are memory maps."""

    def __init__(self, path: str, sequence: int, batch: int, file_batches: int):
        self.sequence, self.batch, self.file_batches = sequence, batch, file_batches
        self.fs, self.place = located(path)
        self.at: tuple[int, object] = (-1, None)
        self.got: tuple[int, np.ndarray | None, pa.BooleanArray | None] = (-1, None, None)

    def _open(self, name: str):
        path = f"{self.place}-{name}.arrow"
        return pa.ipc.open_file(pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path))

    def documents(self) -> Iterator[pa.RecordBatch]:
        file = self._open("docs")
        for k in range(file.num_record_batches):
            yield file.get_batch(k)

    def _batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of record batch k of the shard, as views."""
        if self.got[0] != k:
            f = k // self.file_batches
            if self.at[0] != f:
                self.at = (f, self._open(f"{f:05d}"))
            b = self.at[1].get_batch(k % self.file_batches)
            self.got = (k, b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten())
        return self.got[1], self.got[2]

    def sequence_at(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence k, as views of the file."""
        ids, mask = self._batch(k // self.batch)
        a = k % self.batch * self.sequence
        return ids[a : a + self.sequence], mask.slice(a, self.sequence)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids of the shard's run; a view unless they lie in several record batches."""
        size, parts = self.batch * self.sequence, []
        while n > 0:
            ids, a = self._batch(start // size)[0], start % size
            parts.append(ids[a : a + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


def write(docs: DataFrame, root: str | None = None, vocabulary: str | None = None, end: int = END, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts' ids, each text's ended by `end`, and returns the manifest, a row
    per shard (its number is its place in the order), written to the shared folder.

    Order: ascending doc_id, null ids first, then a hash of the text; rows alike in both
    stand in any order. A null or empty text is its end id alone. Repeated rows are
    written each; a hot id's rows are split over shards. An empty table has no shard.
    Other columns are not read.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind, root = width(source.value), root or f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    batch, file_batches = BATCH, FILE_BATCHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, shard = remembered(source.value), None, TaskContext.get().partitionId()
        path = f"{root}/{shard:07d}-{uuid.uuid4().hex}"
        for rows in batches:
            texts = rows.column(1).fill_null("")
            for a, b in steps(text_buffers(texts)[1], STEP_BYTES):
                out = out or ShardWriter(path, kind, sequence, batch, file_batches)
                ids, at = ended(*enc.encode(texts.slice(a, b - a)), end)
                out.add(rows.column(0).slice(a, b - a), ids, at)
        if out:
            out.close()
            row = [shard, path, out.n_files, out.n_docs, out.n_ids, sequence, batch, file_batches]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    # the last key tells rows alike apart, so that many of one id don't share a partition
    order = ["doc_id", "_h", "_i"]
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns({"_h": F.xxhash64("text"), "_i": F.monotonically_increasing_id()})
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, _MANIFEST))


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`: ids of all shards before (a row per shard is all that meets here)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files of a
    manifest. An empty manifest has no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in batches:
            for row in shards.to_pylist():
                shard = Shard(row["path"], row["sequence"], row["batch"], row["file_batches"])
                for d in shard.documents():
                    start, size = d.column(1).to_numpy(), d.column(2).to_numpy()
                    sums = [zlib.crc32(shard.ids(a, n).astype("<u4", copy=False)) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(start + row["base"]), d.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return placed(manifest).repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
