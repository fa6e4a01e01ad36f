"""Shared pieces of the text operators: reading tables, scratch tables, and
vectorised word handling over Arrow buffers.

Texts reach Python tasks as Arrow batches. The helpers below work on the UTF-8
bytes of a batch with numpy, so no task holds one Python object per word, and a
task's memory follows its largest single text, not its partition.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once (a longer text is one step).
CHUNK_BYTES = 1 << 20
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = {"doc_id": "long", "conv_id": "long", "turn": "long", "vec_id": "long", "rep": "long", "text": "string", "role": "string", "lang": "string", "source": "string"}


def pick(df: DataFrame, **named: str) -> DataFrame:
    """The named columns alone, under fixed names and types: whatever else the input
    has (clashing names too) stays outside the operator."""
    return df.select(*[(F.col(f"`{c}`").cast(_TYPES[k]) if k in _TYPES else F.col(f"`{c}`")).alias(k) for k, c in named.items()])


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


# ---------------------------------------------------------------- scratch

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local master, where
    one machine is all there is (tests, benches), may do without: it gets a folder
    that goes with the process. A cluster that names none is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, read by column, and
    not lost with an executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- Arrow batches


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if not n or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `size` bytes, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, split: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text; len = texts + 1) of the runs of
    bytes outside `split`; a run never crosses a text's end."""
    return runs(~split[data], offsets)


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of each text) of the runs of True that no text's end crosses."""
    edge = np.zeros(len(keep) + 1, bool)
    edge[1:-1] = keep[1:] != keep[:-1]
    if len(keep):
        edge[0], edge[-1] = keep[0], keep[-1]
    inner = offsets[(offsets > 0) & (offsets < len(keep))]
    inner = inner[keep[inner] & keep[inner - 1]] if len(inner) else inner
    cuts = np.flatnonzero(edge)
    if len(inner):
        cuts = np.sort(np.concatenate([cuts, np.unique(inner), np.unique(inner)]))
    starts, ends = cuts[::2], cuts[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


_plane: list[np.ndarray] = []


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some texts' UTF-8, and the offset of each text in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def letters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: is it a letter; is it a letter or digit; its single-letter lower case."""
    if not _plane:
        chars = [chr(i) for i in range(0x10000)]
        _plane.append(np.array([c.isalpha() for c in chars]))
        _plane.append(np.array([c.isalnum() for c in chars]))
        _plane.append(np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32))
    near = np.minimum(points, 0xFFFF)
    alpha, alnum, lower = (t[near] for t in _plane)
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        alpha[far] = np.array([chr(x).isalpha() for x in kinds])[which]
        alnum[far] = np.array([chr(x).isalnum() for x in kinds])[which]
        lower[far] = points[far]
    return alpha, alnum, lower


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a word that are hashed by table; a longer word takes a cryptographic hash.
TABLED = 64
_tables: dict[int, np.ndarray] = {}


def _table(family: int) -> np.ndarray:
    """Random values by place and byte (TABLED x 256, flat)."""
    if family not in _tables:
        _tables[family] = mix(np.arange(TABLED * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([family + 1], np.uint64)))
    return _tables[family]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, families: int = 1) -> np.ndarray:
    """64-bit hash of each span of bytes, by `families` independent functions
    (spans, or families x spans); `fold` lower-cases A-Z.

    Tabulation: the sum of one random value per place and byte, so two different
    spans of up to TABLED bytes are alike with probability 2^-64 whatever their
    form; longer ones take BLAKE2b. Handled in pieces of about CHUNK_BYTES.
    """
    out = np.empty((families, len(starts)), np.uint64)
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK_BYTES, "right")) - 1)
        n = np.minimum(size[a:b], TABLED)
        begin = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(begin[-1], dtype=np.int32) - np.repeat(begin[:-1].astype(np.int32), n)
        letter = data[np.repeat(starts[a:b], n) + place]
        at = (place << 8) + (LOWER[letter] if fold else letter)
        run = np.zeros(len(at) + 1, np.uint64)
        for k in range(families):
            np.cumsum(_table(k)[at], out=run[1:])
            out[k, a:b] = mix(run[begin[1:]] - run[begin[:-1]] + size[a:b].astype(np.uint64))
        a = b
    for i in np.flatnonzero(size > TABLED):
        x = data[starts[i] : ends[i]]
        digest = hashlib.blake2b((LOWER[x] if fold else x).tobytes(), digest_size=8 * families).digest()
        out[:, i] = np.frombuffer(digest, "<u8")
    return out if families > 1 else out[0]


def crc_remainder(column: pa.Array, k: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(str(x).encode()) % k if x is not None else -1 for x in column.to_pylist()], np.int64)
