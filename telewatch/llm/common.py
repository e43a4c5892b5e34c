"""Helpers shared by the operators: reading tables, Arrow text as bytes, words and hashes of whole batches in numpy."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000  # rows of text that a task holds at once; the longest texts decide its memory


def prepare(spark: SparkSession) -> None:
    """Times are UTC, and Arrow batches stay small however long the texts are."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold_of(key: str, folds: int):
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch; a result of None is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, longer by as many underscores as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_lots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches with rows, put together up to about `size` bytes."""
    held, held_size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            held_size += batch.nbytes
        if held_size > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def kept_in_process(name: str, make: Callable):
    """What `make` gives, made once per worker process: later tasks of the same process find it again."""
    place = sys.modules.setdefault("telewatch_llm_kept", types.ModuleType("telewatch_llm_kept"))
    if not hasattr(place, name):
        setattr(place, name, make())
    return getattr(place, name)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 offsets; null counts as empty."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


# words --------------------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte, from a fixed rule."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base & (2 ** 64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the text that it belongs to. Words end at white space and with their text."""
    letter = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = letter[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = letter[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(letter & ~after) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, owner


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, by differences of one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, step = np.empty(len(starts), np.uint64), 1 << 22
    table = byte_table(seed)[_LOWER] if lower else byte_table(seed)
    first = 0
    while first < len(starts):  # in stretches of some MB, so that the sums stay small
        low = int(starts[first])
        last = max(int(np.searchsorted(ends, low + step, "right")), first + 1)
        piece = data[low:int(ends[last - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * powers(_PRIME, len(piece)), out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[b] - sums[a]) * powers(_INVERSE, len(piece))[a] + (b - a).astype(np.uint64)
        first = last
    return mix(out)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, and how many each text has.

    `counts` are words per text. A text with fewer words, but at least one, has one shingle: all its words.
    """
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    short = np.repeat(counts < size, n)
    length = np.where(short, np.repeat(counts, n), size)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = k < length
        w = words[np.where(inside, at + k, 0)] if len(words) else np.zeros(0, np.uint64)
        out = np.where(inside, mix(out * np.uint64(_PRIME) + w + np.uint64(k + 1)), out)
    return out, n


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each `shard`, from batches in which they are neighbours."""
    shard, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if shard is not None and r["shard"] != shard:
                yield shard, rows
                rows = []
            shard = r["shard"]
            rows.append(r)
    if shard is not None:
        yield shard, rows


def int_array(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def binaries(blob: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive pieces of `blob` (counts are in its items) as binary values."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int64) * blob.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(blob))]).cast(pa.binary())
