"""Token ids as length-delimited binary records with masked checksums, and a separate index of offsets.

A record is: length of the payload (uint64), masked CRC-32C of these eight bytes (uint32), payload, masked CRC-32C of the
payload (uint32), all little-endian. That is the framing of TFRecord files, so their readers can read them. A payload holds the ids of
one document as uint16 or uint32, whichever the vocabulary needs. Beside each file of records lies an index with (doc_id,
offset, number of ids) of every record as int64, so that records can be read in any order.

Documents are put in order of doc_id by a range exchange, and every task writes one pair of files under a name of its own.
The table of written files (the manifest) holds only what finished tasks have written; what lost tasks left is never read.

Defined cases: a null text is empty; an empty text has only the end id; a null doc_id comes first and is kept as null; equal
doc_ids are ordered by text; further columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telewatch.llm import common as C
from telewatch.llm.chunks import WordEncoder, gather
from telewatch.sources.tables import materialise, shared_folder

NULL_ID = -(2 ** 63)  # stands for a null doc_id in an index
MANIFEST = "part int, path string, index string, dtype string, records long, tokens long"
READ_BYTES = 8 << 20
LOT = 2 << 20  # bytes of text encoded at once, so that a chunk is looked up once for many texts

# CRC-32C --------------------------------------------------------------------------------------------------------------

POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8  # fixed values of the format
BLOCK = 1024


def _tables() -> np.ndarray:
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1))
    rows = [one]
    for _ in range(3):
        rows.append(one[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.stack(rows)


TABLE = _tables()


def _step(state: np.ndarray) -> np.ndarray:
    """Four bytes further, for every state at once."""
    return TABLE[3][state & 255] ^ TABLE[2][(state >> 8) & 255] ^ TABLE[1][(state >> 16) & 255] ^ TABLE[0][state >> 24]


def _skip() -> np.ndarray:
    """What BLOCK zero bytes make of a state, by the state's bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    for _ in range(BLOCK // 4):
        state = _step(state)
    return state


SKIP = _skip()


def _short(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = int(TABLE[0][(crc ^ b) & 255]) ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def crc32c(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of consecutive byte strings. They are cut into blocks that are run through the tables side by side."""
    lengths = np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    ends, block_ends = np.cumsum(lengths), np.cumsum(blocks)
    grid = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    for end, n, block_end in zip(ends.tolist(), lengths.tolist(), block_ends.tolist()):
        to = block_end * BLOCK  # zeros before a message change nothing while the state is zero
        grid[to - n:to] = data[end - n:end]
        if n >= 4:
            grid[to - n:to - n + 4] ^= 255  # the same as starting with all ones
    words = grid.view("<u4").reshape(-1, BLOCK // 4)
    state = np.zeros(len(words), np.uint32)
    for column in range(BLOCK // 4):
        state = _step(state ^ words[:, column])
    out = np.zeros(len(lengths), np.uint32)
    for k in range(int(blocks.max(initial=0))):
        on = np.flatnonzero(blocks > k)
        s = out[on]
        s = SKIP[0][s & 255] ^ SKIP[1][(s >> 8) & 255] ^ SKIP[2][(s >> 16) & 255] ^ SKIP[3][s >> 24]
        out[on] = s ^ state[block_ends[on] - blocks[on] + k]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths < 4):
        out[i] = _short(data[ends[i] - lengths[i]:ends[i]].tobytes())
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


# files ----------------------------------------------------------------------------------------------------------------

def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def frame(payloads: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Framed records one after the other, and the offset of each, from the bytes of consecutive payloads."""
    heads = lengths.astype("<u8").view(np.uint8)
    ends = np.cumsum(lengths + 16)
    offsets = ends - (lengths + 16)
    out = np.empty(int((lengths + 16).sum()), np.uint8)
    inside = np.ones(len(out), bool)
    for at, piece in ((offsets, heads.reshape(-1, 8)), (offsets + 8, masked(crc32c(heads, np.full(len(lengths), 8))).astype("<u4").view(np.uint8).reshape(-1, 4)),
                      (ends - 4, masked(crc32c(payloads, lengths)).astype("<u4").view(np.uint8).reshape(-1, 4))):
        places = at[:, None] + np.arange(piece.shape[1])
        out[places], inside[places] = piece, False
    out[inside] = payloads
    return out.tobytes(), offsets


def unframe(blob: bytes, offsets: np.ndarray, counts: np.ndarray, dtype: str) -> list[np.ndarray]:
    """The ids of the records at `offsets` of `blob`. Raises if a length or checksum is wrong."""
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(blob, np.uint8)
    heads = np.concatenate([raw[o:o + 8] for o in offsets]) if len(offsets) else raw[:0]
    lengths = heads.view("<u8").astype(np.int64)
    said = np.array([raw[o + 8:o + 12].view("<u4")[0] for o in offsets], np.uint32)
    if (lengths != counts * size).any() or (masked(crc32c(heads, np.full(len(offsets), 8))) != said).any():
        raise ValueError("a record's length is damaged")
    bodies = [raw[o + 12:o + 12 + n] for o, n in zip(offsets, lengths)]
    said = np.array([raw[o + 12 + n:o + 16 + n].view("<u4")[0] for o, n in zip(offsets, lengths)], np.uint32)
    if (masked(crc32c(np.concatenate(bodies) if bodies else raw[:0], lengths)) != said).any():
        raise ValueError("a record's ids are damaged")
    return [b.view(dtype) for b in bodies]


def library_encoder(path: str):
    """Encodes strings with the tokenizers library; no special tokens are added, and those that a text spells out are found, as in a plain call."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    begins = np.zeros(library.get_vocab_size(), bool)  # tokens that begin with a space
    begins[[i for token, i in library.get_vocab().items() if token.startswith("\u0120")]] = True

    def many(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strings that hold one space, at their start, are encoded together: the ids of each begin with such a token."""
        parts, counts, order = [np.zeros(0, np.uint32)], [], []
        rest = range(len(strings))
        spaced = [i for i in rest if strings[i][:1] == " " and " " not in strings[i][1:]]
        groups = [spaced[at:at + 500] for at in range(0, len(spaced), 500)]
        for group, found in zip(groups, library.encode_batch_fast(["".join([strings[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            first = np.flatnonzero(begins[ids])
            if len(first) != len(group):
                raise ValueError("the vocabulary joins what lies beside a space")
            parts.append(ids)
            counts += np.diff(np.append(first, len(ids))).tolist()
        order += spaced
        for i in sorted(set(rest).difference(spaced)):
            parts.append(np.array(library.encode(strings[i], add_special_tokens=False).ids, np.uint32))
            counts.append(len(parts[-1]))
            order.append(i)
        ids, counts, back = np.concatenate(parts), np.array(counts, np.int64), np.argsort(np.array(order, np.int64))
        starts = np.cumsum(counts) - counts
        return gather(ids, starts[back], counts[back]), counts[back]

    return WordEncoder(many), library.get_vocab_size()


def write_records(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, append `end_id` to each, and write them in order of `key`. Returns the manifest of files."""
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/records-{uuid.uuid4().hex}"
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sink, index, at, tokens = None, TaskContext.get().partitionId(), None, [], 0, 0
        for batch in C.in_lots(batches, LOT):
            if sink is None:
                encoder, size = C.kept_in_process(f"records {vocabulary}", lambda: library_encoder(vocabulary))
                dtype = "<u2" if size <= 1 << 16 else "<u4"
                system, root = file_system(folder)
                system.create_dir(root, recursive=True)
                name = f"part-{part:05d}-{uuid.uuid4().hex}"
                sink = system.open_output_stream(f"{root}/{name}.rec")
            found, counts = encoder.encode(C.texts(C.column(batch, "text")))
            counts = counts + 1
            ids = np.full(int(counts.sum()), end_id, dtype)
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(counts) - 1] = False
            ids[inner] = found
            blob, offsets = frame(ids.view(np.uint8), counts * ids.itemsize)
            sink.write(blob)
            keys = C.column(batch, "doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            index.append(np.stack([keys, offsets + at, counts], 1))
            at, tokens = at + len(blob), tokens + int(counts.sum())
        if sink is not None:
            sink.close()
            rows = np.concatenate(index).astype("<i8")
            with system.open_output_stream(f"{root}/{name}.idx") as out:
                out.write(rows.tobytes())
            base = f"{folder}/{name}"
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{base}.rec"], "index": [f"{base}.idx"],
                                              "dtype": [dtype], "records": [len(rows)], "tokens": [tokens]})

    return materialise(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_index(path: str) -> np.ndarray:
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def _with_starts(manifest: DataFrame) -> DataFrame:
    """Adds the ids before each file; the window is over one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame) -> DataFrame:
    """All records in file order: doc_id, start (ids of all records before), ids as little-endian uint32, checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = file_system(row["path"])
                index, start = read_index(row["index"]), row["start"]
                with system.open_input_file(at) as f:
                    first = 0
                    while first < len(index):
                        low = int(index[first, 1])
                        last = max(first + 1, int(np.searchsorted(index[:, 1], low + READ_BYTES)))
                        f.seek(low)
                        blob = f.read((int(index[last, 1]) if last < len(index) else f.size()) - low)
                        part = index[first:last]
                        ids = [x.astype("<u4") for x in unframe(blob, part[:, 1] - low, part[:, 2], row["dtype"])]
                        starts = start + np.cumsum(part[:, 2]) - part[:, 2]
                        start += int(part[:, 2].sum())
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(part[:, 0], mask=part[:, 0] == NULL_ID), "start": starts, "n_tokens": pa.array(part[:, 2]),
                            "ids": pa.array([x.tobytes() for x in ids], pa.binary())})
                        first = last

    n = max(1, manifest.count())  # one row per file
    files = _with_starts(manifest).repartition(n)
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """All records in a random order that `seed` fixes: position in the order, doc_id and ids, by way of the index."""
    def entries(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(row["index"])
                yield pa.RecordBatch.from_pydict({"path": [row["path"]] * len(index), "dtype": [row["dtype"]] * len(index),
                                                  "doc_id": pa.array(index[:, 0], mask=index[:, 0] == NULL_ID),
                                                  "offset": pa.array(index[:, 1]), "n_tokens": pa.array(index[:, 2])})

    def fetch(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids: list[bytes] = [b""] * len(rows)
            for path in sorted({r["path"] for r in rows}):
                system, at = file_system(path)
                with system.open_input_file(at) as f:
                    for i, r in sorted(((i, r) for i, r in enumerate(rows) if r["path"] == path), key=lambda x: x[1]["offset"]):
                        f.seek(r["offset"])
                        blob = f.read(16 + r["n_tokens"] * np.dtype(r["dtype"]).itemsize)
                        ids[i] = unframe(blob, np.array([0]), np.array([r["n_tokens"]]), r["dtype"])[0].astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({"place": batch.column("place"), "doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    index = manifest.repartition(max(1, manifest.count())).mapInArrow(entries, "path string, dtype string, doc_id long, offset long, n_tokens long")
    place = F.xxhash64(F.lit(seed), "path", "offset")
    order = index.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place")
    return order.mapInArrow(fetch, "place long, doc_id long, ids binary")


def token_records(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the records of `docs`, read them back, and return a row per document with position, length and checksum."""
    def digest(batch: pa.RecordBatch):
        crc = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"),
                "ids_crc32": pa.array(crc, pa.int64())}

    read = read_records(write_records(docs, vocabulary))
    return C.map_batches(read, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
