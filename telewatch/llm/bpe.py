"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into chunks that no piece crosses (`chunks`), new chunks into pieces by the vocabulary's pattern, and every
distinct piece is encoded once. Pieces of similar length form a matrix of ids, one row each. In a round every row merges its leftmost
pair of minimum rank and closes the gap, so that all rows get one column shorter together; rows without a pair that may merge
leave the matrix. Ranks of pairs are found in a hash table with linear probing. A piece too long for a matrix (`WIDEST`) goes
through the same merges with a heap, as moving its whole row in every round would cost its length squared.

Defined cases: a null text is empty and has no ids; further columns are kept beside `ids`; rows are independent of each other.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewatch.llm import common as C
from telewatch.llm.chunks import ChunkEncoder

NONE = np.int32(2 ** 31 - 1)
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
WIDEST = WIDTHS[-1]
ROWS = 20_000
KEEP_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}


class PairTable:
    """Rank of the token that two neighbouring tokens make, in an open-addressed table of arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        keys, found = np.array(keys, np.int64), np.array(found, np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # every round, one key per free slot moves in and the others go on to the next
            self.probes += 1
            free = left[self.keys[slot[left]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            self.keys[slot[free[one]]], self.ranks[slot[free[one]]] = keys[free[one]], found[free[one]]
            left = np.setdiff1d(left, free[one], assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is none or a side is padding (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat, k = out.ravel(), keys.ravel()[open_]
        slot = self._slot(k)
        for _ in range(self.probes):
            if not len(open_):
                break
            there = self.keys[slot]
            hit = there == k
            flat[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            open_, k, slot = open_[on], k[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Merger:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pairs, self.pattern = ranks, PairTable(ranks), regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most `width` bytes."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < n[:, None], self.byte[raw], -1).astype(np.int32)
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            for i in np.flatnonzero(done):
                out[row[i]] = ids[i, :n[row[i]]].astype("<u4").tobytes()
            row, ids, rank, at, best = row[~done], ids[~done], rank[~done], at[~done], best[~done]
            if not len(row):
                break
            lines = np.arange(len(row))
            ids[lines, at] = best
            n[row] -= 1
            shift = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), 1)
            shift = shift[:-1]
            rank = np.take_along_axis(rank, shift + (shift >= at[:, None]), 1)
            for k, ok in ((at - 1, at > 0), (at, at < rank.shape[1])):  # only the pairs beside the new token changed
                rank[lines[ok], k[ok]] = self.pairs.find(ids[lines[ok], k[ok]], ids[lines[ok], k[ok] + 1])
        return out

    def long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(piece)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), first.tolist() + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def rank_of(i: int) -> int:
            j = after[i]
            return int(self.pairs.find(np.array([ids[i]]), np.array([ids[j]]))[0]) if j < n else int(NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or ranks[i] != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    ranks[k] = rank_of(k)
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        return np.array([x for x, on in zip(ids, alive) if on], "<u4").tobytes()

    def pieces(self, strings: list[str]) -> list[bytes]:
        """Ids of pieces; a piece that is a token is that token."""
        out, buckets = [b""] * len(strings), {w: [] for w in WIDTHS}
        for i, s in enumerate(strings):
            p = s.encode()
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[i] = self.long(p)
            else:
                buckets[next(w for w in WIDTHS if len(p) <= w)].append((i, p))
        for width, rows in buckets.items():
            for at in range(0, len(rows), ROWS):
                some = rows[at:at + ROWS]
                for (i, _), ids in zip(some, self.matrix([p for _, p in some], width)):
                    out[i] = ids
        return out

    def many(self, strings: list[str]) -> list[bytes]:
        """Ids of any strings, through their distinct pieces."""
        cuts = [self.pattern.findall(s) for s in strings]
        wanted = {p for c in cuts for p in c}
        if len(self.known) + len(wanted) > KEEP_PIECES:
            self.known.clear()
        new = list(wanted.difference(self.known))
        self.known.update(zip(new, self.pieces(new)))
        known = self.known.__getitem__
        return [b"".join(map(known, c)) for c in cuts]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `ids`, the text's ids as little-endian uint32, to the columns `keep`."""
    kept = list(df.columns) if keep is None else keep
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        encoder = None
        for batch in batches:
            if batch.num_rows:
                encoder = encoder or C.kept_in_process(f"bpe {ranks_path} {pattern}", lambda: ChunkEncoder(Merger(read_ranks(ranks_path), pattern).many))
                ids = pa.array(encoder.encode(C.texts(batch.column(len(kept)))), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*[f"k{i}" for i in range(len(kept))], "ids"])

    schema = T.StructType([*source.drop("t").schema.fields, T.StructField("ids", T.BinaryType())])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept) if c != "ids"], "ids")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for. Unknown ids raise."""
    kept = [c for c in df.columns if c not in ("decoded", ids)]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{ids}`").alias("ids"))

    def run(batches):
        table = None
        for batch in batches:
            if batch.num_rows:
                table = table or C.kept_in_process(f"tokens {ranks_path}", lambda: {rank: token for token, rank in read_ranks(ranks_path).items()})
                found = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    out = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("ids").alias(ids), "decoded")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode all texts; per document the number of ids and checksums of ids and decoded bytes."""
    both = decode(encode(docs, ranks_path, pattern, keep=["doc_id"]), ranks_path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
