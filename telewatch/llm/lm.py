"""An n-gram language model in a trie of Elias-Fano lists, and the log10 probability of texts under it.

Level 1 holds the words of the training texts, by 64-bit hash, with exact counts; level k holds the k-grams as (place of the first k - 1
words in level k - 1, place of the last word in level 1). A level is cut into shards by hash, and a hot context is cut by its next word too, so
no shard grows with one word. In a shard, contexts are a monotone list, the starts of their followers another, and the followers a third,
in which a word is stored relative to its context: base of the context plus word. A follower is found by the successor of that
number; where a frequent context fills a bucket of the list, by halving the bucket. Each k-gram has a byte, the logarithm of its smoothed relative count rounded down, and (below the highest level) its count. Files lie in the shared
folder and are memory-mapped by the tasks that score.

Smoothing: p(w | c) = (n(c, w) + mu * p(w | shorter c)) / (n(c) + mu), from level 1 up, whose probability is
(c + 0.5) / (N + 0.5 (V + 1)). Rounding down keeps sums of probabilities at most 1.

Every count is over all training texts, with sums in map tasks before each exchange: words by hash, k-grams as sorted blocks of differences. Texts
are turned into places of words once, stored, and read by the later passes.

Defined cases: a null text is empty; an empty text has only its end; rows without an id are training rows if the fold says so and are scored; no training
rows give N = 0, V = 0 and every token the probability 1; repeated rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.llm import common as C
from telewatch.llm.eliasfano import EliasFano, encode
from telewatch.llm.records import file_system
from telewatch.sources.tables import materialise, shared_folder

END = np.uint64(0x452821E638D01377)  # stands for the end of a text, and as a context for its start
SHARD_ROWS = 3 << 20  # tokens whose k-grams make a shard, about
TOKENS_AT_ONCE = 2 << 20
MU = 12.0
STEPS = 256 / 9.0  # codes per power of ten: a byte reaches down to 1e-9
SHARES = 10.0 ** -(np.arange(256) / STEPS)
HEADER = 8192


# files ------------------------------------------------------------------------------------------------------------------

def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, HEADER
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    system, path = file_system(uri)
    with system.open_output_stream(path, compression=None) as f:
        f.write(json.dumps(head).encode().ljust(HEADER))
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped where the shared folder is mounted."""
    system, path = file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    head = json.loads(bytes(raw[:HEADER]))
    return {name: np.asarray(raw[at:at + n * np.dtype(d).itemsize]).view(d) for name, (d, n, at) in head.items()}


def _inner(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k.removeprefix(prefix): a for k, a in arrays.items() if k.startswith(prefix)})


class Level:
    """Shards of a level: (path, rows before it) by shard number."""

    def __init__(self, manifest: list[tuple[int, str, int]], shards: int, words: int = 0):
        self.shards, self.words, self.paths, self.base, self.open = shards, words, {}, np.zeros(shards, np.int64), {}
        total = 0
        for shard, path, rows in sorted(manifest):
            self.paths[shard], self.base[shard] = path, total
            total += rows
        self.rows = total

    def shard(self, k: int) -> dict | None:
        if k not in self.open:
            a = load(self.paths[k]) if k in self.paths else None
            lists = {p: _inner(a, f"{p}.") for p in ("words", "contexts", "followers") if f"{p}.meta" in a} if a else {}
            self.open[k] = a and a | {"lists": lists}
        return self.open[k]

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(edges)):
            yield int(k), order[edges[k]:edges[k + 1]]


class Words(Level):
    def of(self, hashes: np.ndarray) -> np.ndarray:
        return _shard_of(hashes, self.shards)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for words that training texts don't have."""
        out = np.full(len(hashes), -1, np.int64)
        for k, at in self._by_shard(self.of(hashes)):
            s = self.shard(k)
            if s:
                j = s["lists"]["words"].find(hashes[at])
                out[at] = np.where(j >= 0, j + self.base[k], -1)
        return out

    def counts(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        edges = self.base[sorted(self.paths)]
        numbers = np.array(sorted(self.paths))
        shard = numbers[np.maximum(np.searchsorted(edges, places, "right") - 1, 0)] if len(numbers) else np.zeros(len(places), np.int64)
        for k, at in self._by_shard(np.where(places >= 0, shard, 0)):
            on = at[places[at] >= 0]
            if len(on):
                out[on] = self.shard(k)["counts"][places[on] - self.base[k]]
        return out


class Grams(Level):
    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, relative count (rounded down) and count of each k-gram; -1, 0, 0 where it is not there."""
        place, share, count = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(word), np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        # each distinct pair is asked for once, in order, and each distinct context of a shard once
        order = np.lexsort((word[known], context[known])) if context.max(initial=0) >> 32 else np.argsort(context[known] << 32 | word[known])
        c, w = context[known][order], word[known][order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        back = np.empty(len(c), np.int64)
        back[order] = np.cumsum(new) - 1
        c, w = c[new], w[new]
        del order, new  # a lot is large
        found, near, times = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.zeros(len(c), np.int64)
        for k, at in self._by_shard(gram_shard(c, w, self.shards)):
            s = self.shard(k)
            if not s:
                continue
            distinct, here = np.unique(c[at], return_inverse=True)
            i = s["lists"]["contexts"].find(distinct.astype(np.uint64))[here]
            at, i = at[i >= 0], i[i >= 0]
            j = s["lists"]["followers"].find((i * self.words + w[at]).astype(np.uint64))
            at, j = at[j >= 0], j[j >= 0]
            found[at], near[at] = j + self.base[k], SHARES[s["codes"][j]]
            if "counts" in s:
                times[at] = s["counts"][j]
        place[known], share[known], count[known] = found[back], near[back], times[back]
        return place, share, count

    def followers(self, context: int) -> int:
        """How many words follow a context, by its pointers."""
        total = 0
        for k in self.paths:
            s = self.shard(k)
            i = int(s["lists"]["contexts"].find(np.array([context], np.uint64))[0])
            total += int(s["starts"][i + 1] - s["starts"][i]) if i >= 0 else 0
        return total


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the highest 32 bits, so that shards are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def gram_shard(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of(C.mix(context.astype(np.uint64) * np.uint64(64) + (word.astype(np.uint64) & np.uint64(63))), shards)


# passes -----------------------------------------------------------------------------------------------------------------

def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and end of every text, and how many each text has."""
    data, offsets = C.text_bytes(column)
    starts, ends, owner = C.word_spans(data, offsets)
    n = np.bincount(owner, minlength=len(column)).astype(np.int64)
    out = np.full(len(starts) + len(n), END, np.uint64)
    out[np.arange(len(starts)) + owner] = C.word_hashes(data, starts, ends)
    return out, n + 1


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A row per shard: its sorted keys as bytes of their differences (all lowest bytes first) and its counts."""
    order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
    keys, counts, shard = keys[order], counts[order], shard[order]
    numbers, at = np.unique(shard, return_index=True)
    rows = []
    for k, a, b in zip(numbers.tolist(), at.tolist(), [*at[1:].tolist(), len(shard)]):
        steps = np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
        rows.append((k, np.ascontiguousarray(steps).tobytes(), np.ascontiguousarray(counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()))
    return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()),
                                       "counts": pa.array([r[2] for r in rows], pa.binary())})


def _unblock(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    n = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(k, dtype=np.uint64), n.astype(np.int64)


def _counted(df: DataFrame, take, shard_of) -> DataFrame:
    """Blocks of counted keys. `take` gives the keys of a batch; a task adds up some million keys before it sends them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                k = take(batch)
                held.append(_summed([(k, np.ones(len(k), np.int64))]))
                size += len(held[-1][0])
            if size > TOKENS_AT_ONCE:
                keys, n = _summed(held)
                yield _blocks(keys, n, shard_of(keys))
                held, size = [], 0
        if size:
            keys, n = _summed(held)
            yield _blocks(keys, n, shard_of(keys))

    return df.mapInArrow(run, "shard int, keys binary, counts binary")


def _written(blocks: DataFrame, folder: str, shards: int, arrays_of) -> tuple[list[tuple[int, str, int]], int]:
    """Merge the blocks of every shard and write its file. Returns shard, path and rows of each, and the sum of counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = None, [], 0

        def done():
            keys, n = _summed(held)
            uri = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
            system, root = file_system(folder)
            system.create_dir(root, recursive=True)
            save(uri, arrays_of(shard, keys, n))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "rows": [len(keys)], "total": [int(n.sum())]})

        for batch in batches:
            for k, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard is not None and k != shard:
                    yield done()
                    held, size = [], 0
                shard = k
                held.append(_unblock(keys, counts))
                size += len(held[-1][0])
                if size > 4 * SHARD_ROWS:  # many equal keys: add up early
                    held = [_summed(held)]
                    size = len(held[0][0])
        if shard is not None:
            yield done()

    parted = blocks.repartition(shards, "shard").sortWithinPartitions("shard")
    rows = materialise(parted.mapInArrow(run, "shard int, path string, rows long, total long"), "level").collect()  # a row per shard
    return [(r.shard, r.path, r.rows) for r in rows], sum(r.total for r in rows)


class Model:
    def __init__(self, words: Words, grams: list[Grams], total: int):
        self.words, self.grams, self.total = words, grams, total  # N; V is words.rows

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.words.rows + 1))

    def probabilities(self, places: np.ndarray, first: np.ndarray, end: int, upto: int | None = None):
        """Probability of each token given those before it in its text, the counts of tokens, and the places of the highest k-grams.

        `first` marks the tokens that begin a text; `end` is the place of the end token."""
        counts = self.words.counts(places)
        p = self.unigram(counts)
        seen, seen_n = places, counts  # the (k - 1)-gram that ends at each token
        end_n = int(self.words.counts(np.array([end]))[0]) if end >= 0 else 0
        for depth, level in enumerate(self.grams[:upto]):
            context, n = np.empty_like(seen), np.empty_like(seen_n)
            context[1:], n[1:] = seen[:-1], seen_n[:-1]
            context[first], n[first] = (end, end_n) if depth == 0 else (-1, 0)
            place, share, count = level.find(context, places)
            p = np.where(context >= 0, share + MU / (n + MU) * p, p)
            seen, seen_n = place, count
        return p, counts, seen


def _scattered(order: int):
    def take(model: Model, end: int):
        """Keys of the k-grams of a batch of places: place of the context times words, plus the last word."""
        def keys(batch: pa.RecordBatch) -> np.ndarray:
            places, first = _places_of(batch)
            if order == 2:
                context = np.empty_like(places)
                context[1:] = places[:-1]
                context[first] = end
            else:
                _, _, seen = model.probabilities(places, first, end, order - 2)
                context = np.empty_like(seen)
                context[1:] = seen[:-1]
                context[first] = -1
            on = context >= 0
            return (context[on] * model.words.rows + places[on]).astype(np.uint64)

        return keys

    return take


def _places_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    blobs = batch.column(batch.schema.get_field_index("places")).to_pylist()
    n = np.array([len(b) // 4 for b in blobs], np.int64)
    places = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64) - 1
    return places, np.cumsum(n) - n


def train(docs: DataFrame, held_out, order: int = 2, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """Count all texts for which `held_out` is false; returns the model and all texts as places of their tokens."""
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    learn = rows.filter(~F.col("held_out")).select("text")
    size = learn.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (64 * SHARD_ROWS)))
    blocks = _counted(learn, lambda b: tokens(b.column(0))[0], lambda k: _shard_of(k, shards))

    def word_level(shard: int, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        return {f"words.{k}": a for k, a in encode(keys, 1 << 64).items()} | {"counts": n.astype(np.uint32 if n.max() < 1 << 32 else np.int64)}

    manifest, total = _written(blocks, f"{folder}/1", shards, word_level)
    words = Words(manifest, shards)
    if words.rows >= (1 << 32) - 1:
        raise ValueError("places of words are stored in 32 bits")
    model, name = Model(words, [], total), uuid.uuid4().hex

    def places(batch: pa.RecordBatch):
        hashes, n = tokens(batch.column(2))
        unique, back = np.unique(hashes, return_inverse=True)
        found = (C.kept_in_process(f"words {name}", lambda: words).find(unique) + 1).astype("<u4")[back]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "places": C.binaries(found, n)}

    stored = materialise(C.map_batches(rows, places, "doc_id long, held_out boolean, places binary"), "places")
    end = int(words.find(np.array([END]))[0]) if total else -1
    for k in range(2, order + 1):
        parts = max(1, -(-total // SHARD_ROWS))
        v, last, lower = words.rows, k == order, Model(words, list(model.grams), total)

        def level(shard: int, keys: np.ndarray, n: np.ndarray, v=v, last=last, lower=lower, k=k) -> dict[str, np.ndarray]:
            context, word = (keys // np.uint64(v)).astype(np.int64), keys % np.uint64(v)
            held, start, count = np.unique(context, return_index=True, return_counts=True)
            before = lower.words.counts(held) if k == 2 else _gram_counts(lower.grams[-1], held)
            local = np.repeat(np.arange(len(held)), count)
            share = n / (before[local] + MU)
            codes = np.minimum(np.ceil(-np.log10(share) * STEPS), 255).astype(np.uint8)
            out = {f"contexts.{x}": a for x, a in encode(held.astype(np.uint64), int(held.max()) + 1).items()}
            out |= {f"followers.{x}": a for x, a in encode(local.astype(np.uint64) * np.uint64(v) + word, len(held) * v).items()}
            out |= {"starts": np.append(start, len(keys)).astype(np.uint32), "codes": codes}
            return out if last else out | {"counts": n.astype(np.uint32)}

        def shard_of(keys: np.ndarray, v=v, parts=parts) -> np.ndarray:
            return gram_shard(keys // np.uint64(v), keys % np.uint64(v), parts)

        blocks = _counted(stored.filter(~F.col("held_out")).select("places"), _scattered(k)(lower, end), shard_of)
        manifest, _ = _written(blocks, f"{folder}/{k}", parts, level) if total else ([], 0)
        model = Model(words, [*model.grams, Grams(manifest, parts, v)], total)
    return model, stored


def _gram_counts(level: Grams, places: np.ndarray) -> np.ndarray:
    numbers = np.array(sorted(level.paths))
    shard = numbers[np.searchsorted(level.base[numbers], places, "right") - 1]
    out = np.zeros(len(places), np.int64)
    for k in np.unique(shard):
        on = shard == k
        out[on] = level.shard(int(k))["counts"][places[on] - level.base[k]]
    return out


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def score(stored: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    name = uuid.uuid4().hex

    def scored(batch: pa.RecordBatch):
        own = C.kept_in_process(f"model {name}", lambda: model)
        places, first = _places_of(batch)
        end = int(own.words.find(np.array([END]))[0]) if own.total else -1
        p, counts, _ = own.probabilities(places, first, end)
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has its end
        n = np.diff(np.append(first, len(places)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "n_tokens": pa.array(n), "n_known": pa.array(add((counts > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(n), own.total, np.int64)), "base_score": add(np.log10(own.unigram(counts))), "score": add(np.log10(p))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:  # many texts at once, as every shard is asked for each lot of them
            held.append(batch)
            size += batch.nbytes
            if size > 2 * TOKENS_AT_ONCE:  # half as many places of four bytes; a task needs some 200 MB for them
                yield pa.RecordBatch.from_pydict(scored(_joined(held)))
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield pa.RecordBatch.from_pydict(scored(_joined(held)))

    return stored.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
