"""Removal of every byte that a long string, found twice in the corpus, covers.

Every string of LENGTH bytes has one anchor: its leftmost piece of PIECE bytes with the least hash. Equal strings have equal anchors at equal
places, so all places of a string are found together by anchor, and an anchor that occurs once needs no look. Neighbouring
strings with one anchor form a context. Where an anchor's contexts are all equal, or a context occurs twice, all its strings occur twice. Different
contexts of one anchor, each once, go to the shard of their anchor: there a suffix array (Larsson-Sadakane refinement: groups that are still
unsorted are sorted by their rank some bytes on, which doubles the sorted depth) and common prefixes of neighbours (Kasai, with
all contexts side by side) tell which of their strings occur twice.

An anchor with very many contexts is dealt over several shards. These are merged: every shard sends its sorted distinct strings as
fingerprints, cut by value into ranges; a range finds by binary search which occur in several shards, and the shards look these up
among their own, again by binary search.

Defined cases: null and empty texts have no bytes; a text shorter than LENGTH loses nothing; rows that repeat an id and text are separate
documents, so each is a repeat of the other; matches never cross documents; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.llm import common as C
from telewatch.sources.tables import materialise

LENGTH, PIECE = 200, 32
SPAN = LENGTH - PIECE + 1  # pieces of a string
STRETCH = 2 << 20  # bytes that are hashed at once; a longer text is taken whole
SHARD_BYTES = 2 << 20
HOT = 4000  # contexts of one anchor in one shard
_PRIME, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
PLACE = np.uint64((1 << 24) - 1)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C.byte_table(11)[data] * C.powers(_PRIME, len(data)), out=out[1:])
    return out


def _pieces(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], by differences of running sums."""
    return C.mix((sums[end] - sums[start]) * inverse[start])


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of consecutive texts, for every context: its text, first and last string, anchor hash and content hash."""
    n = len(data)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return empty
    sums, inverse = _sums(data), C.powers(_INVERSE, n + 1)
    at = np.arange(n - PIECE + 1)
    hashes = _pieces(sums, at, at + PIECE, inverse)
    if n > int(PLACE):  # a text of 16 MB and more: least hash, then least place, as two keys would say
        return tuple(np.concatenate(x) for x in zip(*_in_parts(data, offsets))) or empty
    least = (hashes & ~PLACE) | at.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    anchor = (least & PLACE).astype(np.int64)  # of the string at each place
    sizes = np.diff(offsets)
    valid = np.zeros(len(anchor) + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = np.flatnonzero(valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate(((anchor[1:] != anchor[:-1]) | ~valid[1:], [True])))
    content = C.mix(_pieces(sums, first, last + LENGTH, inverse) + C.mix((anchor[first] - first).astype(np.uint64)) + (last - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], last - offsets[text], hashes[anchor[first]], content


def _in_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts too long for one key: stretches of strings, each with the bytes that its strings reach. A context that a cut divides is two
    contexts, which changes nothing but how far equal ones coincide."""
    step = int(PLACE) // 2
    for t in range(len(offsets) - 1):
        own = data[offsets[t]:offsets[t + 1]]
        for a in range(0, max(len(own) - LENGTH + 1, 0), step):
            part = own[a:a + step + LENGTH - 1]
            _, lo, hi, h, c = contexts(part, np.array([0, len(part)]))
            yield np.full(len(lo), t), lo + a, hi + a, h, c


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRETCH, "right")) - 1)
        yield first, last
        first = last


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        data, offsets = C.text_bytes(batch.column(1))
        names, found = batch.column(0).to_numpy(), []
        for a, b in _stretches(offsets):
            text, *rest = contexts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            found.append((text + a, *rest))
        text, lo, hi, h, c = (np.concatenate(x) for x in zip(*found))
        return {"name": pa.array(names[text]), "lo": pa.array(lo), "hi": pa.array(hi), "anchor": C.int_array(h), "content": C.int_array(c)}

    return C.map_batches(docs, run, "name long, lo long, hi long, anchor long, content long")


# shards -----------------------------------------------------------------------------------------------------------------

def suffix_array(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places in order of what follows up to `end`, the place where each one's context ends, by refining groups of equal rank. Symbols are
    1 to 511; a context that ends counts as smaller than any symbol. Equal suffixes keep the order of their places."""
    n, longest = len(symbols), int((end - np.arange(len(symbols))).max(initial=0))
    at, key = np.arange(n), np.zeros(n, np.uint64)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    for k in range(7):
        key = key << np.uint64(9) | np.where(at + k < end, padded[k:k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    head = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = head + 1
    step = 7
    while step < longest:
        size = np.diff(np.append(np.flatnonzero(new), n))
        unsorted = np.flatnonzero(np.repeat(size > 1, size))  # slots of groups with several places
        if not len(unsorted):
            break
        places = order[unsorted]
        later = np.minimum(places + step, n)
        pair = rank[places] << 32 | np.where(later < end[places], rank[later], 0)
        by = np.argsort(pair, kind="stable")  # groups stay where they are, as their rank is the higher half
        order[unsorted], pair = places[by], pair[by]
        new[unsorted] = np.concatenate(([True], pair[1:] != pair[:-1]))
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[unsorted]] = head[unsorted] + 1
        step *= 2
    return order


def common_prefixes(symbols: np.ndarray, end: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For the places first[i] .. first[i] + count[i] - 1 of each context: symbols shared with the place before in `order`.

    From one place to the next the prefix gets shorter by one at most, so each context carries its length along; all contexts move together."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, h = np.zeros(n, np.int64), np.zeros(len(first), np.int64)
    for k in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > k)
        here = first[on] + k
        there, length = before[here], np.maximum(h[on] - 1, 0)
        length[there < 0] = 0
        grow = np.flatnonzero(there >= 0)
        while len(grow):
            a, b = here[grow] + length[grow], there[grow] + length[grow]
            inside = (a < end[here[grow]]) & (b < end[there[grow]])
            grow, a, b = grow[inside], a[inside], b[inside]
            grow = grow[symbols[a] == symbols[b]]
            length[grow] += 1
        out[here], h[on] = length, length
    return out


def repeated_strings(texts: list[bytes]) -> list[np.ndarray]:
    """For every context, which of its strings also start elsewhere in these contexts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    count, first = lengths - LENGTH + 1, np.cumsum(lengths) - lengths
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    end = np.repeat(first + lengths, lengths)
    order = suffix_array(symbols, end)
    own = np.zeros(len(symbols), bool)
    own[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))] = True
    prefix = common_prefixes(symbols, end, order, first, count)
    order = order[own[order]]  # what is too short for a string never stands between two equal ones
    shared = prefix[order] >= LENGTH
    twice = np.zeros(len(symbols), bool)
    twice[order] = shared | np.append(shared[1:], False)
    return [twice[a:a + n] for a, n in zip(first.tolist(), count.tolist())]


def fingerprints(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    at = np.arange(len(data) - LENGTH + 1)
    return _pieces(_sums(data), at, at + LENGTH, C.powers(_INVERSE, len(data) + 1))


def _ranges(flags: np.ndarray) -> np.ndarray:
    """First and last of every run of true flags, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    edges[1::2] -= 1
    return edges


FOUND = "anchor long, content long, a long, b long"


def _rows(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """A row for every run of repeated strings in a context: its first and last string."""
    runs = [(anchor, content, *pair) for anchor, content, edges in found for pair in edges.reshape(-1, 2).tolist()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*runs)], ["anchor", "content", "a", "b"])


def _within(batches):
    for _, rows in C.by_shard(batches):
        flags = repeated_strings([r["bytes"] for r in rows])
        found = [(r["anchor"], r["content"], _ranges(f)) for r, f in zip(rows, flags) if f.any()]
        if found:
            yield _rows(found)


def _sorted_strings(ranges: int):
    def run(batches):
        for shard, rows in C.by_shard(batches):
            own = np.unique(np.concatenate([fingerprints(r["bytes"]) for r in rows]))
            cut = np.searchsorted(own, (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64))
            parts = np.split(own, cut)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(range(ranges), pa.int64()), "of": pa.array([shard] * ranges, pa.int64()),
                                              "strings": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _merge(batches):
    for _, rows in C.by_shard(batches):  # here a shard is a range of fingerprints
        runs = [np.frombuffer(r["strings"], np.uint64) for r in rows]
        whole = np.sort(np.concatenate(runs))
        for r, own in zip(rows, runs):
            several = np.searchsorted(whole, own, "right") - np.searchsorted(whole, own, "left") > 1
            if several.any():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r["of"]], pa.int64()), "strings": pa.array([own[several].tobytes()], pa.binary())})


def _look_up(batches):
    for _, rows in C.by_shard(batches):
        blobs = [r["strings"] for r in rows if r["strings"] is not None]
        if not blobs:
            continue
        known = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]))
        found = []
        for r in rows:
            if r["bytes"] is not None:
                own = fingerprints(r["bytes"])
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                if (flags := known[at] == own).any():
                    found.append((r["anchor"], r["content"], _ranges(flags)))
        if found:
            yield _rows(found)


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the contexts in `wanted` (name, lo, hi, ...). Texts are moved once, packed."""
    import zstandard

    def pack(batch: pa.RecordBatch):
        packer = zstandard.ZstdCompressor(3)
        return {"name": batch.column(0), "packed": pa.array([packer.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())}

    lists = wanted.groupBy("name").agg(F.collect_list(F.struct("lo", "hi", "anchor", "content", "shard")).alias("list"))  # a document's own contexts
    texts = C.map_batches(docs, pack, "name long, packed binary")

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for packed, items in zip(batch.column("packed").to_pylist(), batch.column("list").to_pylist()):
                text = unpacker.decompress(packed) if packed else b""
                found += [(x["shard"], x["anchor"], x["content"], text[x["lo"]:x["hi"] + LENGTH]) for x in items]
            if found:
                s, a, c, t = zip(*found)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(s, pa.int64()), "anchor": pa.array(a, pa.int64()), "content": pa.array(c, pa.int64()),
                                                  "bytes": pa.array(t, pa.binary())})

    joined = texts.join(materialise(lists, "lists"), "name").select("packed", "list")
    return joined.mapInArrow(run, "shard long, anchor long, content long, bytes binary").dropDuplicates(["anchor", "content"])


def repeats(docs: DataFrame) -> DataFrame:
    """name, first and end of byte ranges that repeated strings cover, of `docs` (name, text)."""
    anchors = materialise(_anchors(docs), "anchors")
    often = materialise(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")
    seen = materialise(anchors.join(often, "anchor"), "seen")
    classes = materialise(seen.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("name", "lo", "hi")).alias("one")), "classes")
    several = materialise(classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    whole = classes.filter("n > 1").select("anchor", "content")

    compared = classes.join(several, "anchor").select("anchor", "content", "m", "one.*")
    size = several.agg(F.sum("m")).first()[0] or 0
    shards = max(1, -(-size * 300 // SHARD_BYTES))
    parts = F.ceil(F.col("m") / HOT)
    shard = F.when(F.col("m") <= HOT, F.pmod("anchor", F.lit(shards))).otherwise(-1 - F.abs(F.xxhash64("anchor", F.pmod("content", parts)) % F.lit(1 << 62)))
    cut = materialise(_cut_out(docs, compared.withColumn("shard", shard)), "contexts")
    partial = cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(_within, FOUND)
    hot = cut.filter("shard < 0")
    hot_shards = hot.select("shard").distinct().count()
    if hot_shards:
        rows = hot.repartition("shard").sortWithinPartitions("shard")
        sent = rows.mapInArrow(_sorted_strings(hot_shards), "shard long, of long, strings binary")
        merged = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merge, "shard long, strings binary")
        both = hot.withColumn("strings", F.lit(None).cast("binary")).unionByName(merged, allowMissingColumns=True)
        partial = partial.unionByName(both.repartition("shard").sortWithinPartitions("shard").mapInArrow(_look_up, FOUND))
    partial = materialise(partial, "partial")
    inside = seen.join(partial, ["anchor", "content"]).select("name", (F.col("lo") + F.col("a")).alias("first"), (F.col("lo") + F.col("b") + LENGTH).alias("end"))
    full = seen.join(materialise(whole, "whole"), ["anchor", "content"]).select("name", F.col("lo").alias("first"), (F.col("hi") + LENGTH).alias("end"))
    return full.unionByName(inside).distinct()


def removal(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans and the kept bytes."""
    import zstandard

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(key, F.col(text).cast("string")).alias("name"), F.col(text).cast("string").alias("text"))
    found = repeats(named.select("name", "text")).groupBy("name").agg(F.collect_list(F.struct("first", "end")).alias("list"))  # a document's own ranges

    def pack(batch: pa.RecordBatch):
        packer = zstandard.ZstdCompressor(3)
        return {"doc_id": batch.column(0), "name": batch.column(1), "packed": pa.array([packer.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())}

    texts = C.map_batches(named, pack, "doc_id long, name long, packed binary")
    joined = texts.join(materialise(found, "ranges"), "name", "left").select("doc_id", "packed", "list")

    def run(batch: pa.RecordBatch):
        unpacker, out = zstandard.ZstdDecompressor(), []
        for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = unpacker.decompress(packed)
            spans: list[list[int]] = []
            for r in sorted(ranges or [], key=lambda r: r["first"]):
                if spans and r["first"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["end"])
                else:
                    spans.append([r["first"], r["end"]])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s], kept))
        n, gone, spans, digest, edges, kept = zip(*out)
        more = {"spans": pa.array(edges, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())} if with_text else {}
        return {"doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(digest), **more}

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<long>, kept binary" if with_text else "")
    return C.map_batches(joined, run, schema)
