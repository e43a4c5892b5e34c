"""Encoding texts through their distinct chunks.

The split patterns of byte-level vocabularies never join what lies on the two sides of a single space between two
non-space characters: such a space begins a piece. So a text is cut there, every distinct chunk is encoded once, and the
ids of a text are the ids of its chunks in order. Python's idea of white space includes that of the patterns, so a cut is
only left out where it might matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
RARE = re.compile(r"[^\S \n]")
UNSAFE = re.compile(r" (?:(?<=\s )|(?=\s)|\Z)")


def cut(text: str) -> list[str]:
    """The first chunk, and the others without the space that they begin with."""
    return CUT.split(text) if text[:1] == " " or UNSAFE.search(text) else text.split(" ")


class ChunkEncoder:
    """`encode_many` turns strings into little-endian uint32 ids, as bytes. Known chunks are kept up to `keep` of them."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], keep: int = 400_000):
        self.encode_many, self.keep = encode_many, keep
        self.first: dict[str, bytes] = {"": b""}
        self.later: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], wanted: set[str], prefix: str) -> None:
        new = list(wanted.difference(known))
        if len(known) + len(new) > self.keep:
            known.clear()
            new = list(wanted)
        known.update(zip(new, self.encode_many([prefix + x for x in new] if prefix else new)))

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [cut(t) for t in texts]
        self._learn(self.first, {c[0] for c in cuts}, "")
        wanted: set[str] = set()
        for c in cuts:
            wanted.update(c[1:])
        self._learn(self.later, wanted, " ")
        first, later = self.first, self.later.__getitem__
        return [first[c[0]] + b"".join(map(later, c[1:])) for c in cuts]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist by far


def codes(column: pa.DictionaryArray) -> np.ndarray:
    return column.indices.to_numpy(zero_copy_only=False)


def found(keys: pa.Array, among: pa.Array) -> np.ndarray:
    """Where the keys are among others, -1 where they are not."""
    return pc.fill_null(pc.index_in(keys, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def unsafe(text: str) -> bool:
    """Whether a space may lie beside other white space; only texts with a rare kind of it need a search."""
    if text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return True
    rare = any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() else RARE.search(text)
    return bool(rare) and bool(UNSAFE.search(text))


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # of scripts whose letters no version of Unicode moves
TAILED = rf"^(?P<head> ?[{LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]+)$"


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of `pool` one after the other."""
    if not len(start):
        return pool[:0]
    total = int(count.sum())
    small = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64  # half the memory
    at = np.repeat((start - (np.cumsum(count) - count)).astype(small), count)
    at += np.arange(total, dtype=small)
    return pool[at]


class WordEncoder:
    """Ids of whole batches of texts by way of their distinct chunks, for slow libraries. The ids of known chunks lie in one pool.

    `encode_many` gives the ids of all strings of a list one after the other, and how many each has. Letters are encoded apart from
    the ASCII punctuation right after them, as both are pieces of their own in these patterns, whatever comes before or after.
    Past `keep` chunks, those asked for longest ago are forgotten.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = 500_000):
        self.encode_many, self.keep, self.tick = encode_many, keep, 0
        self.known, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Append keys and their ids; their places."""
        first = len(self.start)
        start = len(self.pool) + np.cumsum(counts) - counts
        self.known = pa.concat_arrays([self.known, keys])
        self.pool, self.start, self.count = np.concatenate([self.pool, ids]), np.concatenate([self.start, start]), np.concatenate([self.count, counts])
        self.used = np.concatenate([self.used, np.full(len(counts), self.tick)])
        return np.arange(first, len(self.start))

    def _forget(self) -> None:
        """Keep the half of `keep` chunks that were asked for last."""
        on = np.argsort(-self.used, kind="stable")[:self.keep // 2]
        known, pool, counts, used = self.known.take(pa.array(on)), gather(self.pool, self.start[on], self.count[on]), self.count[on], self.used[on]
        self.known, self.pool, self.start, self.count, self.used = known[:0], pool[:0], self.start[:0], self.count[:0], self.used[:0]
        self._add(known, pool, counts)
        self.used = used

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Where the distinct `keys` are known; they and the letters and tails of new ones are learned first."""
        if len(self.known) > self.keep:
            self._forget()
        self.tick += 1
        at = found(keys, self.known)
        new = np.flatnonzero(at < 0)
        column = keys.take(pa.array(new))
        parts = pc.extract_regex(column, TAILED)
        tailed = pc.is_valid(parts)
        heads, tails = (pc.struct_field(parts.filter(tailed), k).dictionary_encode() for k in ("head", "tail"))
        whole = column.filter(pc.invert(tailed))
        # letters and tails are looked up in turn, first among what is new anyway
        wanted = pc.unique(pa.concat_arrays([whole, heads.dictionary, tails.dictionary]))
        there = found(wanted, self.known)
        unknown = wanted.filter(pa.array(there < 0))
        there[there < 0] = self._add(unknown, *self.encode_many(strings(unknown)))
        at_whole, at_head, at_tail = (there[found(x, wanted)] for x in (whole, heads.dictionary, tails.dictionary))
        both = np.stack([at_head[codes(heads)], at_tail[codes(tails)]], 1).ravel()
        counts = self.count[both]
        is_tailed = tailed.to_numpy(zero_copy_only=False)
        at[new[~is_tailed]] = at_whole
        at[new[is_tailed]] = self._add(column.filter(tailed), gather(self.pool, self.start[both], counts), counts.reshape(-1, 2).sum(1))
        self.used[at] = self.tick
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        plain = np.array([not (t[:1] == " " or unsafe(t)) for t in texts], bool)
        lists = [pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.string()), " "), pa.array([cut(t) for t, p in zip(texts, plain) if not p], pa.list_(pa.string()))]
        place = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))  # where each text's chunks are
        chunks = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).dictionary_encode()
        n = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        code, distinct = codes(chunks), chunks.dictionary
        first = np.zeros(len(code), bool)
        first[(np.cumsum(n) - n)] = True  # a text has one chunk at least
        begins, later = (np.flatnonzero(np.bincount(code[x], minlength=len(distinct))) for x in (first, ~first))
        spaced = pc.binary_join_element_wise("", distinct.take(pa.array(later)), " ")
        at = np.zeros((2, len(distinct)), np.int64)
        keys = pa.concat_arrays([distinct.take(pa.array(begins)), spaced]).dictionary_encode()
        places = self._places(keys.dictionary)[codes(keys)]
        at[0, begins], at[1, later] = places[:len(begins)], places[len(begins):]
        at = at[(~first).astype(np.int64), code]
        counts = self.count[at]
        per_text = np.add.reduceat(counts, np.cumsum(n) - n) if len(n) else n
        ids = gather(self.pool, self.start[at], counts)
        if plain.all():
            return ids, per_text
        starts = np.cumsum(per_text) - per_text
        return gather(ids, starts[place], per_text[place]), per_text[place]
