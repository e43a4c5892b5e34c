"""Minimum spanning trees of mutual reachability for many points: boxes instead of all pairs, and components that grow (Boruvka).

Equal vectors are one point with a weight. Points are ordered by place and cut into cells of at most CELL points with their boxes; vectors, nearest
neighbours and labels lie in files below the shared checkpoint folder, which tasks map into memory and read as far as they need. A task looks for the
neighbours of a cell in the order of the distances of boxes and stops where no box can hold a nearer one, so results are those of all pairs. In a
round every component but the largest finds its lightest edge to another one, at first among the neighbours already known; an edge that was found and
still leads outside bounds the next search. A round more than halves the components, so there are as many rounds as the logarithm of the points. One task a
round and number of samples joins components; it holds a label for each point.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.sources.tables import materialise, shared_folder

CELL, FEW, PART = 256, 8, 32_768  # points of a cell, of one not to be parted at a gap and, about, of a task that places them


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by summed squared differences, so equal vectors are exactly 0 apart."""
    total, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for at in range(0, len(a), 64):  # few enough rows that sums and differences stay in the cache
        some, rows = a[at:at + 64], total[at:at + 64]
        away = np.empty_like(rows)
        for k in range(a.shape[1]):
            np.subtract(some[:, k, None], columns[k], out=away)
            np.multiply(away, away, out=away)
            rows += away
        np.sqrt(rows, out=rows)
    return total


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances between boxes, a hair less than `distances` of points in them can be."""
    apart = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    return np.sqrt((apart * apart).sum(axis=-1)) * (1 - 1e-12)


def _cells(x: np.ndarray, cell: int) -> tuple[np.ndarray, list[int]]:
    """An order of the rows, and the sizes of its cells: halves by the widest column, then parts on either side of a gap of half a cell's width."""
    order, sizes, stack = [], [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= cell:
            some = np.sort(x[rows], axis=0)
            gaps = np.diff(some, axis=0)
            if len(rows) > FEW and 2 * gaps.max() > np.ptp(some, axis=0).max() > 0:
                at, k = np.unravel_index(gaps.argmax(), gaps.shape)
                left = x[rows, k] <= some[at, k]
                stack += [rows[~left], rows[left]]
                continue
            order.append(rows)
            sizes.append(len(rows))
            continue
        widest, half = int(np.ptp(x[rows], axis=0).argmax()), len(rows) // 2
        parts = np.argpartition(x[rows, widest], half)
        stack += [rows[parts[half:]], rows[parts[:half]]]
    return np.concatenate(order), sizes


def _place(batch: pa.RecordBatch) -> np.ndarray:
    """Neighbouring points have like numbers: three bits of every coordinate, the highest of all first."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :20]
    steps, out = np.clip(np.floor((x + 2) * 2), 0, 7).astype(np.int64), np.zeros(len(x), np.int64)
    for bit in (2, 1, 0):
        for k in range(x.shape[1]):
            out = out << 1 | steps[:, k] >> bit & 1
    return out


def _room(path: str, kind: type, *shape: int) -> None:
    """An empty file for parts that tasks write; a repeated task writes the same again."""
    np.lib.format.open_memmap(path, "w+", np.dtype(kind), shape).flush()


def _write(path: str, at: int, values: np.ndarray) -> None:
    file = np.load(path, mmap_mode="r+")
    file[at:at + len(values)] = values
    file.flush()


def _save(path: str, values: np.ndarray) -> None:
    held = f"{path}.{uuid.uuid4().hex}.npy"
    np.save(held, values)
    os.replace(held, path)


class Cells:
    """Where the files are; tasks open them when they need them."""

    def __init__(self, folder: str, samples: Sequence[int]) -> None:
        self.folder, self.samples, self._open = folder, list(samples), {}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "samples": self.samples, "_open": {}}

    def __getattr__(self, name: str) -> np.ndarray:  # ids, weight, x, starts, low, high, near, neighbour, core
        if name.startswith("_"):
            raise AttributeError(name)
        return self.file(name)

    def file(self, name: str) -> np.ndarray:
        if name not in self._open:
            self._open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self._open[name]

    def labels(self, turn: int, k: int, name: str) -> np.ndarray:
        return self.file(f"{turn}-{k}-{name}")

    def range_of(self, i: int) -> slice:
        return slice(int(self.starts[i]), int(self.starts[i + 1]))

    def nearest(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and places of the nearest points of each point of cell `i`, itself first or among equals, and its core distances."""
        mine, k = self.range_of(i), max(self.samples)
        x = np.array(self.x[mine])
        near, neighbour = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
        gap = _gaps(self.low[i], self.high[i], self.low, self.high)
        for j in np.argsort(gap, kind="stable"):
            last = near[:, -1]
            if gap[j] > last.max():
                break
            rows = np.flatnonzero(_gaps(x, x, self.low[j], self.high[j]) < last)
            if not len(rows):
                continue
            other = self.range_of(j)
            d = np.concatenate([near[rows], distances(x[rows], np.array(self.x[other]))], axis=1)
            at = np.concatenate([neighbour[rows], np.broadcast_to(np.arange(other.start, other.stop), (len(rows), other.stop - other.start))], axis=1)
            keep = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            d, at = np.take_along_axis(d, keep, 1), np.take_along_axis(at, keep, 1)
            keep = np.argsort(d, axis=1, kind="stable")
            near[rows], neighbour[rows] = np.take_along_axis(d, keep, 1), np.take_along_axis(at, keep, 1)
        seen = np.cumsum(np.where(neighbour < 0, 0, self.weight[np.maximum(neighbour, 0)]), axis=1)
        core = np.stack([near[np.arange(len(x)), (seen < ms).sum(axis=1)] for ms in self.samples], axis=1)
        return near, neighbour, core

    def outgoing(self, i: int, turn: int, k: int) -> tuple[np.ndarray, ...]:
        """Lighter edges than known so far from the components in cell `i` to others, one each: component, weight, two places."""
        mine, labels = self.range_of(i), self.labels(turn, k, "label")
        pure, largest = self.labels(turn, k, "pure"), int(self.labels(turn, k, "largest")[0])
        label, core = np.array(labels[mine]), np.array(self.core[mine, k])
        which, c = np.unique(label, return_inverse=True)
        if (turn, k) not in self._open:  # a task's own: what a cell finds bounds the search of the task's next ones
            self._open[turn, k] = np.array(self.labels(turn, k, "known"))
        bound = self._open[turn, k][which]
        a, b = np.full(len(which), -1, np.int64), np.full(len(which), -1, np.int64)

        def take(rows: np.ndarray, reach: np.ndarray, places: np.ndarray) -> None:
            at = reach.argmin(axis=1)
            least = reach[np.arange(len(rows)), at]
            better = np.flatnonzero(least < bound[c[rows]])
            better = better[np.argsort(-least[better], kind="stable")]  # of one component the lightest is written last
            bound[c[rows[better]]] = least[better]
            a[c[rows[better]]] = rows[better] + mine.start
            b[c[rows[better]]] = places[at[better]] if places.ndim == 1 else places[better, at[better]]

        near, neighbour = self.near[mine], np.array(self.neighbour[mine])
        known = np.maximum(neighbour, 0)
        reach = np.maximum(np.maximum(near, core[:, None]), self.core[:, k][known])
        reach[(neighbour < 0) | (labels[known] == label[:, None])] = np.inf
        take(np.arange(len(label)), reach, neighbour)
        least = np.where(label == largest, np.inf, np.maximum(core, near[:, -1]))  # what is nearer is among the neighbours
        open_ = least < bound[c]
        if open_.any():
            x = np.array(self.x[mine])
            gap = _gaps(self.low[i], self.high[i], self.low, self.high)
            cells = np.flatnonzero((gap < bound[c[open_]].max()) & ((pure != label[0]) if len(which) == 1 else True))
            for j in cells[np.argsort(gap[cells], kind="stable")]:
                open_ = least < bound[c]
                if not open_.any() or gap[j] >= bound[c[open_]].max():
                    break
                rows = np.flatnonzero(open_ & (label != pure[j]))
                rows = rows[_gaps(x[rows], x[rows], self.low[j], self.high[j]) < bound[c[rows]]]
                if not len(rows):
                    continue
                other = self.range_of(j)
                reach = np.maximum(distances(x[rows], np.array(self.x[other])), core[rows, None])
                np.maximum(reach, self.core[other, k], out=reach)
                reach[labels[other] == label[rows, None]] = np.inf
                take(rows, reach, np.arange(other.start, other.stop))
        found = a >= 0
        self._open[turn, k][which] = bound
        return which[found], bound[found], a[found], b[found]

    def save_labels(self, turn: int, k: int, labels: np.ndarray, known: np.ndarray) -> None:
        starts = np.array(self.starts)
        low, high = np.minimum.reduceat(labels, starts[:-1]), np.maximum.reduceat(labels, starts[:-1])
        files = {"label": labels, "known": known, "pure": np.where(low == high, low, -1), "largest": np.bincount(labels).argmax(keepdims=True)}
        for name, values in files.items():
            _save(f"{self.folder}/{turn}-{k}-{name}.npy", values)

    def joined(self, edges: pd.DataFrame, turn: int, k: int) -> pd.DataFrame:
        """Join components along the lightest edge of each. Gives the edges used (as ids, with the number of components left), and those still to know."""
        labels, count = np.array(self.labels(turn, k, "label")), len(self.labels(turn, k, "known"))
        edges = edges.sort_values(["comp", "w", "a", "b"], kind="stable")
        picks = edges[edges["comp"] != int(self.labels(turn, k, "largest")[0])]  # which was not searched
        picks = picks.drop_duplicates("comp").sort_values(["w", "a", "b"], kind="stable")
        a, b = picks["a"].to_numpy(), picks["b"].to_numpy()
        parent, used = list(range(count)), np.zeros(len(picks), bool)
        for n, (u, v) in enumerate(zip(labels[a].tolist(), labels[b].tolist())):
            u, v = find(parent, u), find(parent, v)
            if u != v:
                parent[u], used[n] = v, True
        roots = np.array(parent)
        while (roots[roots] != roots).any():
            roots = roots[roots]
        left, roots = np.unique(roots, return_inverse=True)
        labels = roots[labels].astype(np.int32)
        of_a, of_b = labels[edges["a"].to_numpy()], labels[edges["b"].to_numpy()]
        turned = edges.assign(comp=of_b, a=edges["b"], b=edges["a"])
        out = pd.concat([edges.assign(comp=of_a)[of_a != of_b], turned[of_a != of_b]]).sort_values(["comp", "w", "a", "b"], kind="stable").drop_duplicates("comp")
        known = np.full(len(left), np.inf)
        known[out["comp"].to_numpy()] = out["w"].to_numpy()
        self.save_labels(turn + 1, k, labels, known)
        tree = pd.DataFrame({"comp": len(left), "w": picks["w"].to_numpy()[used], "a": self.ids[a[used]], "b": self.ids[b[used]], "used": True})
        return pd.concat([tree, out[["comp", "w", "a", "b"]].assign(used=False)])


def _stored(points: DataFrame, cell: int, samples: Sequence[int]) -> Cells:
    """Points (id, vector, weight) written by place, cell by cell."""
    spark, count = points.sparkSession, points.count()
    cells = Cells(f"{shared_folder(spark).rstrip('/')}/cells-{uuid.uuid4().hex}", samples)
    folder = cells.folder
    os.makedirs(folder)

    def numbered(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_place(batch))], ["id", "vector", "weight", "place"])

    def written(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        x = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        order, sizes = _cells(x, cell)
        name, x = uuid.uuid4().hex, x[order]
        first = np.cumsum([0, *sizes[:-1]])
        for kind, values in (("x", x), ("ids", rows["id"].to_numpy()[order]), ("weight", rows["weight"].to_numpy()[order])):
            np.save(f"{folder}/{name}-{kind}.npy", values)
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        yield pa.RecordBatch.from_pydict({"place": pa.array([rows["place"][0].as_py()]), "name": pa.array([name]), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                                          "low": pa.array([low.ravel().tolist()]), "high": pa.array([high.ravel().tolist()])})

    placed = points.select("id", "vector", "weight").mapInArrow(numbered, "id long, vector array<double>, weight long, place long")
    dealt = placed.repartitionByRange(max(1, -(-count // PART)), "place", "id").sortWithinPartitions("place", "id")
    schema = "place long, name string, sizes array<long>, low array<double>, high array<double>"
    parts = sorted(materialise(dealt.mapInArrow(written, schema), "cells").collect(), key=lambda r: (r.place, r.name))  # one row for some PART points
    sizes = np.concatenate([r.sizes for r in parts])
    _save(f"{folder}/starts.npy", np.concatenate([[0], np.cumsum(sizes)]))
    for name in ("low", "high"):
        _save(f"{folder}/{name}.npy", np.concatenate([r[name] for r in parts]).reshape(len(sizes), -1))
    width, most = cells.low.shape[1], max(samples)
    for name, kind, *shape in (("x", float, width), ("ids", np.int64), ("weight", np.int64), ("near", float, most), ("neighbour", np.int32, most), ("core", float, len(samples))):
        _room(f"{folder}/{name}.npy", kind, count, *shape)
    at = np.cumsum([0, *[sum(r.sizes) for r in parts]])
    rows = spark.createDataFrame([(r.name, int(n)) for r, n in zip(parts, at)], "name string, at long").repartition(len(parts))

    def copied(batches):
        for batch in batches:
            for name, place in zip(batch["name"], batch["at"]):
                for kind in ("x", "ids", "weight"):
                    _write(f"{folder}/{kind}.npy", place, np.load(f"{folder}/{name}-{kind}.npy"))
            yield batch

    materialise(rows.mapInPandas(copied, "name string, at long"), "cells")
    return cells


def _over_cells(spark, cells: Cells, run, schema: str) -> DataFrame:
    """`run` for the number of every cell; neighbouring ones in one task."""
    count, tasks = len(cells.low), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(count, 8 * tasks), -(-count // 64))

    def each(batches):
        for batch in batches:
            found = [run(int(i)) for i in batch["id"]]
            yield pd.concat(found) if found else pd.DataFrame()

    return spark.range(0, count, 1, parts).mapInPandas(each, schema)


def _joiner(cells: Cells, turn: int):
    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        return cells.joined(pdf[["comp", "w", "a", "b"]], turn, k).assign(k=k)

    return joined


def trees(points: DataFrame, samples: Sequence[int], cell: int = CELL) -> DataFrame:
    """Edges (a, b, w, min_samples) of a minimum spanning tree under mutual reachability for each of `samples`, from points (id, vector)."""
    spark = points.sparkSession
    same = materialise(points.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "points")
    cells = _stored(same, cell, samples)

    def nearest(i: int) -> pd.DataFrame:
        near, neighbour, core = cells.nearest(i)
        mine = cells.range_of(i)
        for name, values in (("near", near), ("neighbour", neighbour), ("core", core)):
            _write(f"{cells.folder}/{name}.npy", mine.start, values)
        return pd.DataFrame({"id": cells.ids[mine], "core": list(core)})

    core = materialise(_over_cells(spark, cells, nearest, "id long, core array<double>"), "core_distances")
    count, left, turn, known, found = len(cells.ids), list(range(len(samples))), 0, None, []
    for k in left:
        cells.save_labels(0, k, np.arange(count, dtype=np.int32), np.full(count, np.inf))
    while count > 1 and left:
        def outgoing(i: int, turn: int = turn, left: Sequence[int] = tuple(left)) -> pd.DataFrame:
            each = [(k, cells.outgoing(i, turn, k)) for k in left]
            return pd.concat([pd.DataFrame({"k": np.int32(k), "comp": c, "w": w, "a": a, "b": b}) for k, (c, w, a, b) in each])

        schema = "k int, comp long, w double, a long, b long"
        edges = _over_cells(spark, cells, outgoing, schema)
        edges = edges if known is None else edges.unionByName(known)
        done = materialise(edges.groupBy("k").applyInPandas(_joiner(cells, turn), f"{schema}, used boolean"), "joined")
        known = done.where("NOT used").drop("used")
        found.append(done.where("used"))
        state = {r.k: r.left for r in found[-1].groupBy("k").agg(F.min("comp").alias("left")).collect()}
        left, turn = [k for k in left if state[k] > 1], turn + 1
        known = known.where(F.col("k").isin(left)) if left else known
    number = F.array(*[F.lit(int(s)) for s in samples])
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"]
    # a copy of a point lies as far from it as the point's core distance
    several = same.where("weight > 1").select("vector", F.col("id").alias("rep"))
    copies = points.select("id", "vector").join(several, "vector").where("id <> rep").join(core.select(F.col("id").alias("rep"), "core"), "rep")
    copies = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.posexplode("core").alias("k", "w")).select("a", "b", "w", number[F.col("k")].alias("min_samples"))
    for rows in found:
        copies = copies.unionByName(rows.select(*ends, number[F.col("k")].alias("min_samples")))
    return copies
