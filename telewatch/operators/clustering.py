"""Episode features and density clustering (HDBSCAN: Campello, Moulavi, Sander 2013).

Clustering works on episodes, never on observations, and is exact. Points are cut into blocks of fixed size and
every task sees two blocks. From a pair of blocks only the nearest distances of each point, and then only the
minimum spanning tree of the pair, leave the task: an edge that is not in the tree of its pair cannot be in the
tree of the whole. Trees are merged in two levels, and the hierarchy is read off the n - 1 remaining edges. More than
PAIRED blocks are too many for all pairs; their tree is found by `spanning`, with the same weights. The hierarchy is read in one
task for each setting, which holds some 100 bytes a point; who wants a bound on that sets `max_episodes`.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, tokens
from telewatch.operators.spanning import distances as _distances
from telewatch.operators.spanning import find as _find
from telewatch.operators.spanning import trees as searched_trees
from telewatch.sources.tables import materialise

KNOWN_GROUPS = sorted(set(V.SENSOR_GROUPS.values()))
DETECTORS = sorted(V.DETECTOR_PRIORITY)
NUMERIC = ["n_sensor_groups", "detector_concordance", "log_duration", "max_abs_zscore", "max_iforest_score", "min_rolling_variance"]
FEATURES = [f"sg_{g}" for g in KNOWN_GROUPS] + ["sg_other"] + [f"det_{d}" for d in DETECTORS] + NUMERIC
BLOCK, PAIRED = 1000, 20  # points of a block, and up to how many blocks all pairs of them are compared


def episode_features(episodes: DataFrame) -> DataFrame:
    """Episodes with their 17 numeric features. A missing variance becomes the largest known one."""
    groups = tokens("affected_sensor_groups")
    largest = episodes.agg(F.coalesce(F.max("min_rolling_variance"), F.lit(0.0)).alias("_largest"))
    flags = {f"sg_{g}": F.array_contains(groups, g) for g in KNOWN_GROUPS}
    flags["sg_other"] = F.size(F.array_except(groups, F.array(*map(F.lit, KNOWN_GROUPS)))) > 0
    flags |= {f"det_{d}": F.coalesce(F.col("dominant_detector") == d, F.lit(False)) for d in DETECTORS}
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
               for c in ["n_sensor_groups", "detector_concordance", "max_abs_zscore", "max_iforest_score"]}
    numbers["log_duration"] = F.log1p(F.coalesce(F.col("duration_hours").cast("double"), F.lit(0.0)))
    numbers["min_rolling_variance"] = F.coalesce(F.col("min_rolling_variance"), F.col("_largest"))
    ids = ["station_id", "start_hour", "end_hour"]
    cells = [flags[c].cast("double").alias(c) if c in flags else numbers[c].alias(c) for c in FEATURES]
    return beside(episodes, largest).select(*ids, *cells)


def standardise(features: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = features.agg(*[f(c).alias(f"_{name}_{c}") for c in columns for name, f in [("m", F.avg), ("s", F.stddev_pop)]])

    def scaled(c: str):
        spread = F.col(f"_s_{c}")
        return F.when(spread > 0, (F.col(c) - F.col(f"_m_{c}")) / spread).otherwise(0.0)

    rest = [c for c in features.columns if c not in columns]
    return beside(features, stats).select(*rest, *[scaled(c).alias(c) for c in columns])


# --- work inside tasks ------------------------------------------------------------------------
def _matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(n, -1)


def _nearest(k: int):
    """For the points of both blocks of a pair, the k nearest distances into the other block."""
    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                left, right = _matrix(r.x, len(r.ids)), _matrix(r.y, len(r.ids_of))
                d = _distances(left, right)
                sides = [(r.ids, d)] if r.i == r.j else [(r.ids, d), (r.ids_of, d.T)]
                for ids, m in sides:
                    keep = min(k, m.shape[1])
                    near = np.sort(np.partition(m, keep - 1, axis=1)[:, :keep], axis=1)
                    yield pd.DataFrame({"id": ids, "near": list(near)})
    return run


def _prim(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of a minimum spanning tree of a full matrix of distances."""
    n = len(reach)
    best, parent, open_ = np.full(n, np.inf), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    current, a, b, w = 0, np.zeros(n - 1, dtype=int), np.zeros(n - 1, dtype=int), np.zeros(n - 1)
    for step in range(n - 1):
        open_[current], best[current] = False, np.inf
        row = reach[current]
        closer = np.flatnonzero((row < best) & open_)
        best[closer], parent[closer] = row[closer], current
        current = int(best.argmin())
        a[step], b[step], w[step] = parent[current], current, best[current]
    return a, b, w


def _spanning_trees(samples: Sequence[int]):
    """Minimum spanning trees of the mutual reachability graph of two blocks, one for each of `samples`, from distances worked out once."""
    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                ids, x, core = np.asarray(r.ids), _matrix(r.x, len(r.ids)), _matrix(r.core, len(r.ids))
                if r.i != r.j:
                    ids, core = np.concatenate([ids, r.ids_of]), np.concatenate([core, _matrix(r.core_of, len(r.ids_of))])
                    x = np.concatenate([x, _matrix(r.y, len(r.ids_of))])
                if len(ids) < 2:
                    continue
                apart = _distances(x, x)
                for k, ms in enumerate(samples):
                    reach = np.maximum(apart, core[:, k, None])
                    a, b, w = _prim(np.maximum(reach, core[None, :, k], out=reach))
                    yield pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "w": w, "min_samples": np.int32(ms)})
    return run


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges that a minimum spanning forest keeps, lightest first."""
    edges = edges.sort_values(["w", "a", "b"], kind="stable")
    names, flat = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    ends = flat.reshape(-1, 2)
    parent, keep = array("q", range(len(names))), array("q")
    for position in range(len(ends)):
        ru, rv = _find(parent, int(ends[position, 0])), _find(parent, int(ends[position, 1]))
        if ru != rv:
            parent[ru] = rv
            keep.append(position)
    return edges.iloc[np.asarray(keep)]


def hierarchy_labels(edges: pd.DataFrame, min_cluster_size: int) -> pd.DataFrame:
    """Labels and membership strengths from a spanning tree: condense the hierarchy, keep the most stable clusters."""
    tree = _forest(edges)
    points, flat = np.unique(tree[["a", "b"]].to_numpy(), return_inverse=True)
    n, ends, weights = len(points), flat.reshape(-1, 2), tree["w"].to_numpy()
    # dendrogram: node n + k is made by the k-th lightest edge
    top, parent, size = array("q", range(n)), array("q", range(n)), array("q", [1]) * (2 * n - 1)
    lefts, rights = array("q", [0]) * (2 * n - 1), array("q", [0]) * (2 * n - 1)
    for k in range(n - 1):
        ru, rv = _find(parent, int(ends[k, 0])), _find(parent, int(ends[k, 1]))
        left, right = top[ru], top[rv]
        lefts[n + k], rights[n + k] = left, right
        size[n + k] = size[left] + size[right]
        parent[ru] = rv
        top[rv] = n + k

    def leaves(node):
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                yield x
            else:
                stack += (lefts[x], rights[x])

    # condensed tree: clusters are numbered from the root, points leave a cluster at 1 / distance
    home, leave = np.zeros(n, dtype=int), np.zeros(n)
    above, birth, below = [-1], [0.0], [[]]
    mass, deepest = [0.0], [0.0]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        w = weights[node - n]
        level = 1.0 / w if w > 0 else np.inf
        deepest[cluster] = max(deepest[cluster], level)
        children = lefts[node], rights[node]
        big = [c for c in children if size[c] >= min_cluster_size]
        step = level - birth[cluster]
        step = 0.0 if np.isnan(step) else step
        for c in children:
            if c in big and len(big) == 2:
                mass[cluster] += step * size[c]
                above.append(cluster)
                birth.append(level)
                below.append([])
                mass.append(0.0)
                deepest.append(0.0)
                below[cluster].append(len(above) - 1)
                stack.append((c, len(above) - 1))
            elif c in big:
                stack.append((c, cluster))
            else:
                out = np.fromiter(leaves(c), dtype=int)
                mass[cluster] += step * len(out)
                home[out], leave[out] = cluster, level
    # excess of mass, from the leaves up; the root is never a cluster
    chosen, value = [False] * len(above), list(mass)
    for c in range(len(above) - 1, 0, -1):
        inner = sum(value[d] for d in below[c])
        if below[c] and inner > mass[c]:
            value[c] = inner
        else:
            chosen[c] = True
    owner = [-1] * len(above)
    for c in range(1, len(above)):  # a parent has a smaller number than its children
        owner[c] = owner[above[c]] if owner[above[c]] >= 0 else (c if chosen[c] else -1)
    number = {c: i for i, c in enumerate(sorted({o for o in owner if o >= 0}))}
    owners = np.asarray(owner)[home]
    strength = np.zeros(n)
    for c in number:
        mine, peak = owners == c, deepest[c]
        with np.errstate(invalid="ignore"):
            share = np.minimum(leave[mine], peak) / peak if peak > 0 else np.ones(mine.sum())
        strength[mine] = np.where(np.isinf(leave[mine]) | np.isnan(share), 1.0, share)
    labels = np.asarray([number.get(o, -1) for o in owners], dtype=int)
    return pd.DataFrame({"id": points, "cluster_label": labels, "cluster_probability": np.clip(strength, 0.0, 1.0)})


# --- Spark side -------------------------------------------------------------------------------
def _blocks(points: DataFrame, block: int, core: bool) -> DataFrame:
    """One row per block of at most `block` points."""
    content = F.array_sort(F.collect_list(F.struct("id", "vector", *(["core"] if core else []))))
    rows = points.groupBy(F.floor(F.col("id") / block).cast("int").alias("i")).agg(content.alias("p"))
    extra = [F.flatten(F.col("p.core")).alias("core")] if core else []
    return rows.select("i", F.col("p.id").alias("ids"), F.flatten(F.col("p.vector")).alias("x"), *extra)


def _block_pairs(blocks: DataFrame, count: int) -> DataFrame:
    """Every pair of blocks once; each pair becomes its own piece of work. Both sides are exchanged by pair, so no table of blocks goes through the driver."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(count - 1))))
    right = blocks.withColumnsRenamed({c: f"{'y' if c == 'x' else c + '_of'}" for c in blocks.columns if c != "i"}).withColumnRenamed("i", "j")
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    return left.repartition(tasks, "i", "j").join(right.repartition(tasks, "i", "j").hint("merge"), ["i", "j"])


def spanning_trees(points: DataFrame, count: int, samples: Sequence[int], block: int = BLOCK) -> DataFrame:
    """Edges (a, b, w, min_samples) of the minimum spanning tree under mutual reachability for each of `samples`, from points (id, vector).

    Neighbours are looked for once, as many as the largest of `samples`; the distance to the k-th nearest is read off for each."""
    n_blocks = -(-count // block)
    if n_blocks > PAIRED:
        return searched_trees(points, samples)
    pairs = _block_pairs(materialise(_blocks(points, block, core=False), "blocks"), n_blocks)
    near = pairs.mapInPandas(_nearest(max(samples)), "id long, near array<double>")
    # the point itself is its own first neighbour
    nearest = near.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("d"))
    core = nearest.select("id", F.array(*[F.col("d")[ms - 1] for ms in samples]).alias("core"))
    reach = materialise(points.join(core.hint("merge"), "id"), "core_distances")
    trees = _block_pairs(materialise(_blocks(reach, block, core=True), "blocks"), n_blocks).mapInPandas(
        _spanning_trees(samples), "a long, b long, w double, min_samples int")
    # first merge: pieces of the edge list, cut by the first end, each reduced to a forest
    pieces = max(int(np.sqrt(n_blocks)), 1)
    piece = F.floor(F.col("a") / (block * max(n_blocks // pieces, 1))).cast("int")
    return trees.withColumn("piece", piece).groupBy("min_samples", "piece").applyInPandas(
        lambda pdf: _forest(pdf)[["a", "b", "w", "min_samples"]], "a long, b long, w double, min_samples int")


def spanning_edges(points: DataFrame, count: int, min_samples: int, block: int = BLOCK) -> DataFrame:
    """`spanning_trees` for a single number of samples: a, b, w."""
    return spanning_trees(points, count, [min_samples], block).drop("min_samples")


def numbered_points(episodes: DataFrame, max_episodes: int | None = None) -> tuple[DataFrame, int]:
    """Episodes with `id` and standardised `vector`, stored; fails where there are more than `max_episodes`, if that is given."""
    stored = materialise(episodes, "episodes")
    count = stored.count()
    if max_episodes is not None and count > max_episodes:
        raise ValueError(f"{count} episodes exceed max_episodes={max_episodes}; cluster networks separately or raise it")
    scaled = standardise(episode_features(stored)).withColumn("vector", F.array(*FEATURES)).drop(*FEATURES)
    keys = ["station_id", "start_hour", "end_hour"]
    order = W.orderBy(*keys)  # one task, like the hierarchy
    ids = scaled.withColumn("id", F.row_number().over(order).cast("long") - 1)
    return materialise(stored.join(ids.hint("merge"), keys), "numbered_episodes"), count


def label_sweep(points: DataFrame, count: int, settings: Sequence[tuple[int, int]]) -> DataFrame:
    """(min_cluster_size, min_samples, id, cluster_label, cluster_probability) for each setting.

    The spanning tree depends on min_samples only and is shared by the cluster sizes; all trees come from one pass over the pairs of blocks.
    """
    samples = sorted({s for _, s in settings})
    for ms in samples:
        if ms > count:
            raise ValueError(f"min_samples={ms} exceeds the number of episodes {count}")
    edges = spanning_trees(points.select("id", "vector"), count, samples)
    sizes = F.create_map(*[x for s in samples for x in (F.lit(s), F.array(*[F.lit(c) for c, t in settings if t == s]))])
    found = edges.select("*", F.explode(sizes[F.col("min_samples")]).alias("min_cluster_size"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        size, samples = int(pdf["min_cluster_size"].iloc[0]), int(pdf["min_samples"].iloc[0])
        out = hierarchy_labels(pdf[["a", "b", "w"]], size)
        return out.assign(min_cluster_size=size, min_samples=samples)

    schema = "id long, cluster_label int, cluster_probability double, min_cluster_size int, min_samples int"
    return found.groupBy("min_cluster_size", "min_samples").applyInPandas(label, schema)


def cluster_episodes(
    episodes: DataFrame, min_cluster_size: int = V.MIN_CLUSTER_SIZE, min_samples: int = V.MIN_SAMPLES,
    max_episodes: int | None = None,
) -> DataFrame:
    """Episodes with `cluster_label` (-1 is noise) and `cluster_probability`. No episodes give no rows."""
    points, count = numbered_points(episodes, max_episodes)
    blank = points.drop("id", "vector")
    if count < 2:
        return blank.withColumn("cluster_label", F.lit(-1)).withColumn("cluster_probability", F.lit(0.0))
    labels = label_sweep(points, count, [(min_cluster_size, min_samples)]).drop("min_cluster_size", "min_samples")
    return points.join(labels.hint("merge"), "id").select(*blank.columns, "cluster_label", "cluster_probability")
