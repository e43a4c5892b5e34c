"""Near-duplicate texts: b-bit minwise signatures, a multi-index Hamming join, and exact confirmation on whole shingle sets.

A signature has CHUNKS * WIDTH symbols of 16 bits, each the low bits of a minimum hash. Two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols agree, in some chunk, on all but ERRORS symbols (pigeonhole). Allowed errors are enumerated by leaving each
symbol of a chunk out in turn (ERRORS = 1), so such a pair always shares a key. That distance, 31 of 64, lies over five standard deviations
above what a similarity of 0.8 leads to (12.8).

Equal shingle sets are one class from the start, and only one member of each class, its smallest id, is compared. Inside a
bucket (the classes that share a key) every class is compared with the bucket's leader, the member that shares most with others: first with the one
leader that it shares most keys with, then with those that are still in another component. Of
buckets of at most SMALL classes, all pairs that are then in different components are compared too. They are kept out of the groups below, as
nearly all of them are unlike texts that met by chance: these grow faster than the input and would tie most of a large corpus into one group.
No text is fetched for pairs of which more than FAR symbols differ (at a similarity of 0.8, fewer than one pair in 10 ** 13; of lower similarities
more may differ, by the same odds).
In larger buckets that then hold several components, signatures are compared first, two blocks of BLOCK classes at a time in a task, as a common line brings many
unlike texts into one bucket. Components that are near there form groups, and only classes that are near one of another component are taken in: a group is
cut into blocks of about BLOCK classes or BLOCK_SHINGLES shingles, two blocks at a time meet in a task, and only links between different components leave it. So
components are those of all links between classes that share a key. These last two steps take time as the square of such a bucket (64 symbols a pair) and of such a
group (shingles) over BLOCK.

Defined cases: a text without words has an empty set and links to nothing; a text of fewer words than a shingle has one shingle, all its words;
rows with a null id have no component and are kept; rows that share an id are one document, linked if any of its texts is; further
columns are ignored by `near_duplicates` and kept by `without_copies`.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telewatch.llm import common as C
from telewatch.llm.graph import components
from telewatch.sources.tables import materialise

CHUNKS, WIDTH, ERRORS = 16, 4, 1
SYMBOLS = CHUNKS * WIDTH
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
FAR, SMALL = 40, 8
BLOCK, BLOCK_SHINGLES, COLUMNS = 2048, 400_000, 4096  # classes and shingles of a block, columns of a product
_ODD = C.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_ADD = C.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their number."""
    data, offsets = C.text_bytes(column)
    starts, ends, owner = C.word_spans(data, offsets)
    hashes, counts = C.shingle_hashes(C.word_hashes(data, starts, ends), np.bincount(owner, minlength=len(column)).astype(np.int64), size)
    text = np.repeat(np.arange(len(column)), counts)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(column)).astype(np.int64)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint16 [texts, SYMBOLS]; zeros where there is no shingle."""
    out = np.zeros((len(counts), SYMBOLS), np.uint16)
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(hashes * _ODD[k] + _ADD[k], first)
            out[some, k] = (C.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """int64 [texts, SYMBOLS]: for every chunk and every symbol left out of it, chunk, place and the symbols that stay, exactly."""
    s = signature.astype(np.int64).reshape(len(signature), CHUNKS, WIDTH)
    out = np.zeros((len(signature), CHUNKS, WIDTH), np.int64)
    for gone in range(WIDTH):
        key = np.full((len(signature), CHUNKS), 0, np.int64)
        for k in range(WIDTH):
            if k != gone:
                key = key << 16 | s[:, :, k]
        out[:, :, gone] = key | (np.arange(CHUNKS) * WIDTH + gone) << 48
    return out.reshape(len(signature), SYMBOLS)


def profiles(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: set size, two hashes that name the set, and the signature."""
    def run(batch: pa.RecordBatch):
        hashes, counts = shingle_sets(batch.column(1), size)
        names = np.zeros((2, len(counts)), np.uint64)
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            for k in range(2):
                names[k, some] = np.add.reduceat(C.mix(hashes + np.uint64(k)), first)
        sig = signatures(hashes, counts)
        return {"doc_id": batch.column(0), "n_shingles": pa.array(counts), "name1": C.int_array(names[0]), "name2": C.int_array(names[1]),
                "sig": pa.array([r.tobytes() for r in sig], pa.binary())}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return C.map_batches(rows, run, "doc_id long, n_shingles long, name1 long, name2 long, sig binary")


def _keyed(classes: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        k = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
        return {"rep": pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS)), "key": pa.array(k.ravel())}

    return C.map_batches(classes.select("rep", "sig"), run, "rep long, key long")


def _far(percent: int) -> int:
    """How many symbols may differ, FAR at least: fewer than one pair of this similarity in 10 ** 13 differs in more."""
    p = 1 - percent / 100
    share = [comb(SYMBOLS, k) * p ** k * (1 - p) ** (SYMBOLS - k) for k in range(SYMBOLS + 1)]
    return max(FAR, next(d for d in range(SYMBOLS + 1) if sum(share[d + 1:]) < 1e-13))


def _near(pairs: DataFrame, classes: DataFrame, far: int = FAR) -> DataFrame:
    """Pairs (a, leader) of which at most `far` symbols differ."""
    def run(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
        return batch.filter(pa.array((x != y).sum(axis=1) <= far)).select(["a", "leader"])

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("leader"), "leader").select("a", "leader", "sig_a", "sig_leader")
    return C.map_batches(both, run, "a long, leader long")


def _pairs_in_small(members: DataFrame) -> DataFrame:
    """All pairs of classes that share a bucket of at most SMALL classes."""
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("r"))
    pairs = F.expr("flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> struct(x AS a, y AS leader))))")
    return small.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _pairs_of(batch: pa.RecordBatch, size: int, percent: int) -> np.ndarray:
    """Which rows (a, leader, text of a, text of the leader) are linked on their whole sets."""
    leaders = batch.column(1).to_numpy()
    new = np.concatenate(([True], leaders[1:] != leaders[:-1]))  # neighbouring rows often share their leader: take its text apart once
    for i in np.flatnonzero(~new):
        new[i] = batch.column(3)[int(i)] != batch.column(3)[int(i) - 1]
    of = np.cumsum(new) - 1
    (xs, xn), (ys, yn) = shingle_sets(batch.column(2), size), shingle_sets(batch.column(3).take(pa.array(np.flatnonzero(new))), size)
    xe, ye, linked = np.cumsum(xn), np.cumsum(yn), np.zeros(len(of), bool)
    for i, j in enumerate(of):
        common = len(np.intersect1d(xs[xe[i] - xn[i]:xe[i]], ys[ye[j] - yn[j]:ye[j]], assume_unique=True))
        linked[i] = common > 0 and 100 * common >= percent * (xn[i] + yn[j] - common)
    return linked


def _linked_to_leaders(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("leader"), "leader").select("a", "leader", "text_a", "text_leader")
    run = lambda batch: batch.filter(pa.array(_pairs_of(batch, size, percent))).select(["a", "leader"])
    return materialise(C.map_batches(both, run, "a long, leader long"), "linked")


def _block_near(rows: list[dict], far: int) -> tuple[list[int], list[int], list[int]]:
    """Classes of the two blocks of `rows` (or of the only one) that are at most `far` symbols from one of another component: class, component and the
    smallest component that its own reaches over such pairs."""
    first = rows[0]["block"]
    x = [r for r in rows if r["block"] == first]
    y = [r for r in rows if r["block"] != first] or x
    xs, ys = (np.frombuffer(b"".join(r["sig"] for r in side), np.uint16).reshape(-1, SYMBOLS) for side in (x, y))
    of, at = np.unique(np.array([r["component"] for r in x] + [r["component"] for r in y]), return_inverse=True)
    xp, yp, columns = at[:len(x)], at[len(x):], np.ascontiguousarray(ys.T)
    near, meet = [], []
    for low in range(0, len(x) if len(of) > 1 else 0, 64):  # few enough rows that counts stay in the cache
        some = xs[low:low + 64]
        same = np.zeros((len(some), len(y)), np.uint8)
        for k in range(SYMBOLS):
            same += some[:, k, None] == columns[k]
        i, j = np.nonzero((same >= SYMBOLS - far) & (xp[low:low + 64, None] != yp))
        near += [i + low, j if y is x else j + len(x)]
        meet.append(np.unique(xp[i + low] * len(of) + yp[j]))
    members = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
    a, b = np.divmod(np.unique(np.concatenate(meet)), len(of)) if meet else (members, members)
    label = np.arange(len(of))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rep = np.array([r["rep"] for r in x] + [r["rep"] for r in y])
    return rep[members].tolist(), of[at[members]].tolist(), of[label[at[members]]].tolist()


def _near_in_buckets(members: DataFrame, classes: DataFrame, far: int) -> DataFrame:
    """From `members` (key, rep, component, n), classes that are near one of another component in the same bucket, block by block of a bucket: rep,
    component and other, a component that its own reaches over such pairs."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    each = placed.select("key", "rep", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("rep", "component", "block", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("shard"))
    full = each.join(classes.select("rep", "sig"), "rep")

    def run(batches):
        for _, rows in C.by_shard(batches):
            found = _block_near(rows, far)
            if found[0]:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("rep", "component", "other"), found)})

    dealt = full.select("shard", "rep", "component", "block", "sig").repartition("shard").sortWithinPartitions("shard")
    return materialise(dealt.mapInArrow(run, "rep long, component long, other long"), "near")


def _block_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between the two blocks of `rows` (or inside the only one) and between different components, one for each member and component
    that it meets. Common shingles of all pairs are one matrix product, some columns at a time; shingles of one side alone are left out."""
    first = rows[0]["block"]
    x = [r for r in rows if r["block"] == first]
    y = [r for r in rows if r["block"] != first] or x
    (xs, xn), (ys, yn) = (([np.frombuffer(r["shingles"], np.uint64) for r in side], np.array([len(r["shingles"]) // 8 for r in side])) for side in (x, y))
    both, times = np.unique(np.concatenate(ys), return_counts=True)
    xa = np.concatenate(xs)
    both = both[times > 1] if y is x else np.intersect1d(both, xa)
    common = np.zeros((len(x), len(y)), np.float32)

    def places(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        on = both[at] == values if len(both) else np.zeros(len(values), bool)
        row, at = np.repeat(np.arange(len(n)), n)[on], at[on]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (xr, xc), (yr, yc) = places(xa, xn), places(np.concatenate(ys), yn)
    for low in range(0, len(both), COLUMNS):
        parts = []
        for row, at, n in ((xr, xc, len(x)), (yr, yc, len(y))):
            a, b = np.searchsorted(at, (low, low + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            part[row[a:b], at[a:b] - low] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    xp, yp = (np.array([r["component"] for r in side]) for side in (x, y))
    i, j = np.nonzero((100 * common >= percent * (xn[:, None] + yn - common)) & (xp[:, None] != yp))
    rep = np.array([r["rep"] for r in x])
    _, one = np.unique(np.stack([rep[i], yp[j]], 1), axis=0, return_index=True)
    return list(zip(rep[i[one]].tolist(), np.array([r["rep"] for r in y])[j[one]].tolist()))


def _linked_in_groups(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of the same group, from `members` (rep, group, component), block by block."""
    def sets(batch: pa.RecordBatch):
        hashes, counts = shingle_sets(batch.column(1), size)
        return {"rep": batch.column(0), "n": pa.array(counts), "shingles": C.binaries(hashes, counts)}

    members = materialise(members, "grouped")
    some = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    some = materialise(C.map_batches(some, sets, "rep long, n long, shingles binary"), "sets")
    sized = members.join(some.select("rep", "n"), "rep")
    sizes = sized.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = members.join(materialise(sizes, "sizes"), "group").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    each = placed.select("rep", "group", "component", "block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"))
    each = each.select("rep", "component", "block", F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("shard"))
    full = materialise(each, "blocks").join(some, "rep")

    def run(batches):
        for _, rows in C.by_shard(batches):
            links = _block_links(rows, percent)
            if links:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    dealt = full.select("shard", "rep", "component", "block", "shingles").repartition("shard").sortWithinPartitions("shard")
    return materialise(dealt.mapInArrow(run, "a long, b long"), "linked")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, n_shingles, component_id (the smallest id it reaches) and kept (whether that is its own)."""
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialise(profiles(whole, size), "profiles")
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(named.groupBy("name1", "name2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keyed = _keyed(classes)
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    members = materialise(keyed.join(shared, "key"), "members")
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    heaviest = F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("m")
    leaders = materialise(members.join(weight, "rep").groupBy("key").agg(heaviest).select("key", (-F.col("m.minus")).alias("leader")), "leaders")
    led = members.join(leaders, "key").filter("rep <> leader").groupBy(F.col("rep").alias("a"), "leader").agg(F.count("*").alias("keys"))
    led, far = materialise(led, "led"), _far(percent)
    pairs = materialise(_near(led.select("a", "leader"), classes, far), "pairs")
    closest = pairs.join(led, ["a", "leader"]).groupBy("a").agg(F.max(F.struct("keys", (-F.col("leader")).alias("minus"))).alias("m"))
    closest = materialise(closest.select("a", (-F.col("m.minus")).alias("leader")), "closest")
    others = materialise(_near(_pairs_in_small(members), classes, far), "pairs")
    large = members.where(F.col("n") > SMALL).select("key", "rep", "n")
    ids = pairs.unionByName(others).select(F.explode(F.array("a", "leader")).alias("doc_id")).unionByName(large.select(F.col("rep").alias("doc_id"))).distinct()
    texts = materialise(whole.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")  # the ids have no bound
    links = _linked_to_leaders(closest, texts, size, percent)
    found = components(links, "a", "leader")
    label = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    apart = F.coalesce("of_a", "a") != F.coalesce("of_leader", "leader")
    rest = pairs.join(closest, ["a", "leader"], "left_anti").unionByName(others).distinct()
    rest = rest.join(label("a"), "a", "left").join(label("leader"), "leader", "left").where(apart).select("a", "leader")
    links = links.unionByName(_linked_to_leaders(materialise(rest, "pairs"), texts, size, percent)).select("a", F.col("leader").alias("b"))
    found = components(links).withColumnRenamed("node", "rep")

    # Larger buckets that hold several components: classes near one of another component, in groups of components that are near.
    parted = materialise(large.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "parted")
    several = parted.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    near = _near_in_buckets(parted.join(materialise(several, "open"), "key"), classes, far)
    groups = components(near.select(F.col("component").alias("a"), F.col("other").alias("b")).distinct())
    inside = near.select("rep", "component").distinct().join(groups.select(F.col("node").alias("component"), F.col("component").alias("group")), "component")
    found = components(links.unionByName(_linked_in_groups(inside, texts, size, percent))).withColumnRenamed("node", "rep")

    reps = classes.select("name1", "name2", "rep").join(found, "rep", "left").select("name1", "name2", F.coalesce("component", "rep").alias("component"))
    # Rows that share an id but not a text are one document.
    out = rows.join(materialise(reps, "reps"), ["name1", "name2"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of every group, with all its columns; a repeated row stays once."""
    gone = materialise(near_duplicates(docs, size, percent, key, text).filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "copies")
    kept = docs.join(gone, key, "left_anti")
    # rows of one id are compared with rows of the same text alone, so neither a null id nor a common one is a partition by itself
    before = F.lag(F.struct(F.col(text))).over(Window.partitionBy(key, F.xxhash64(text)).orderBy(text))
    repeated, name = F.coalesce(before == F.struct(F.col(text)), F.lit(False)) & F.col(key).isNotNull(), C.free_name(docs, "_repeated")
    return kept.withColumn(name, repeated).filter(~F.col(name)).drop(name)
