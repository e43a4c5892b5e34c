"""Passages of a benchmark in documents, on DataFrame functions only.

A window of a document is as long as the benchmark item it may hold, in words. Windows lie where a shared five-word shingle puts the
item's first word: a window without one has similarity 0. (An item of fewer words is one shingle, and windows of its length are taken.) Equal windows are examined once. Each gets a 64-bit SimHash of its shingles,
repeated shingles weighing more, and meets the items of its length in a multi-index Hamming join: two fingerprints that differ in at most
`RADIUS` bits differ in at most ERRORS bits of some block (pigeonhole), and all such variants of the items' blocks are enumerated. Candidates
are verified by the exact weighted similarity of their shingles, sum of least counts over sum of greatest counts.

The shingles of the items are broadcast in blocks of at most BROADCAST_ROWS rows, each against all documents, so a benchmark of any size works.

Defined cases: null and blank texts hold nothing, and blank items are held by nothing; a text or item of fewer than five words has one
shingle, all its words; a document shorter than an item is one window; equal items are each reported; rows that share an id are reported under
that id; a document without an id is reported with a null id, and `clean` removes just that row; further columns are ignored by `leaks`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.llm.common import free_name
from telewatch.llm.rules import SPACE, UPPER
from telewatch.sources.tables import materialise

SHINGLE, PERCENT = 5, 80
BLOCKS, BLOCK_BITS, ERRORS = 8, 8, 2
RADIUS = BLOCKS * (ERRORS + 1) - 1  # at a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3
BROADCAST_ROWS = 500_000  # shingles of items that are broadcast at once; some 20 MB


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower()), SPACE), "")


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _with_shingles(df: DataFrame, *keep: str) -> DataFrame:
    """From words `w`: `s`, the hash of the shingle at each place. Words past the end are null, which the hash leaves out."""
    step = df.select(*keep, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("_h"))
    each = F.transform(_places(F.size("w")), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)]))
    return step.select(*keep, "w", each.alias("s"))


def _grams(words: str) -> Column:
    return F.transform(_places(F.size(words)), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE)))


def _fingerprint(grams: str) -> Column:
    """Bit k is the sign of the sum of the shingles' votes for it."""
    def votes(k: Column) -> Column:
        return F.aggregate(grams, F.lit(0), lambda a, g: a + F.when(F.expr("1L") == F.call_function("shiftright", g, k).bitwiseAND(F.lit(1)), 1).otherwise(-1))

    bit = lambda k: F.when(votes(k) > 0, F.call_function("shiftleft", F.expr("1L"), k)).otherwise(F.expr("0L"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.expr("0L"), lambda a, k: a.bitwiseOR(bit(k)))


def _blocks(df: DataFrame, errors: int, *keep: str) -> DataFrame:
    """A row per block of `fp` and per variant of it with at most `errors` bits changed: `block`, `value`."""
    flips = [sum(1 << b for b in some) for n in range(errors + 1) for some in combinations(range(BLOCK_BITS), n)]
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * BLOCK_BITS).bitwiseAND(F.lit(255)).alias("v"))
                                for k in range(BLOCKS)]))
    step = df.select(*keep, parts.alias("p")).select(*keep, "p.block", F.col("p.v").alias("v"), F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    return step.select(*keep, "block", F.col("v").bitwiseXOR(F.col("flip").cast("long")).alias("value"))


def row_name(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))


def _windows(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """row, doc_id, size, start and words of every window that a shared shingle points to."""
    source = docs.select(row_name(key, text).alias("row"), F.col(f"`{key}`").alias("doc_id"), _words(F.col(f"`{text}`")).alias("w"))
    # an item of fewer words than a shingle has one shingle, all its words; texts of any length are read at that length too
    short = sorted(r.n for r in items.select(F.size("w").alias("n")).filter(F.col("n") < SHINGLE).distinct().collect())  # at most four
    at = F.transform("s", lambda x, i: F.struct(i.cast("int").alias("place"), x.alias("shingle")))

    def runs(n: int) -> Column:
        """Every run of n words, in a text that has them."""
        places = F.sequence(F.lit(0), F.greatest(F.size("h") - n, F.lit(0)))
        each = F.transform(places, lambda i: F.struct(i.cast("int").alias("place"), F.xxhash64(*[F.get("h", i + k) for k in range(n)]).alias("shingle")))
        return F.when(F.size("h") >= n, each).otherwise(F.slice(each, 1, 0))

    shingles = _with_shingles(source, "row", "doc_id")
    if short:
        hashed = shingles.select("row", "doc_id", "w", "s", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
        each = hashed.select("row", "doc_id", "w", F.explode(F.concat(at, *[runs(n) for n in short])).alias("x"))
        shingles = each.select("row", "doc_id", "w", "x.place", "x.shingle")
    else:
        shingles = shingles.select("row", "doc_id", "w", F.posexplode_outer("s").alias("place", "shingle"))
    wanted = items.select(F.size("w").alias("size"), F.posexplode("s").alias("offset", "shingle")).distinct()
    blocks = max(1, -(-wanted.count() // BROADCAST_ROWS))
    found = None
    for k in range(blocks):
        some = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("shingle", "offset", "size"), F.lit(blocks)) == k)
        start = F.greatest(F.least(F.col("place") - F.col("offset"), F.size("w") - F.col("size")), F.lit(0))
        hits = shingles.join(F.broadcast(some), "shingle").select("row", "doc_id", "size", start.alias("start"), "w")
        part = hits.select("row", "doc_id", "size", "start", F.concat_ws(" ", F.slice("w", F.col("start") + 1, F.col("size"))).alias("window"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item that it holds: row (a name of the document's row), doc_id, item_id, similarity and first word of the best window."""
    items = benchmark.select(F.col(f"`{item_key}`").alias("item_id"), _words(F.col(f"`{item_text}`")).alias("w")).filter(F.size("w") > 0)
    items = materialise(_with_shingles(items, "item_id"), "items")
    windows = materialise(_windows(docs, items, key, text), "windows")
    # Equal windows are one text from here on, and so are equal items.
    texts = windows.select("size", "window").distinct().withColumn("w", F.split("window", " "))
    texts = materialise(_with_shingles(texts, "size", "window").select("size", "window", _fingerprint("s").alias("fp")), "fingerprints")
    item_texts = items.select(F.size("w").alias("size"), F.concat_ws(" ", "w").alias("item"), "s").dropDuplicates(["item"]).withColumn("fp", _fingerprint("s"))
    item_texts = materialise(item_texts.drop("s"), "item_fingerprints")
    near = _blocks(texts, 0, "size", "window", "fp").join(
        _blocks(item_texts, ERRORS, "size", "item", "fp").withColumnRenamed("fp", "item_fp"), ["size", "block", "value"])
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("window", "item").distinct()
    near = materialise(near, "candidates")

    def counted(side: str) -> DataFrame:
        split = near.select(side).distinct().withColumn("w", F.split(side, " "))
        return split.select(side, F.explode_outer(_grams("w")).alias("gram")).groupBy(side, "gram").agg(F.count("*").alias(f"n_{side}"))

    def size_of(side: str) -> Column:
        return F.greatest(F.size(F.split(side, " ")) - SHINGLE + 1, F.lit(1))

    both = near.join(counted("window"), "window").join(counted("item"), ["item", "gram"])
    same = both.groupBy("window", "item").agg(F.sum(F.least("n_window", "n_item")).alias("same"))
    union = size_of("window") + size_of("item") - F.col("same")
    held = same.filter(100 * F.col("same") >= PERCENT * union).select("window", "item", (F.col("same") / union).alias("similarity"))
    ids = items.select("item_id", F.concat_ws(" ", "w").alias("item"))
    held = materialise(held.join(ids, "item"), "held").select("window", "item_id", "similarity")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("minus")))
    out = windows.join(held, "window").groupBy("row", "doc_id", "item_id").agg(best.alias("b"))
    return out.select("row", "doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.minus")).cast("long").alias("start"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and start of every item held; rows that share an id are one document."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("minus")))
    out = leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.minus")).alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    name = free_name(docs, "_row")
    held = materialise(leaks(docs, benchmark, key, text).select(F.col("row").alias(name)).distinct(), "leaks")
    return docs.withColumn(name, row_name(key, text)).join(held, name, "left_anti").drop(name)


SQL = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
    ds AS (SELECT doc_id, w, p, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) AS p FROM d WHERE len(w) > 0)
           UNION ALL SELECT doc_id, w, p, array_to_string(w[p + 1:p + m], ' ') FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS p
             FROM d JOIN (SELECT DISTINCT len(w) AS m FROM i WHERE len(w) BETWEEN 1 AND {SHINGLE - 1}) ON len(d.w) >= m)),
    i_s AS (SELECT item_id, w, len(w) AS size, p, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS g
           FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) AS p FROM i WHERE len(w) > 0)),
    hit AS (SELECT DISTINCT doc_id, item_id, size, start, w[start + 1:start + size] AS w
            FROM (SELECT ds.doc_id, ds.w, i_s.item_id, i_s.size, greatest(least(ds.p - i_s.p, len(ds.w) - i_s.size), 0) AS start
                  FROM ds JOIN i_s ON ds.g = i_s.g)),
    hg AS (SELECT doc_id, item_id, start, g, count(*) AS n FROM (SELECT doc_id, item_id, start, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS g
           FROM (SELECT doc_id, item_id, start, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) AS p FROM hit)) GROUP BY ALL),
    ig AS (SELECT item_id, g, count(*) AS n FROM i_s GROUP BY ALL),
    same AS (SELECT doc_id, item_id, start, sum(least(hg.n, ig.n)) AS same FROM hg JOIN ig USING (item_id, g) GROUP BY ALL),
    sizes AS (SELECT doc_id, item_id, start, greatest(len(w) - {SHINGLE - 1}, 1) + greatest(size - {SHINGLE - 1}, 1) AS total FROM hit),
    sim AS (SELECT doc_id, item_id, start, same / (total - same) AS similarity FROM same JOIN sizes USING (doc_id, item_id, start)
            WHERE 100 * same >= {PERCENT} * (total - same))
    SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(arg_min(start, (-similarity, start)) AS BIGINT) AS start FROM sim GROUP BY doc_id, item_id"""
