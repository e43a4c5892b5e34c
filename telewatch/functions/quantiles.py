"""Exact quantiles.

`percentile` keeps every distinct value of a group in one task. That is right where the group is bounded
(the hours of one station, the events of one window), and wrong for a pooled channel, where one group may
hold most of the table. `pooled_quantiles` is exact there too, by counted refinement. A first round cuts the range that holds the wanted rank
into `BINS` equal bins and counts them in one pass; the bin with the rank becomes the next range. If values crowd so that it holds more than a
sixteenth of the rows, a sketch of the range says where to cut it, the rows below, at, between and above the cuts are counted, and the
part with the rank becomes the next range; such rounds and those of bins take turns. A round sends bins, or sketches and five
counts, per key and task, whatever the table holds. When a range holds no more than `BOUND` rows, these are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.sources.tables import materialise

GRID, ACCURACY, BOUND = 256, 5_000, 10_000
SALTS, BINS = 32, 4096


def median(value: str | Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def pooled_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, few_keys: bool = True) -> DataFrame:
    """One row per key with the linearly interpolated quantile `q` of its `value`s."""
    return pooled_quantiles(df, keys, {out: (F.col(value), q)}, few_keys)


def pooled_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]], few_keys: bool = True,
    grid: int = GRID, accuracy: int = ACCURACY, bound: int = BOUND,
) -> DataFrame:
    """One row per key with a column for each of `wanted`: the linearly interpolated quantile of the values that are neither null nor NaN.

    All of `wanted` are refined side by side; a round reads `df` once. `few_keys` says that the keys are a fixed vocabulary or a calendar, so that
    the ranges (one row per key) may be broadcast; otherwise ranges and rows meet on key and a salt, which spreads a key that holds much of the table.
    """
    keys, by = list(keys), [*keys, "_m"]
    values = [c.cast("double") for c, _ in wanted.values()]
    cells = [F.posexplode(F.array(*values)).alias("_m", "_v")] if len(values) > 1 else [F.lit(0).alias("_m"), values[0].alias("_v")]
    data = df.select(*keys, *cells).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    share = F.array(*[F.lit(q) for _, q in wanted.values()])[F.col("_m")]
    ranges = materialise(data.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(
        *by, (share * (F.col("_n") - 1)).alias("_pos"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_a"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_b"),
        F.monotonically_increasing_id().alias("_r")), "quantile_ranges")

    def within(some: DataFrame) -> DataFrame:
        """Rows of `data` inside the ranges of `some`."""
        if few_keys:
            met = data.join(F.broadcast(some), by)
        else:
            salt = F.pmod(F.xxhash64("_v", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
            each = some.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = data.withColumn("_salt", salt).join(each, [*by, "_salt"])
        return met.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    def around(counted: DataFrame, order: str, carried: Sequence[str]) -> DataFrame:
        """Of counted rows in order: what holds the ranks on both sides of the wanted place."""
        upto = F.sum("_c").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))  # `BINS` rows, or `bound`
        ranked = counted.withColumn("_from", F.col("_below") + upto - F.col("_c"))
        here = {s: (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c")) for s, rank in (("l", F.floor("_pos")), ("g", F.ceil("_pos")))}
        return ranked.groupBy(*by, "_pos", "_r").agg(*[F.max(F.when(on, F.struct(*carried))).alias(f"_{s}") for s, on in here.items()])

    open_ = F.col("_a").isNull() & (F.col("_inside") > bound)
    v, binned = F.col("_v"), True
    while (still := ranges.where(open_).agg(F.sum("_inside")).first()[0]) is not None:
        if binned:  # halves, so that no range is too wide for a number
            share_of = F.nanvl((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0))
            place, met = F.least(F.floor(share_of * BINS), F.lit(BINS - 1)), within(ranges.where(open_))
        else:
            here = within(ranges.where(open_)).withColumn("_at", F.floor((F.col("_pos") - F.col("_below")) / (F.col("_inside") - 1) * grid))
            # the sketch only proposes where to cut; what is counted is counted exactly, so a bad cut costs a round and no more
            edges = here.groupBy(*by, "_at").agg(F.percentile_approx("_v", [k / grid for k in range(grid + 1)], accuracy).alias("_e"))
            cuts = edges.select(*by, F.get("_e", F.greatest(F.col("_at") - 1, F.lit(0)).cast("int")).alias("_low"),
                                F.get("_e", F.least(F.col("_at") + 2, F.lit(grid)).cast("int")).alias("_high"))
            place = F.when(v < F.col("_low"), 0).when(v == F.col("_low"), 1).when(v < F.col("_high"), 2).when(v == F.col("_high"), 3).otherwise(4)
            met = within(ranges.where(open_).join(cuts, by))
        # rows are counted by the number of their range: comparing whole keys is what most of a round would go into
        counted = met.groupBy("_r", place.alias("_bin")).agg(F.count("_v").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        counted = counted.join(ranges.select("_r", *by, "_pos", "_below"), "_r")
        found = around(counted, "_bin", ["_bin", "_c", "_from", "_min", "_max"])
        # both ranks in one part: go on in it; in two: the last value of the one and the first of the other are known
        done = (F.col("_l._bin") != F.col("_g._bin")) | (F.col("_l._min") == F.col("_l._max"))
        closer = found.select(
            *by, "_pos", F.col("_l._min").alias("_lo"), F.col("_l._max").alias("_hi"), F.col("_l._from").alias("_below"), F.col("_l._c").alias("_inside"),
            F.when(done, F.col("_l._max")).alias("_a"), F.when(done, F.col("_g._min")).alias("_b"), "_r")
        ranges = materialise(ranges.where(~open_).unionByName(closer), "quantile_ranges")
        left = ranges.where(open_).agg(F.sum("_inside")).first()[0] or 0
        binned = not binned or left * 16 <= still
    rest = within(ranges.where("_a IS NULL")).groupBy(*by, "_r", "_pos", "_below", "_v").agg(F.count("_v").alias("_c"))
    last = around(rest, "_v", ["_v"]).select(*by, "_pos", F.col("_l._v").alias("_a"), F.col("_g._v").alias("_b"))
    both = ranges.where("_a IS NOT NULL").select(*by, "_pos", "_a", "_b").unionByName(last)
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between)
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == i, exact)).alias(out) for i, out in enumerate(wanted)])
