"""Quality rules as a ledger of bits, on DataFrame functions only.

`measure` computes every measurement of a text once, `ledger` adds a long whose bit k says that rule k failed. Policies are versioned lists
of rules and read only the ledger: a policy is a mask, a verdict is `bits & mask = 0`, and what a rule changes (`ablations`) comes from
counts by bit pattern, of which there are few however many documents there are.

Repeated three-word windows are found inside the row, without a shuffle: window hashes with their positions in the low bits are sorted as plain
longs, windows whose hash occurs twice are candidates, and only these are compared as words. So a hash collision costs
time, not correctness.

Defined cases: a null or blank text has no words and measurements of 0; rows are independent, so repeated rows are repeated; further columns
are dropped by `measure` unless named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.sources.tables import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"
PLACE_BITS = 28  # positions of words; what is left of a long holds the window's hash
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")

# Rule k sets bit k where it fails. Integers only, so that every engine agrees. The share of distinct words falls with the length of clean texts, so
# few_distinct_words asks for 15 per cent up to 5,000 words and for the square root of 112.5 n_words beyond; the two meet there, at 750.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("few_distinct_words", "n_words >= 50 AND 100 * n_distinct_words < 15 * n_words AND 2 * n_distinct_words * n_distinct_words < 225 * n_words"),
)
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "upper_case"),
    "v2": (*BASE, "symbols", "duplicate_lines", "upper_case", "word_length", "few_distinct_words"),
}
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`key`, the columns `keep`, and MEASURES as longs."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in (key, *keep)]
    names = [key, *keep]
    step = docs.select(*kept, t.alias("_t"), F.array_remove(F.split(t, SPACE), "").alias("_w"),
                       F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("_lines"))
    # Arrays that a lambda reads by position are columns of an earlier step, so that they are computed once.
    step = step.select(
        *names, F.size("_w").alias("_n"), "_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        _without(F.col("_t"), WHITE).alias("word_chars"), (F.length("_t") - _without(F.col("_t"), SYMBOLS)).alias("n_symbols"),
        (F.length("_t") - _without(F.col("_t"), UPPER)).alias("n_upper"), F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"))
    rest = ["word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    places = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    window = F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    step = step.select(*names, *rest, "_n", "_w", F.size(F.array_distinct("_h")).alias("n_distinct_words"), F.sort_array(window).alias("_s"))

    def hashed(x: Column) -> Column:
        return F.shiftrightunsigned(x, PLACE_BITS)

    twice = F.filter("_s", lambda x, j: F.coalesce(hashed(F.get("_s", j - 1)) == hashed(x), F.lit(False))
                     | F.coalesce(hashed(F.get("_s", j + 1)) == hashed(x), F.lit(False)))
    step = step.select(*names, *rest, "n_distinct_words", "_n", "_w", twice.alias("_c"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    spelled = F.transform("_c", lambda x: F.struct(
        F.concat_ws(" ", F.get("_w", place(x)), F.get("_w", place(x) + 1), F.get("_w", place(x) + 2)).alias("g"), place(x).alias("p")))
    step = step.select(*names, *rest, "n_distinct_words", "_n", F.sort_array(spelled).alias("_e"))
    same = F.filter("_e", lambda x, j: F.coalesce(F.get("_e", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_e", j + 1)["g"] == x["g"], F.lit(False)))
    step = step.select(*names, *rest, "n_distinct_words", "_n", F.sort_array(F.transform(same, lambda x: x["p"])).alias("_p"))
    # Windows cover three words each; of neighbouring windows the first covers only the words before the second.
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    out = step.select(*names, F.col("_n").alias("n_words"), *rest, covered.alias("n_repeat_words"), "n_distinct_words")
    return out.select(*names, *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(measured: DataFrame) -> DataFrame:
    """Adds `fail_bits`, every rule evaluated once, and stores the table: policies read it and never the texts."""
    bits = [F.when(F.expr(sql), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, sql in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return materialise(measured.withColumn("fail_bits", total), "ledger")


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(filled: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many documents fail it, fail it alone, and would be kept without it."""
    mask = mask_of(policy)
    patterns = filled.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(failed & (rest == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


def verdicts(docs: DataFrame, policy: str) -> DataFrame:
    """A row per document: measurements, failure bits, the base verdict and that of the policy."""
    filled = ledger(measure(docs))
    return filled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"),
                         passes(policy).alias("kept"), "fail_bits")


def sql(policy: str) -> str:
    """The same in DuckDB: windows are exploded and counted."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
                 [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
    g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
    rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                 CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words
          FROM w LEFT JOIN rep USING (r)),
    b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask_of('base')}) <> 0 AS base_failed,
           (fail_bits & {mask_of(policy)}) = 0 AS kept, fail_bits FROM b"""
