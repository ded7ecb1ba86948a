"""Document fingerprints by one-permutation MinHash, in built-in functions only.

The five-word shingles of a text are hashed once. The top bits of a hash name its bin, and
each bin keeps its smallest hash. An empty bin takes over a full bin that a fixed sequence
of hashes of the empty bin's number reaches first (optimal densification), so likeness
stays unbiased. The low BITS bits of each bin are stored as hex. Likeness is the share of
equal bins, corrected for the 2**-BITS that agree by chance.

Rules: a null text is empty. A text of fewer than five words has one shingle, all of it;
an empty one too, so empties have equal fingerprints. Texts are compared in ascending
doc_id (null first; ties by text). Repeated rows count each. An empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import let, size_of, text_or_empty

WORDS, BINS, BITS, TRIES = 5, 256, 8, 8
_LEAST = -(2**63)


def _donors() -> list[int]:
    """TRIES bins that each bin may take over, by rule."""
    return [xxhash.xxh64_intdigest(f"{j} {t}") % BINS for j in range(BINS) for t in range(TRIES)]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def shingle_hashes(words: Column) -> Column:
    """Hashes of the runs of WORDS words; of the whole where there are fewer."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    return F.when(F.size(words) < WORDS, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), runs))


def bins_of(hashes: Column) -> Column:
    """The BINS low parts of the smallest hash in each bin, empty bins filled."""

    def place(x: Column) -> Column:
        return (F.shiftright(x, 56) + 128).cast("int")

    def marker(q: int):
        """Sets the bit of a hash's bin in the q-th mask of 64 bins."""
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), place(x).bitwiseAND(F.lit(63)))
        return lambda acc, x: F.when(F.shiftright(place(x), 6) == q, acc.bitwiseOR(bit(x))).otherwise(acc)

    def filled(m: Column) -> Column:
        masks = F.array(*[F.aggregate(m, F.lit(0).cast("long"), marker(q)) for q in range(BINS // 64)])
        counted = lambda k: F.array(F.lit(0), *[sum((F.bit_count(F.get(k, F.lit(i))) for i in range(1, q + 1)), F.bit_count(F.get(k, F.lit(0)))) for q in range(BINS // 64 - 1)])
        return let(masks, lambda k: let(counted(k), lambda c: dense(m, k, c)))

    def dense(m: Column, masks: Column, counts: Column) -> Column:
        bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j.bitwiseAND(F.lit(63)))
        below = lambda j: F.call_function("shiftleft", F.lit(-1).cast("long"), j.bitwiseAND(F.lit(63)))
        word = lambda j: F.get(masks, F.shiftright(j, 6))
        full = lambda j: word(j).bitwiseAND(bit(j)) != 0
        low = lambda j: F.get(m, F.get(counts, F.shiftright(j, 6)) + F.bit_count(word(j).bitwiseAND(F.bitwise_not(below(j)))))
        more = lambda j: F.transform(F.sequence(F.lit(1), F.lit(8 * TRIES)), lambda t: F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int"))
        donor = lambda j: F.coalesce(F.get(F.filter(F.slice(F.lit(_donors()), j * TRIES + 1, TRIES), full), F.lit(0)), F.get(F.filter(more(j), full), F.lit(0)))
        # where all tries miss, few bins are full: one of them by rank
        taken = lambda j: let(donor(j), lambda d: F.when(d.isNotNull(), low(d)).otherwise(F.get(m, F.pmod(F.xxhash64(j), F.size(m)).cast("int"))))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.when(full(j), low(j)).otherwise(taken(j)))

    def lowest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    whole = let(let(F.sort_array(hashes), lowest), lambda m: F.when(F.size(m) == BINS, m).otherwise(filled(m)))
    return F.transform(whole, lambda x: x.bitwiseAND(F.lit(2**BITS - 1)).cast("short"))


def fingerprint_bins(text: Column) -> Column:
    return let(let(word_array(text), shingle_hashes), bins_of)


def packed(bins: Column) -> Column:
    """Two hex digits a bin."""
    return F.array_join(F.transform(bins, lambda x: F.substring(F.hex(x + F.lit(2**BITS)), 2, BITS // 4)), "")


#: Bytes of texts that a range aims at, and ranges at most.
RANGE_BYTES, MOST_RANGES = 8 << 20, 50_000


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles from their bins."""
    equal = F.size(F.filter(a, lambda x, i: x == F.get(b, i))) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def with_next(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with next_<column>: that of the row that follows in (key, columns[0]); the last
    is followed by the first. Rows are dealt out by ranges of key, and the first rows of
    each range also go to the range before; only the ranges' lowest keys reach the driver."""
    spark = rows.sparkSession
    parts = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of(rows.select(*[c for c in columns if c != "bins"])) // RANGE_BYTES)))
    ranges = rows.select(key).repartitionByRange(parts, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low"))
    lows = sorted(r.low for r in ranges.collect())
    if not lows:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    n = len(lows)
    step = f"aggregate(array_repeat(0, {n.bit_length()}), named_struct('lo', 0, 'hi', {n}), (s, x) -> IF(get(lows, CAST((s.lo + s.hi) DIV 2 AS INT)) <= {key}, named_struct('lo', CAST((s.lo + s.hi) DIV 2 AS INT), 'hi', s.hi), named_struct('lo', s.lo, 'hi', CAST((s.lo + s.hi) DIV 2 AS INT)))).lo"
    dealt = rows.withColumn("_range", F.expr(step.replace("lows", "array(" + ",".join(f"{x}L" if x != _LEAST else "(-9223372036854775807L - 1L)" for x in lows) + ")")))
    first = F.get(F.lit(lows), F.col("_range")) == F.col(key)
    here, before = F.struct(F.col("_range").alias("part"), F.lit(0).alias("late")), F.struct(F.pmod(F.col("_range") - 1, F.lit(n)).cast("int").alias("part"), F.lit(1).alias("late"))
    spread = dealt.withColumn("_at", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))).select("*", "_at.part", "_at.late").drop("_at", "_range")
    order = Window.partitionBy("part").orderBy("late", key, columns[0])
    return spread.select(*rows.columns, "late", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("late = 0").drop("late")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A text's edited form has its last floor(n_chars / 2) code
    points replaced by the first as many, or all, of the next document."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("bins", fingerprint_bins(F.col("text")))
    rows = with_next(rows, "key", ["text", "bins"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "bins", "next_bins", edited.alias("edited"))
    rows = rows.withColumn("edited_bins", fingerprint_bins(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
