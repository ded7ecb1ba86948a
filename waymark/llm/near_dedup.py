"""Near-dedup by Order MinHash and banded alignment.

A text's k-mers are runs of five lower-case words, labelled with how often the same run
came before. For each of SKETCHES seeds the PICKED k-mers of smallest hash are taken and
kept in text order; the hash of that tuple is one key. Texts of few k-mers (FEW or fewer)
take only FEW_PICKED; those of at least FEW_FROM, 0.8 of FEW, have keys of both kinds, so
that any two texts at 0.8 have keys of one kind. Texts that share a key are candidates.

With similarity s of the labelled k-mers a key is shared with a chance near s**PICKED, so
at 0.8 a long pair shares none of 30 with a chance of 1.1e-4 (16 k-mers against 20:
9.6e-4; 4 against 5: 2e-7). Labels count repeats, so texts of repeated lines, whose sets are
closer than their labelled k-mers, are missed more often.

Each text of a bucket (texts that share a key) first meets the bucket's leader, the text
whose own buckets are largest (an original shares most with its copies). The links among
these give first classes. Then every pair of a bucket that lies in different classes is
checked or ruled out: in a bucket of at most SMALL texts all of them are checked; the
texts of larger ones go through a filter that loses no pair at `threshold`. With the
shingles of each in one order, rarest first, two such texts share one among the first fifth
of each, near enough to the front that what follows can still make up the overlap. Texts of
one class, size and place are compared as one, so that work grows with the texts of a group
and not with its square; only pairs that pass are written out.

A candidate pair is a link when the five-word shingles of the two have a Jaccard
similarity of `threshold` or more and the words, aligned in a band, an edit similarity
of `threshold` or more too: texts with the same parts in another order aren't copies.
Links are closed to classes by large-star and small-star rounds, written each.

Rules: a null text is empty; equal texts are one node, so empties are one class; a text of
fewer than five words has one shingle, all of it. A class's id is its smallest doc_id
(null if it has none); that row stays, of repeated rows one. An empty table gives no rows.
Other columns are ignored. Texts are told apart by 128 bits of their SHA-256.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import WordHashes, discard, materialise
from waymark.llm.exact_dedup import digest, with_groups
from waymark.plans.star import star_components

WORDS, SKETCHES, PICKED, REACH = 5, 30, 6, 128
FEW, FEW_FROM, FEW_PICKED = 20, 16, 3
#: Buckets compared in full; texts that a block of a larger one aims at.
SMALL, PART = 32, 256
#: Bytes of words and shingles that one matrix of hashes takes at most.
BLOCK = 32_000_000

_rng = np.random.Generator(np.random.PCG64(20))
_FLIP = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, PICKED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, in order; one of the whole if it is shorter."""
    if len(h) < WORDS:
        return mixed(np.array([np.sum(h * _STEP[: len(h)], dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    n = len(h) - WORDS + 1
    total = h[:n] * _STEP[0]
    for i in range(1, WORDS):
        total = total + h[i : n + i] * _STEP[i]
    return mixed(total)


def labelled(s: np.ndarray) -> np.ndarray:
    """A hash of each shingle and how often it came before."""
    order = np.argsort(s, kind="stable")
    ranked, at = s[order], np.arange(len(s))
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    seen = np.empty(len(s), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mixed(s + seen * _MIX)


def lowest(low: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest values of each row, ascending by place."""
    n = low.shape[1]
    if n >= 16 * k:
        row, col = np.nonzero(low < np.uint64(8 * k * (2**64 // n)))
        counts = np.bincount(row, minlength=len(low))
        if counts.min() >= k:
            order = np.lexsort((low[row, col], row))
            return np.sort(col[order][(np.cumsum(counts) - counts)[:, None] + np.arange(k)], axis=1)
    return np.sort(np.argpartition(low, k - 1, axis=1)[:, :k], axis=1)


def sketch(s: np.ndarray, picked: int) -> np.ndarray:
    """SKETCHES order-min-hashes of a text's shingles."""
    label = labelled(s)
    if len(s) <= picked:
        at = np.tile(np.arange(len(s)), (SKETCHES, 1))
    else:
        rows = max(1, BLOCK // (8 * len(s)))
        at = np.concatenate([lowest((label[None, :] ^ _FLIP[i : i + rows, None]) * _TIMES[i : i + rows, None], picked) for i in range(0, SKETCHES, rows)])
    return mixed((label[at] * _PLACE[: at.shape[1]]).sum(axis=1, dtype=np.uint64))


def keys_of(s: np.ndarray) -> np.ndarray:
    """The keys of a text: SKETCHES of one kind, or of both."""
    kinds = [p for p, fits in ((FEW_PICKED, len(s) <= FEW), (PICKED, len(s) >= FEW_FROM)) if fits]
    return np.concatenate([mixed(sketch(s, p) + _SEED * np.uint64(2 * p + 1)) for p in kinds]).view(np.int64)


def banded_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits that turn a into b, if `most` or fewer. Up to REACH edits the diagonals of
    a band are followed; beyond, the band is filled row by row and doubles until it fits."""
    while len(a) and len(b) and a[0] == b[0]:
        same = int(np.argmin(a[: len(b)] == b[: len(a)])) or min(len(a), len(b))
        a, b = a[same:], b[same:]
    while len(a) and len(b) and a[-1] == b[-1]:
        n = min(len(a), len(b))
        same = int(np.argmin(a[::-1][:n] == b[::-1][:n])) or n
        a, b = a[: len(a) - same], b[: len(b) - same]
    if not len(a) or not len(b):
        return max(len(a), len(b)) if max(len(a), len(b)) <= most else None
    found = along_diagonals(a, b, min(most, REACH))
    if found is not None or most <= REACH:
        return found
    band = min(most, max(2 * REACH, abs(len(a) - len(b))))
    while True:
        d = in_band(a, b, band)
        if d is not None and d <= band:
            return d if d <= most else None
        if band >= most:
            return None
        band = min(most, 2 * band)


def along_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance, if `most` or fewer, by how far each diagonal of the band gets with
    0, 1, ... edits: quick where edits are few."""
    n, m = len(a), len(b)
    x, y = a.tolist(), b.tolist()

    def slide(i: int, k: int) -> int:
        if i >= n or i + k >= m or x[i] != y[i + k]:
            return i
        size = 16
        while (size := min(size, n - i, m - k - i)) > 0:
            differ = a[i : i + size] != b[i + k : i + k + size]
            p = int(differ.argmax())
            if differ[p]:
                return i + p
            i, size = i + size, 4 * size
        return i

    goal, far = m - n, {0: slide(0, 0)}
    for d in range(most + 1):
        if far.get(goal, -1) >= n:
            return d
        new = {}
        for k in range(-d - 1, d + 2):
            i = max(far.get(k, -2) + 1, far.get(k + 1, -2) + 1, far.get(k - 1, -2))
            if i >= 0 and i <= n and 0 <= i + k and abs(goal - k) <= most - d:
                new[k] = slide(min(i, n, m - k), k)
        far = new
    return None


def in_band(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance over cells at most `band` off the diagonal; exact if at most band."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    width, far = 2 * band + 1, n + m + 1
    shift = np.arange(width) - band
    padded = np.full(m + 2 * width + n, 0, np.uint64)
    padded[width : width + m] = b
    row = np.where((shift >= 0) & (shift <= m), shift, far)  # row i holds column i + shift
    ramp = np.arange(width)
    for i in range(1, n + 1):
        col = i + shift
        inside = (col >= 0) & (col <= m)
        other = padded[width + i - 1 - band : width + i + band]
        best = row + ((other != a[i - 1]) | (col < 1) | (col > m))
        best[col < 1] = far
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[col == 0] = i
        best = np.where(inside, best, far)
        row = np.where(inside, np.minimum.accumulate(best - ramp) + ramp, far)
    return int(row[m - n + band])


@lru_cache(64)
def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text, and its different shingles."""
    words = word_hashes(text)
    return words, np.unique(shingles(words))


def similarity(a: str, b: str, threshold: float) -> float | None:
    """Jaccard of the two texts' shingles if that and the edit similarity reach threshold."""
    (x, s), (y, t) = hashed(a), hashed(b)
    both = len(np.intersect1d(s, t, assume_unique=True))
    jaccard = both / (len(s) + len(t) - both)
    longest = max(len(x), len(y), 1)
    if jaccard < threshold or banded_edits(x, y, int((1 - threshold) * longest + 1e-9)) is None:
        return None
    return jaccard


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, node, n_shingles, keys; nothing is shuffled."""

    def run(batches):
        for b in batches:
            sizes, flat = [], []
            for t in b.column(2).to_pylist():
                s = shingles(word_hashes(t))
                sizes.append(len(s))
                flat.append(keys_of(s))
            at = pa.array(np.cumsum([0, *map(len, flat)]), pa.int32())
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(at, values)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n_shingles", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), short_digest().alias("node"), "text").mapInArrow(run, "doc_id long, node binary, n_shingles int, keys array<long>")


def short_digest() -> Column:
    return F.substring(digest(), 1, 16)


def sharing(nodes: DataFrame) -> DataFrame:
    """The nodes that share a key, with the size of each bucket they are in: node, first_id,
    n_shingles, keys, sizes, weight."""
    single = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = materialise(single.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-sizes")
    # a node has at most 2 * SKETCHES keys
    held = single.join(sizes, "key").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("key", "size"))).alias("sizes"))
    weight = F.expr("aggregate(map_values(sizes), 0L, (a, x) -> a + CAST(round(log2(x) * 1024) AS BIGINT))")
    shared = materialise(nodes.join(held, "node").select("node", "first_id", "n_shingles", "keys", "sizes", weight.alias("weight")), "near-sharing")
    discard(sizes)
    return shared


def members(shared: DataFrame, *more: str) -> DataFrame:
    """A row for each node and bucket: key, size, node, n_shingles."""
    held = F.expr("transform(map_entries(sizes), e -> struct(e.key AS key, e.value AS size))")
    return shared.select("node", "n_shingles", *more, F.inline(held))


def candidates(shared: DataFrame, threshold: float) -> DataFrame:
    """First pairs a < b of nodes: with the leaders of their buckets."""
    rows = members(shared, "weight")
    leaders = rows.groupBy("key").agg(F.max(F.struct("weight", "node", "n_shingles")).alias("leader"))
    leaders = materialise(leaders.select("key", F.col("leader.node").alias("other_node"), F.col("leader.n_shingles").alias("other_n_shingles")), "near-leaders")
    led = rows.select("key", "node", "n_shingles").join(leaders, "key").drop("key").where("node <> other_node")
    pairs = materialise(_pairs(led, threshold), "near-pairs")
    discard(leaders)
    return pairs


def _pairs(met: DataFrame, threshold: float) -> DataFrame:
    """Different pairs of those whose numbers of words don't rule out the edit similarity. A
    text of fewer than five words has one shingle, which only texts of the same words share."""
    n, other, more = F.col("n_shingles"), F.col("other_n_shingles"), F.lit(WORDS - 1)
    fits = F.least(n, other) + more >= F.lit(threshold - 1e-9) * (F.greatest(n, other) + more)
    return met.where(fits).select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def across(shared: DataFrame, roots: DataFrame, checked: DataFrame, texts: DataFrame, threshold: float, every_pair: bool) -> DataFrame:
    """Pairs a < b of nodes that share a key, are of different classes by roots (node, root),
    aren't among the checked ones, and may be links: all such pairs of small buckets, and
    those of larger ones that overlapping() doesn't rule out, or all (every_pair)."""
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = members(placed, "root")
    large = rows.where(F.col("size") > SMALL)
    mixed_keys = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    large = large.join(mixed_keys, "key")
    pool = materialise(large.select("node", "root").distinct(), "near-pool")
    # a bucket of at most SMALL rows
    small = rows.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", "n_shingles", "root")).alias("m"))
    differ = "filter(slice(m, i + 2, size(m)), y -> y.root <> x.root)"
    pair = "struct(x.node AS node, x.n_shingles AS n_shingles, y.node AS other_node, y.n_shingles AS other_n_shingles)"
    met = _pairs(small.select(F.inline(F.expr(f"flatten(transform(m, (x, i) -> transform({differ}, y -> {pair})))"))), threshold)
    close = _pairs(_blocks(large), threshold) if every_pair else overlapping(pool, texts, threshold)
    pairs = materialise(met.unionByName(close).distinct().join(checked, ["a", "b"], "left_anti"), "near-across")
    discard(pool, *([] if every_pair else [close]))
    return pairs


def places(pool: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The first shingles of the pool's texts that another one has too, rarest first: shingle,
    root, n (different shingles of the text), place (from 0, among all of the text), node. Of
    a text's n, those beyond (1 - threshold) n are left out: one before them is shared by any
    text at the threshold."""

    def run(batches):
        for b in batches:
            found = [hashed(t or "")[1] for t in b.column(2).to_pylist()]
            at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            values = pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, values)], names=["node", "root", "shingles"])

    own = materialise(pool.join(texts, "node").select("node", "root", "text").mapInArrow(run, "node binary, root binary, shingles array<long>"), "near-shingles")
    each = own.select("node", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(often, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    rows = own.select("node", "root", F.size("shingles").alias("n")).join(shared, "node").select("node", "root", "n", F.size("s").alias("m"), F.posexplode("s").alias("i", "s"))
    rows = rows.select(F.col("s.shingle").alias("shingle"), "root", "n", (F.col("n") - F.col("m") + F.col("i")).alias("place"), "node")
    out = materialise(rows.where(F.col("place") <= F.lit(1 - threshold + 1e-9) * F.col("n")), "near-places")
    discard(own)
    return out


def overlapping(pool: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of the pool's nodes (node, root) of different roots, all that are at the
    threshold among them. Of n and n' shingles two texts at Jaccard t share t / (1 + t) (n + n')
    or more; so many must be left in each from the first shared one on, which lies in the first
    (1 - t) / (1 + t) of the smaller text's. Shingles of one root, size and place meet as one
    row; those that pass are joined to their texts."""
    rows = places(pool, texts, threshold)
    share = threshold / (1 + threshold)
    kinds = rows.select("shingle", "root", "n", "place").distinct()
    other = kinds.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("root", "n", "place")])
    front = kinds.where(F.col("place") <= F.lit(1 - 2 * share + 1e-9) * F.col("n"))
    left = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    near = (F.col("n") <= F.col("other_n")) & (F.col("n") >= F.lit(threshold - 1e-9) * F.col("other_n")) & (left >= F.lit(share) * (F.col("n") + F.col("other_n")) - 1e-6)
    met = front.hint("merge").join(other, (kinds["shingle"] == other["shingle"]) & (F.col("root") != F.col("other_root")) & near).drop(other["shingle"])
    met = materialise(met, "near-kinds")
    texts_at = rows.select("shingle", "root", "n", "place", F.col("node").alias("a"))
    others_at = rows.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("root", "n", "place")], F.col("node").alias("b"))
    found = met.join(texts_at, ["shingle", "root", "n", "place"]).join(others_at, ["shingle", "other_root", "other_n", "other_place"])
    out = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-overlapping")
    discard(rows, met)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """All pairs of different classes of each bucket, by blocks of some PART texts."""
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / PART).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    first = rows.select("key", F.col("block").alias("p"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("q"), "node", "root", "n_shingles")
    second = rows.select("key", F.explode(F.expr("sequence(0, block)")).alias("p"), F.col("block").alias("q"), *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "n_shingles")])
    once = (F.col("p") < F.col("q")) | (F.col("node") < F.col("other_node"))
    return first.join(second, ["key", "p", "q"]).where(once & (F.col("root") != F.col("other_root"))).select("node", "n_shingles", "other_node", "other_n_shingles")


def texts_of(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """node, text of the nodes that share a key, once each."""
    text = docs.select(F.col("doc_id").cast("long").alias("id"), short_digest().alias("own"), F.col("text"))
    same = (F.col("own") == F.col("node")) & F.col("first_id").eqNullSafe(F.col("id"))
    found = materialise(text.join(shared.select("node", "first_id"), same).select("node", "text"), "near-texts")
    if found.count() == shared.count():
        return found
    once = materialise(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")  # repeated rows
    discard(found)
    return once


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are links, with their similarity."""
    left = pairs
    for side in "ab":
        left = left.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                found = [similarity(x or "", y or "", threshold) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                keep = pa.array([x is not None for x in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([x for x in found if x is not None], pa.float64())], names=["a", "b", "similarity"])

    return left.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def near_classes(docs: DataFrame, threshold: float = 0.8, every_pair: bool = False) -> DataFrame:
    """Per row of docs: doc_id, class_id, class_size, n_links (the links of its text to
    different texts that were checked; texts of one class aren't all paired), kept, digest.
    docs must give the same rows each time it is read. every_pair: pairs across classes of
    large buckets are all compared, none is ruled out beforehand."""
    rows = materialise(signatures(docs), "near-signatures")
    # texts of one digest have the same keys
    same = [F.min("doc_id").alias("first_id"), F.count("*").alias("group_size"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")]
    nodes = materialise(rows.groupBy("node").agg(*same), "near-nodes")
    shared = sharing(nodes)
    texts = texts_of(docs, shared)
    checked = [candidates(shared, threshold)]
    links = [materialise(verify(checked[0], texts, threshold), "near-links")]
    roots = star_components(links[0])
    checked.append(across(shared, roots, checked[0], texts, threshold, every_pair))
    links.append(materialise(verify(checked[1], texts, threshold), "near-links"))
    if not links[1].isEmpty():
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links[1].select("a", "b"))
        before, roots = roots, star_components(joined)
        discard(before)
    degree = links[0].unionByName(links[1]).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    own = nodes.drop("keys", "n_shingles").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # only linked nodes share a root; a root's nodes are different texts
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).getField("node").alias("best")
    classes = own.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("group_size").alias("class_size"), best)
    columns = ["first_id", "group_size", "class_id", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
    groups = materialise(own.join(classes, "root").select(F.col("node").alias("digest"), *columns, (F.col("best") == F.col("node")).alias("first")), "near-classes")
    each = rows.groupBy("doc_id", F.col("node").alias("digest")).agg(F.count("*").alias("n"))
    joined = with_groups(each, groups, rows.count()).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)
    discard(nodes, shared, texts, roots, *checked, *links)
    return joined.select("doc_id", "class_id", "class_size", "n_links", kept.alias("kept"), "digest")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class; all columns stay."""
    classes = near_classes(docs, threshold)
    gone = materialise(classes.where(~F.col("kept")).select(F.col("doc_id").alias("__waymark_id"), F.col("digest").alias("__waymark_digest")), "near-gone")
    same = F.col("doc_id").eqNullSafe(F.col("__waymark_id")) & (F.col("__waymark_own") == F.col("__waymark_digest"))
    marked = docs.withColumn("__waymark_own", short_digest())
    # what goes may be any share of the rows: never broadcast
    kept = marked.join(gone.hint("merge"), same, "left_anti")
    again = classes.where("kept").select(F.col("doc_id").alias("__waymark_id"), F.col("digest").alias("__waymark_digest")).join(gone, ["__waymark_id", "__waymark_digest"], "left_semi")
    again = materialise(again, "near-again")  # repeated rows of which one stays
    if not again.isEmpty():
        kept = kept.unionByName(marked.join(again.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__waymark_own"]))
    return kept.drop("__waymark_own")
