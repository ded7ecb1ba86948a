"""Exact dedup against a persistent index of digests.

The index is a table bucketed and sorted by digest; it lives in its folder and outlasts the
session. New data is reduced to one row a digest (partial sums before the shuffle), joined
by sort-merge anti-join with the index, which needs no shuffle of the index, and what is new
is appended. Which document stays is then read from the index. A call takes its rows in
batches, those of the largest doc_ids first, so what the index holds of a digest is the
largest doc_id of the first call that brought it.

Rules: texts are equal when identical; a null text is empty. Among equal texts of one
call the largest doc_id stays (nulls are smallest), a digest that the index has from an
earlier call keeps the document it came with. Rows repeated in full count in group_size, and
one of them stays. Other columns are ignored. An empty table adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import discard, materialise, new_path, text_or_empty

#: Groups broadcast at most: those of at least 1/HOT_GROUPS of all rows.
HOT_GROUPS = 4096


def digest(text: Column | None = None) -> Column:
    return F.unhex(F.sha2(text_or_empty() if text is None else text, 256))


class DigestIndex:
    """Digests seen so far: digest, keep_id, batch.

    An index is its path: the files lie in path/digests-<buckets>, and any session that
    opens the path registers them as a bucketed table, so nothing is lost where a catalog
    forgets. `buckets` counts for a new index only; without it, it takes as many as the
    session has shuffle partitions. close() drops the catalog's entry, not the files."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or new_path(spark, "digest-index")).rstrip("/")
        self.name = "digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        held = self._held()
        self.buckets = held or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{self.path}/digests-{self.buckets}"
        quoted = self.folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )
        spark.catalog.refreshTable(self.name)

    def _held(self) -> int | None:
        """Buckets of the index that the path holds."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        found = [int(m[1]) for m in map(re.compile(r"digests-(\d+)").fullmatch, names) if m]
        if len(found) > 1:
            raise ValueError(f"{self.path} holds more than one index")
        return found[0] if found else None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def placed(self, groups: DataFrame) -> DataFrame:
        """groups dealt out as the index is, so that joins with it shuffle nothing more."""
        return groups.repartition(self.buckets, "digest")

    def append(self, groups: DataFrame) -> str:
        """groups: digest, keep_id; one row a digest. Adds those that are new, and returns
        the batch's name."""
        batch = uuid.uuid4().hex
        # written first: else the optimiser joins rows before it groups them, and copies meet in a task
        written = materialise(groups, "digest-batch")
        new = self.placed(written).join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        rows = new.select("digest", "keep_id", F.lit(batch).alias("batch"))
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.name)
        discard(written)
        return batch

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def with_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows joined with groups (digest, keep_id, group_size) on digest, however large a
    group: at most HOT_GROUPS groups have total/HOT_GROUPS rows or more; those are
    broadcast, the rest is joined by sort-merge, where no group is large."""
    hot = F.col("group_size") >= max(64, -(-total // HOT_GROUPS))
    large, small = F.broadcast(groups.where(hot)), groups.where(~hot)
    return rows.join(large, "digest").unionByName(rows.join(large.select("digest"), "digest", "left_anti").join(small.hint("merge"), "digest"))


def cuts(rows: DataFrame, batches: int) -> list[int]:
    """doc_ids at which batches end: equal steps from the largest id to the smallest."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return [] if low is None else [high - (high - low + 1) * i // batches for i in range(1, batches)]


def judge(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Per different (doc_id, text): doc_id, digest, n (rows), keep_id, group_size, stays."""
    held = index or DigestIndex(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    rows = materialise(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "digests")
    own, rest = [], rows
    for cut in [*cuts(rows, batches), None]:
        part, rest = (rest, None) if cut is None else (rest.where(F.col("doc_id") > cut), rest.where(F.col("doc_id").isNull() | (F.col("doc_id") <= cut)))
        own.append(held.append(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))))
    sizes = held.placed(rows.groupBy("digest").agg(F.sum("n").alias("group_size")))
    known = held.table().select("digest", "keep_id", F.col("batch").isin(own).alias("new"))
    groups = materialise(sizes.join(known.hint("merge"), "digest"), "digest-groups")
    if index is None:
        held.close()
    total = rows.agg(F.sum("n")).first()[0] or 0
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("new")
    return with_groups(rows, groups, total).select("doc_id", "digest", "n", "keep_id", "group_size", stays.alias("stays"))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    each = judge(docs, index).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """docs without the rows that dedup() drops; all columns stay."""
    rows = judge(docs, index, batches).select(F.col("doc_id").alias("__waymark_id"), F.col("digest").alias("__waymark_digest"), "stays", "n")
    gone = materialise(rows.where(~F.col("stays") | (F.col("n") > 1)), "digests-gone")
    same = F.col("doc_id").eqNullSafe(F.col("__waymark_id")) & (F.col("__waymark_own") == F.col("__waymark_digest"))
    marked = docs.withColumn("__waymark_own", digest())
    # what goes may be any share of the rows: never broadcast
    kept = marked.join(gone.hint("merge"), same, "left_anti")
    again = gone.where("stays")  # repeated rows of which one stays
    if not again.isEmpty():
        kept = kept.unionByName(marked.join(again.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__waymark_own"]))
    return kept.drop("__waymark_own")
