"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.checkpoints import discard, materialise, new_path, shared_dir

__all__ = ["WordHashes", "discard", "let", "materialise", "new_path", "quiet_threads", "read_table", "shared_dir", "size_of", "text_or_empty", "within"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Word to 64-bit hash; keeps at most `limit` short words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def size_of(df: DataFrame) -> int:
    """Bytes that the optimiser expects of df; 0 where it knows of no files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def within(sizes: list[tuple], most: int) -> list:
    """The first keys of (key, bytes), as many as take `most` bytes together."""
    out, total = [], 0
    for key, size in sizes:
        total += size
        if total > most:
            break
        out.append(key)
    return out


def quiet_threads() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
