"""Packing by concatenate and cut.

Pass one tokenises and adds up each partition's tokens; a running sum over those totals
(one row a partition) gives every document its place in one endless string of tokens.
Pass two cuts that string into windows of `length` tokens. A document that runs over a
window's edge leaves one record on either side.

Nulls: a null text is empty and gives its end token alone; a null doc_id is carried.
Repeated rows are packed as often as they occur. An empty table gives no piece. Columns
besides doc_id and text are ignored. Texts of any length are cut as often as needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import materialise
from waymark.llm.tokens import tokenise

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean"


def starts(tokens: DataFrame) -> DataFrame:
    """tokens with `place`, the tokens of all rows before each row."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # as many rows as the first pass had partitions
    return tokens.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("part_start"))


def cut(placed: DataFrame, length: int, id_bytes: int, with_ids: bool) -> DataFrame:
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches):
        for b in batches:
            doc, ids, place = b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("place").to_pylist()
            rows = []
            for d, raw, at in zip(doc, ids, place, strict=True):
                wide = np.frombuffer(raw, kind).astype("<u4")
                n, done = len(wide), 0
                while done < n:
                    seq, off = divmod(at + done, length)
                    take = min(length - off, n - done)
                    part = wide[done : done + take].tobytes()
                    rows.append((d, done, take, zlib.crc32(part), n, seq, off, done > 0, done + take < n) + ((part,) if with_ids else ()))
                    done += take
            if rows:
                cols = [list(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()] * with_ids, strict=True)], names=[x.split()[0] for x in (PIECES + ", ids binary" * with_ids).split(", ")])

    return placed.select("doc_id", "ids", "place").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens; only the last is shorter.

    Per piece: doc_id, start and length in the document, crc32 of the ids, doc_tokens,
    sequence_id, offset, whether the document goes on before or after; with_ids adds the
    ids as little-endian unsigned 32-bit integers. Sorting a sequence's pieces by offset
    and joining their ids gives the sequence.
    """
    from tokenizers import Tokenizer

    id_bytes = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() < 65_536 else 4
    tokens = materialise(tokenise(docs, tokenizer, end_id), "pack-tokens")
    return cut(starts(tokens), length, id_bytes, with_ids)
