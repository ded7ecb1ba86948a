"""Token files: independent zstandard frames, a document index and a seek table.

A file is
  frames          zstandard, content checksum on, each holding whole documents
  document index  skippable frame 0x184D2A5D: per frame the number of documents, and the
                  first and last of their ids
  seek table      skippable frame 0x184D2A5E of zstandard's seekable format: per frame
                  compressed size, size, low half of XXH64 of the content; then footer
A frame's content is: magic, bytes an id, documents; null flags, doc ids and token
numbers of the documents; ids one after the other, all little-endian.

Readers open the tail of a file, then decompress those frames only whose range of ids
holds a requested document. Files are written in ascending doc_id: file by file, and
in each file (ties by a hash of the text, null ids first). Null texts are empty; repeated rows are kept;
an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import materialise
from waymark.llm.tokens import encoded, encoder

INDEX_MAGIC, SEEK_MAGIC, SEEK_FOOT, FRAME_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, b"WMTF"
FRAME_TOKENS = 65_536


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path. Hadoop's names of the S3 store count as s3."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TokenFileWriter:
    """Takes documents in order; close() returns nothing and completes the file."""

    def __init__(self, out, id_bytes: int, frame_tokens: int = FRAME_TOKENS):
        self.out, self.kind, self.frame_tokens = out, np.dtype(f"<u{id_bytes}"), frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.docs, self.held, self.frames, self.index = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids) // self.kind.itemsize
        if self.held >= self.frame_tokens:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        body = b"".join([FRAME_MAGIC, struct.pack("<BI", self.kind.itemsize, len(ids)), bytes(d is None for d, _ in self.docs), ids.tobytes(), np.array([len(x) // self.kind.itemsize for _, x in self.docs], "<u8").tobytes(), *(x for _, x in self.docs)])
        packed = self.zstd.compress(body)
        self.out.write(packed)
        self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        known = [d for d, _ in self.docs if d is not None]
        self.index.append((len(ids), known[0] if known else 0, known[-1] if known else -1))
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<Iqq", *x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOT)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFileReader:
    """Random access to a token file; f is seekable."""

    def __init__(self, f):
        self.f = f
        size = f.seek(0, 2) or f.tell()
        f.seek(size - 9)
        n, flags, foot = struct.unpack("<IBI", f.read(9))
        if foot != SEEK_FOOT or not flags & 0x80:
            raise ValueError("no seek table")
        at = size - 9 - 12 * n - 8
        f.seek(at)
        head = f.read(8 + 12 * n)
        if struct.unpack_from("<II", head) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.frames = [struct.unpack_from("<III", head, 8 + 12 * i) for i in range(n)]
        f.seek(at - 20 * n - 8)
        body = f.read(8 + 20 * n)
        if struct.unpack_from("<II", body) != (INDEX_MAGIC, 20 * n):
            raise ValueError("damaged document index")
        self.index = [struct.unpack_from("<Iqq", body, 8 + 20 * i) for i in range(n)]
        self.places = np.cumsum([0] + [x[0] for x in self.frames]).tolist()

    def frame(self, i: int) -> list[tuple[int | None, np.ndarray]]:
        packed, size, check = self.frames[i]
        self.f.seek(self.places[i])
        body = zstandard.ZstdDecompressor().decompress(self.f.read(packed), max_output_size=size)
        if len(body) != size or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check or body[:4] != FRAME_MAGIC:
            raise ValueError(f"frame {i} is damaged")
        width, n = struct.unpack_from("<BI", body, 4)
        at = 9 + n
        ids, sizes = np.frombuffer(body, "<i8", n, at), np.frombuffer(body, "<u8", n, at + 8 * n).astype(np.int64)
        tokens, ends = np.frombuffer(body, f"<u{width}", offset=at + 16 * n), np.cumsum(sizes)
        return [(None if body[9 + k] else int(ids[k]), tokens[ends[k] - sizes[k] : ends[k]]) for k in range(n)]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.frames)):
            yield from self.frame(i)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents of that id; decompresses only the frames that may hold it."""
        return [x for i, (_, low, high) in enumerate(self.index) if low <= doc_id <= high for d, x in self.frame(i) if d == doc_id]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """Writes documents to `folder`, which all executors reach; returns the files, one row
    each: file, part, n_docs, n_tokens. A file's name holds its task attempt, so a retried
    task writes another; only files of this (materialised) table belong to the result."""

    def run(batches):
        task = TaskContext.get()
        at, where = opened(folder)
        at.create_dir(where, recursive=True)
        name = f"{where}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        n_docs = n_tokens = 0
        width = encoder(tokenizer).dtype.itemsize
        out = writer = None
        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), encoded(tokenizer, b.column(1).to_pylist(), end_id), strict=True):
                if writer is None:
                    out = at.open_output_stream(name, compression=None)
                    writer = TokenFileWriter(out, width)
                writer.add(d, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // width
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name.rpartition("/")[2]], "part": [task.partitionId()], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tie"))
    # rows of one doc_id, or of none, may lie in several files
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return materialise(ordered.mapInArrow(run, "file string, part long, n_docs long, n_tokens long"), "token-manifest")


def read_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""

    def run(batches):
        at, where = opened(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with at.open_input_file(f"{where}/{name}") as f:
                    reader = TokenFileReader(f)
                    for i in range(len(reader.frames)):
                        docs = reader.frame(i)
                        wide = [x.astype("<u4").tobytes() for _, x in docs]
                        n = np.array([len(x) for _, x in docs], np.int64)
                        arrays = [pa.array([d for d, _ in docs], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in wide], pa.int64())]
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays(arrays + [pa.array(wide, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    tasks = max(1, manifest.count())  # one a file
    return placed.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
