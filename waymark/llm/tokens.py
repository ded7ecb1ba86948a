"""Token ids by the tokenizers library, with a bounded cache of chunks of text."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import quiet_threads

# Fixed value: the pattern of word tokenizers whose tokens never hold white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

CHUNK_CHARS = 64
MARKS = frozenset(".,;:!?")
BATCH_CHARS = 4_000_000


def latin(text: str) -> bool:
    """Only letters of Latin alphabets, composed (all below U+0250 are in composed form)."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


def byte_letters() -> dict[int, str]:
    """How byte-level models write the letters that latin() takes: their UTF-8 bytes, printable
    ones as themselves, the others by the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return {c: "".join(chr(names[b]) for b in chr(c).encode()) for c in [32, *range(128, 0x250)]}


LETTERS = byte_letters()


class Chunks(dict):
    """Ids of chunks; a chunk that isn't known is put together from parts that may be."""

    def __init__(self, owner: ChunkEncoder, lead: str):
        super().__init__()
        self.owner, self.lead, self.mapped = owner, lead, lead.translate(LETTERS)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.owner.parts(self, chunk)
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Encodes texts by the library, each different chunk of a text once.

    A chunk is a stretch between places where the tokenizer's own pre-tokenizer always
    cuts, so that a text's ids are its chunks' ids one after the other:

    * a word pattern without white space: white space is such a place, and so are the sides
      of a mark that follows letters and ends a chunk; case doesn't count;
    * a byte-level pattern that ties one blank to the word after it: before every blank,
      where no two blanks follow each other, the sides of a line end between other
      characters, and those of a mark as above.

    Texts for which that doesn't hold or that hold an added token (such as an end mark, which
    the library gives its own id), and other tokenizers, go to the library whole. With
    `escape`, added tokens in a text are ordinary text.
    Words of Latin letters, in lower case where case doesn't count, go to the tokenizer's
    model alone: the normaliser and the pattern do nothing to them, and the byte level is one
    look-up a letter. The two tables together hold some `limit` chunks of at most 64
    characters.
    """

    def __init__(self, path: str, limit: int = 700_000, escape: bool = False):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = escape
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # chunks are kept here
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule = self.find_rule(spec)
        added = [x for x in spec.get("added_tokens") or [] if not (escape and x["special"])]
        if any(x["normalized"] for x in added):  # found in the normalised text, which isn't at hand
            self.rule = "whole"
        self.added = [x["content"] for x in added]
        self.code, self.dtype = ("H", np.dtype("<u2")) if self.tokenizer.get_vocab_size() < 65_536 else ("I", np.dtype("<u4"))
        self.limit, self.heads = limit, Chunks(self, "")
        self.cache = Chunks(self, " ") if self.rule == "blank" else self.heads

    @staticmethod
    def find_rule(spec: dict) -> str:
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            return "blank"
        parts = pre.get("pretokenizers", [])
        kinds = {x["type"] for x in (norm or {}).get("normalizers", [])}
        if parts and parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN and parts[0]["invert"] and kinds <= {"NFC", "Replace", "Lowercase"} and parts[1:] and parts[1]["type"] == "ByteLevel":
            return "word"
        return "whole"

    def split(self, text: str) -> list[str] | None:
        for x in self.added:
            if x in text:
                return None
        if self.rule == "word" and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
        if self.rule == "blank" and "  " not in text:
            return text.split(" ")
        return None

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def parts(self, table: Chunks, chunk: str) -> bytes:
        """Ids of a chunk that isn't known."""
        if self.rule == "word" and "\u03a3" not in chunk and (low := chunk.lower()) != chunk:
            return table[low]
        if latin(chunk):
            mapped = chunk if chunk.isascii() else chunk.translate(LETTERS)
            return array(self.code, [t.id for t in self.model.tokenize(table.mapped + mapped)]).tobytes()
        if chunk[-1:] in MARKS and latin(chunk[:-1]):
            return table[chunk[:-1]] + self.heads[chunk[-1]]
        lines = chunk.split("\n")
        if self.rule == "blank" and len(lines) > 1 and all(x and x.split() == [x] for x in lines):
            end = self.heads["\n"]
            return table[lines[0]] + b"".join([end + self.heads[x] for x in lines[1:]])
        return self.ids(table.lead + chunk) if chunk or table.lead else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype."""
        if len(self.heads) > self.limit // 3 and self.cache is not self.heads:
            self.heads.clear()
        if len(self.cache) + len(self.heads) * (self.cache is not self.heads) > self.limit:
            self.cache.clear()
        out, get = [], self.cache.__getitem__
        for text in texts:
            row = self.split(text)
            if row is None:
                out.append(self.ids(text))
            elif self.rule == "blank":
                out.append(self.heads[row[0]] + b"".join(map(get, row[1:])))
            else:
                out.append(b"".join(map(get, row)))
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, which serves its later tasks too."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encoded(path: str, texts: Iterable[str | None], end_id: int | None) -> Iterator[bytes]:
    """Ids of each text and end_id, as little-endian bytes of the encoder's dtype."""
    enc = encoder(path)
    end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BATCH_CHARS:
            yield from (x + end for x in enc.encode(held))
            held, size = [], 0
    yield from (x + end for x in enc.encode(held))


def tokenise(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary), n_tokens, part (the partition), part_start (tokens
    of the partition before this row). A null text counts as empty.

    part and part_start hold for one run of the tasks: materialise the result before use.
    """

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = list(encoded(path, b.column(1).to_pylist(), end_id))
            n = np.array([len(x) for x in ids], np.int64) // encoder(path).dtype.itemsize
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)], names=["doc_id", "ids", "n_tokens", "part", "part_start"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, part int, part_start long")
