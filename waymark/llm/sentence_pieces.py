"""SentencePiece encoding and decoding by batched numpy Viterbi.

Text is cut where a blank follows another character (no piece of the vocabulary holds a
blank after another character; this is checked, else texts stay whole). Each different
word is encoded once and kept in a bounded cache. Words of equal length advance together:
at each position the hashes of all substrings that end there probe the sorted keys of the
pieces of that length, and the best of the pieces is stored as backpointer.

A unigram model's best path has the largest sum of scores. A BPE model's ids aren't those
of the largest sum, so for BPE a step scores whether it may follow: two neighbours may stand
in a BPE result just when merging their joined text gives the two again, and exactly one
piece may end each prefix after what the prefix before it ends with. The path found is the
library's result. Pairs are judged once each and kept in a bounded table.

Rules: a null text is empty and has no ids. Characters without a piece become byte pieces
(or the unknown id). Decoding gives the text back, but U+2581 as a blank. The vocabulary
must normalise nothing (identity), which is checked. Repeated rows count each, an empty
table gives no row, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
BASE = 0x9E3779B97F4A7C15
BATCH_CHARS = 4_000_000
BPE, UNIGRAM = 2, 1


class Vocabulary:
    """Pieces of a model file, as the encoder needs them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that normalise nothing are supported")
        kinds = sentencepiece.sentencepiece_model_pb2.ModelProto.SentencePiece
        self.setup([(p.piece, p.score, p.type in (kinds.NORMAL, kinds.USER_DEFINED), p.type == kinds.BYTE) for p in model.pieces], model.trainer_spec.model_type, model.trainer_spec.unk_id, model.normalizer_spec.add_dummy_prefix)

    def setup(self, pieces, kind: int, unknown: int, dummy: bool) -> None:
        """pieces: (text, score, normal?, byte?) by id."""
        self.texts = [p[0] for p in pieces]
        self.scores = np.array([p[1] for p in pieces], np.float64)
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p[2]}
        self.bytes = {int(p[0][1:-1], 16): i for i, p in enumerate(pieces) if p[3]}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.kind, self.unknown, self.dummy = kind, unknown, dummy
        self.splits = not any(BLANK in t.lstrip(BLANK) for t in self.ids)


class PieceEncoder:
    def __init__(self, vocabulary: Vocabulary, limit: int = 1_500_000):
        self.v, self.limit = vocabulary, limit
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if vocabulary.splits else re.compile(r".+", re.S)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for text, i in vocabulary.ids.items():
            by_size.setdefault(len(text), []).append((self.key(text), i))
        self.keys = {n: (np.array([k for k, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in sorted(by_size.items())}
        self.least = float(vocabulary.scores.min()) - 10.0
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def may_follow(self, a: int, b: int) -> bool:
        """Does merging the joined text of pieces a and b (below 0: a character without a
        piece) give a and b again?"""
        x, y = (self.v.texts[i] if i >= 0 else chr(-1 - i) for i in (a, b))
        parts = list(x + y)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.v.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.v.scores[j] > best):
                    best, at = self.v.scores[j], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [x, y]

    def allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """may_follow of each pair, in one look-up for each different pair."""
        code = (before + 0x110001) * 0x1000000 + (piece + 0x110001)
        different, back = np.unique(code, return_inverse=True)
        known = list(map(self.pairs.get, different.tolist()))
        for i, ok in enumerate(known):
            if ok is None:
                c = int(different[i])
                known[i] = self.pairs[c] = self.may_follow(c // 0x1000000 - 0x110001, c % 0x1000000 - 0x110001)
        return np.array(known, bool)[back]

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length."""
        n, rows = len(words[0]), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(rows, n).astype(np.int64)
        prefix = np.zeros((rows, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * np.uint64(BASE) + chars[:, i].astype(np.uint64) + np.uint64(1)
        powers = {size: np.uint64(pow(BASE, size, 1 << 64)) for size in self.keys}
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        size_of, last = np.zeros((rows, n + 1), np.int64), np.zeros((rows, n + 1), np.int64)
        bpe = self.v.kind == BPE
        for i in range(1, n + 1):
            single = np.zeros(rows, bool)
            for size, (keys, ids) in self.keys.items():
                if size > i:
                    break
                h = prefix[:, i] - prefix[:, i - size] * powers[size]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == h) & np.isfinite(best[:, i - size]))
                if size == 1:
                    single = keys[at] == h
                self.step(hit, ids[at[hit]], i, size, best, size_of, last, bpe)
            hit = np.flatnonzero(~single & np.isfinite(best[:, i - 1]))
            self.step(hit, -1 - chars[hit, i - 1], i, 1, best, size_of, last, bpe)
        out = []
        for r in range(rows):
            ids, i = [], n
            while i:
                p = int(last[r, i])
                ids.extend([p] if p >= 0 else reversed(self.fallback(chr(-1 - p))))
                i -= int(size_of[r, i])
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def step(self, hit, piece, i, size, best, size_of, last, bpe) -> None:
        """Offers pieces that end at i to the rows in hit; keeps the maxima."""
        if not len(hit):
            return
        if bpe:
            ok = self.allowed(last[hit, i - size], piece) if i > size else np.ones(len(hit), bool)
            hit, piece = hit[ok], piece[ok]
            total = np.full(len(hit), float(size))
        else:
            total = best[hit, i - size] + np.where(piece >= 0, self.v.scores[np.maximum(piece, 0)], self.least)
        better = total > best[hit, i]
        hit, piece = hit[better], piece[better]
        best[hit, i], size_of[hit, i], last[hit, i] = total[better], size, piece

    def fallback(self, c: str) -> list[int]:
        if not self.v.bytes:
            return [self.v.unknown]
        return [self.v.bytes[b] for b in c.encode("utf-8", "replace")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        rows, new = [], set()
        for t in texts:
            whole = (BLANK if self.v.dummy else "") + t.replace(" ", BLANK) if t else ""
            words = self.word.findall(whole)
            rows.append(words)
            new |= set(words).difference(self.cache)
        groups: dict[int, list[str]] = {}
        for w in new:
            groups.setdefault(len(w), []).append(w)
        for n, words in groups.items():
            most = max(1, min(8192, 2_000_000 // n))
            for i in range(0, len(words), most):
                part = words[i : i + most]
                self.cache.update(zip(part, self.viterbi(part), strict=True))
        get = self.cache.__getitem__
        out = [b"".join(map(get, words)) for words in rows]
        for w in new:
            if len(w) > 64:
                self.cache.pop(w, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        texts, byte_of = self.v.texts, self.v.byte_of
        ids = ids.tolist()
        if byte_of.keys().isdisjoint(ids):
            text = "".join([texts[i] for i in ids])
        else:
            text = b"".join([bytes([byte_of[i]]) if i in byte_of else texts[i].encode() for i in ids]).decode("utf-8", "replace")
        text = text.replace(BLANK, " ")
        return text[1:] if self.v.dummy and text[:1] == " " else text


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(Vocabulary(path))
    return _encoders[path]


def batches_of(texts: list[str | None]):
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    yield held


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, ids (array)."""

    def run(batches):
        enc = piece_encoder(model)
        for b in batches:
            raw = [x for part in batches_of(b.column(1).to_pylist()) for x in enc.encode(part)]
            ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, model: str) -> DataFrame:
    """Per row of doc_id and ids: doc_id, text."""

    def run(batches):
        enc = piece_encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of unsigned 32-bit ids), same: does decoding
    the ids give the text back?"""

    def run(batches):
        enc = piece_encoder(model)
        for b in batches:
            rows = []
            for part in batches_of(b.column(1).to_pylist()):
                for t, raw in zip(part, enc.encode(part), strict=True):
                    rows.append((len(raw) // 4, zlib.crc32(raw), enc.decode(np.frombuffer(raw, "<u4")) == t))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, same boolean")
