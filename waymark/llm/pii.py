"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field labels the tokens (stretches without white space)
that hold a digit or @: email, ip, card, phone or none. Neighbouring tokens share chain
potentials; a token also shares a skip potential with the last earlier token of the same or
a similar form, however far apart: the same digits where it has six or more (of a base span:
all of its digits), the same last seven digits, else the same lower-case letters and digits, those of an address before its @.
So a form has as many skip edges as repeats. Tokens of base spans keep their label; loopy
message passing carries it to the others. Neighbouring tokens whose likeliest label is card,
or phone, are one entity. An entity of which one token has the marginal `sure` or more, and
whose digits and marks suit its kind, becomes a span more, without the marks around it. Base
spans always stay.

The weights come from pseudo-likelihood over the patterns' own labels in at most `sample`
documents (the smallest hashes of doc_id, one row an id) with `most_bytes` of features.
Every document is then searched whole.

Rules: a null text is empty and has no spans. Positions are code points, ends exclusive.
Repeated rows are searched each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import discard, materialise, within

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK, SPACE, EDGE = re.compile(r"[0-9@]"), re.compile(r"\s"), re.compile(r"[+(]?\w.*\w|\w", re.S)
#: Labels whose neighbouring tokens are one entity: card and phone.
JOINED = frozenset((3, 4))

Spans = list[tuple[int, int, int]]


def luhn(digits: str) -> bool:
    doubled = [int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text: str) -> Spans:
    """(kind, start, end) by kind, then start."""
    out: Spans = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def written(spans: Spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


FORMS = ("has @", "one @", "dots 1", "dots 2", "dots 3", "dots more", "plus first", "plus", "bracket", "hyphen", "all digits", "no letters", "hex", "letters most", "equals", "slash", "digits 1-3", "digits 4-7", "digits 8-15", "digits 16-19", "digits more", "luhn", "length 1-4", "length 5-9", "length 10-19", "length 20-39", "length more", "next has digit", "last has digit", "bias")


class Tokens(NamedTuple):
    """Tokens of a document that hold a digit or @: their places, features and edges."""

    spans: list[tuple[int, int]]
    forms: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def form_of(core: str) -> list[int]:
    digits = sum(c.isdigit() for c in core)
    letters, dots, size = sum(c.isalpha() for c in core), core.count("."), len(core)
    bare = "".join(c for c in core if c in "0123456789")
    return [
        "@" in core, core.count("@") == 1, dots == 1, dots == 2, dots == 3, dots > 3, core[:1] == "+", "+" in core, "(" in core or ")" in core, "-" in core,
        digits == size, letters == 0, size >= 16 and all(c in "0123456789abcdefABCDEF" for c in core), letters > digits, "=" in core, "/" in core,
        1 <= digits <= 3, 4 <= digits <= 7, 8 <= digits <= 15, 16 <= digits <= 19, digits > 19, len(bare) >= 16 and luhn(bare), size < 5, 5 <= size < 10, 10 <= size < 20, 20 <= size < 40, size >= 40,
    ]


def likes(core: str) -> set[str]:
    """What a token shares with those that are the same or similar."""
    bare = "".join(c for c in core if c in "0123456789")
    if len(bare) >= 6 and "@" not in core:
        return {bare, "7 " + bare[-7:]} if len(bare) >= 7 else {bare}
    plain = lambda x: "".join(c for c in x if c.isalnum())
    low = core.lower()
    return {x for x in (plain(low), plain(low.partition("@")[0])) if x}


def tokens(text: str, base: Spans | tuple = ()) -> Tokens:
    """base: the base spans; the last token of one is also like its whole digits."""
    spans, end = [], 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        found = SPACE.search(text, m.start())
        end = found.start() if found else len(text)
        spans.append((start, end))
    rows, chain, skip, last = [], [], set(), {}
    whole = {}
    for _, a, b in base:
        if spans:
            at = bisect_left(spans, (b, 0)) - 1
            whole[at] = whole.get(at, set()) | likes(text[a:b])
    for i, (a, b) in enumerate(spans):
        core = text[a:b].strip(".,;:!?\"'<>[]{}")
        beside = bool(i) and a - spans[i - 1][1] == 1
        after = i + 1 < len(spans) and spans[i + 1][0] - b == 1
        rows.append([*form_of(core), after, beside, True])
        if beside:
            chain.append((i - 1, i))
        for key in likes(core) | whole.get(i, set()):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return Tokens(spans, np.array(rows, np.float64).reshape(len(rows), len(FORMS)), np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2))


def labels_of(spans: list[tuple[int, int]], base: Spans) -> np.ndarray:
    """Label of each token by the base span it meets: 0 for none, else kind + 1."""
    out = np.zeros(len(spans), np.int64)
    starts = np.array([b for _, b in spans])
    for k, a, b in base:
        i = int(np.searchsorted(starts, a, side="right"))
        while i < len(spans) and spans[i][0] < b:
            out[i] = out[i] or k + 1
            i += 1
    return out


class Field(NamedTuple):
    """forms x labels; chain potentials label x label; skip potential of equal labels."""

    own: np.ndarray
    chain: np.ndarray
    skip: float


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(documents: list[tuple[Tokens, np.ndarray]], rounds: int = 1000, rate: float = 1.0, decay: float = 1e-4) -> Field:
    """Gradient ascent on the pseudo-likelihood: each token given its neighbours' labels."""
    n = len(KINDS) + 1
    own, chain, skip = np.zeros((len(FORMS), n)), np.zeros((n, n)), 0.0
    if not documents:
        return Field(own, chain, skip)
    base = np.cumsum([0] + [len(y) for _, y in documents])
    x, y = np.concatenate([t.forms for t, _ in documents]), np.concatenate([y for _, y in documents])
    c = np.concatenate([t.chain + b for (t, _), b in zip(documents, base, strict=False)])
    s = np.concatenate([t.skip + b for (t, _), b in zip(documents, base, strict=False)])
    before, after, alike = np.zeros((len(y), n)), np.zeros((len(y), n)), np.zeros((len(y), n))
    np.add.at(before, c[:, 1], np.eye(n)[y[c[:, 0]]])
    np.add.at(after, c[:, 0], np.eye(n)[y[c[:, 1]]])
    for a, b in ((0, 1), (1, 0)):
        np.add.at(alike, s[:, a], np.eye(n)[y[s[:, b]]])
    truth = np.eye(n)[y]
    weight = 1 / np.maximum(1, truth.sum(axis=0))[y][:, None] / n  # rare labels count as much
    for _ in range(rounds):
        off = (truth - softmax(x @ own + before @ chain + after @ chain.T + skip * alike)) * weight
        own += rate * (x.T @ off - decay * own)
        chain += rate * (before.T @ off + off.T @ after - decay * chain)
        skip += rate * float((off * alike).sum())
    return Field(own, chain, max(0.0, skip))


def marginals(field: Field, t: Tokens, fixed: np.ndarray, settled: float = 1e-6) -> np.ndarray:
    """Label marginals after loopy message passing; labels above 0 in fixed are held.

    Rounds are damped and go on until no message moves by `settled`, so a label gets to any
    repeat, however many lie between. A round sends again only what isn't settled. Loops may
    keep messages moving: rounds end at 200 and four a token, where a path of all tokens
    takes two a token."""
    n = len(KINDS) + 1
    own = t.forms @ field.own
    own[fixed > 0] = -50.0
    own[fixed > 0, fixed[fixed > 0]] = 50.0
    edges = np.concatenate([t.chain, t.skip])
    if not len(edges):
        return softmax(own)
    ahead = np.concatenate([np.tile(field.chain, (len(t.chain), 1, 1)), np.tile(np.eye(n) * field.skip, (len(t.skip), 1, 1))])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([ahead, ahead.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    sent, total, now = np.zeros((len(source), n)), own.copy(), np.arange(len(source))
    for _ in range(200 + 4 * len(own)):
        new = (total[source[now]] - sent[back[now]])[:, :, None] + pair[now]
        top = new.max(axis=1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
        step = new - new.max(axis=1, keepdims=True) - sent[now]
        moved = np.abs(step).max(axis=1) > settled
        if not moved.any():
            break
        now, step = now[moved], 0.5 * step[moved]
        sent[now] += step
        np.add.at(total, target[now], step)
        fresh = np.zeros(len(own), bool)
        fresh[target[now]] = True
        again = fresh[source]
        again[now] = True
        now = np.flatnonzero(again)
    total = own.copy()
    np.add.at(total, target, sent)
    return softmax(total)


def suits(kind: int, found: str) -> bool:
    """Whether an entity has what its kind needs; leftovers of failed patterns have not."""
    digits, numbers = sum(c.isdigit() for c in found), re.findall(r"[0-9]+", found)
    return ("@" in found, len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers), 13 <= digits <= 19, 7 <= digits <= 15)[kind]


def entities(text: str, spans: list[tuple[int, int]], fixed: np.ndarray, p: np.ndarray, sure: float) -> Spans:
    """Spans of the tokens outside base spans, neighbours of a label joined."""
    label, out, i = np.where(fixed > 0, 0, p.argmax(axis=1)).tolist(), [], 0
    while i < len(spans):
        k, j = label[i], i + 1
        if k in JOINED:
            while j < len(spans) and label[j] == k and spans[j][0] - spans[j - 1][1] == 1:
                j += 1
        if k and p[i:j, k].max() >= sure and (m := EDGE.search(text, spans[i][0], spans[j - 1][1])) and suits(k - 1, m[0]):
            out.append((k - 1, m.start(), m.end()))
        i = j
    return out


def all_spans(text: str, field: Field, sure: float = 0.9) -> tuple[Spans, Spans]:
    """The base spans, and those that the field adds."""
    base = base_spans(text)
    t = tokens(text, base)
    if not t.spans:
        return base, []
    fixed = labels_of(t.spans, base)
    if fixed.all():
        return base, []
    return base, entities(text, t.spans, fixed, marginals(field, t, fixed), sure)


def train(docs: DataFrame, sample: int = 4_000, most_bytes: int = 64_000_000) -> Field:
    """Field fitted on at most `sample` documents of `most_bytes` features together; the
    driver gets no more. Of rows that repeat an id, the one with the least tokens counts."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                base = base_spans(x or "")
                t = tokens(x or "", base)
                y = labels_of(t.spans, base)
                out.append((np.packbits(t.forms.astype(bool)).tobytes(), y.astype("<i4").tobytes(), t.chain.astype("<i4").tobytes(), t.skip.astype("<i4").tobytes()))
            keep = [i for i, x in enumerate(out) if x[1]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64()))] + [pa.array([out[i][k] for i in keep], pa.binary()) for k in range(4)], names=["doc_id", "forms", "y", "chain", "skip"])

    # chosen has at most `sample` ids
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, forms binary, y binary, chain binary, skip binary")
    size = F.length("forms") + F.length("y") + F.length("chain") + F.length("skip")
    one = found.groupBy("doc_id").agg(F.min(F.struct(size.alias("size"), "forms", "y", "chain", "skip")).alias("x"))
    learned = materialise(one.select("doc_id", "x.*"), "pii-features")
    ids = within([tuple(r) for r in learned.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()], most_bytes)
    table = learned.where(F.col("doc_id").isin(ids)).orderBy("doc_id").toArrow()
    discard(learned)
    documents = []
    for r in table.to_pylist():
        y = np.frombuffer(r["y"], "<i4").astype(np.int64)
        forms = np.unpackbits(np.frombuffer(r["forms"], np.uint8))[: len(y) * len(FORMS)].reshape(len(y), -1).astype(np.float64)
        documents.append((Tokens([], forms, *(np.frombuffer(r[k], "<i4").astype(np.int64).reshape(-1, 2) for k in ("chain", "skip"))), y))
    return fit(documents)


def find_personal(docs: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (all), n_added."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                base, more = all_spans(x or "", field)
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: Spans) -> str:
    """text with each span, or run of spans that overlap, replaced by its first kind."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask_personal(docs: DataFrame, field: Field) -> DataFrame:
    """docs with all spans masked in text, and n_chars of the new text; null texts stay."""
    text, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            new = []
            for x in b.column(text).to_pylist():
                base, more = all_spans(x or "", field)
                new.append(x if x is None else masked(x, base + more))
            cols = list(b.columns)
            cols[text] = pa.array(new, b.schema.field(text).type)
            if size is not None:
                cols[size] = pa.array([None if x is None else len(x) for x in new], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
