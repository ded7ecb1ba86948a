"""Operators for training data: odd tables, brute force, round trips, held-out rows."""

from __future__ import annotations

import collections
import hashlib
import io
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from waymark.llm import exact_dedup, fingerprint, licenses, main_text, near_dedup, packing, pii, quality, sentence_pieces, token_files
from waymark.llm._common import new_path
from waymark.llm.queries import ORACLE_SQL, QUERIES
from waymark.llm.tokens import ChunkEncoder

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"w{i % 977} Straße." for i in range(20_000))
PROSE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, PROSE), (2, PROSE), (3, PROSE.replace("word60", "other")), (4, None), (5, ""), (5, ""), (6, LONG), (7, "mail a.b@c.de ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (555) 123-4567 end"),
    (8, "Released under the MIT License."), (None, "no id"), (None, None), (9, "x  y\n\n z\t\x1c!"), (9, "same id, other text"), (10, "emoji 😀 日本語 ﬁ İ Σς"), (11, "hi <|endoftext|> there <|startoftext|>x"),
]
CLASH = "ids binary, n long, digest string, part int, key string, bins string, kept boolean, text_a string, late int, held_out string, stays int, node string, copy int, html string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a very long text, and columns named like the operators' own."""
    names = [x.strip().split()[0] for x in CLASH.split(",")]
    rows = [(*r, *[None] * len(names)) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}".replace("lang string, source string, n_chars long, ", "")).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def runs(spark, docs, labels):
    field, weights = pii.train(docs), quality.train(docs, labels)
    folder = new_path(spark, "tf")
    yield packing.pack(docs, WORD)
    yield fingerprint.edited_pairs(docs)
    yield near_dedup.near_classes(docs)
    yield near_dedup.keep_one(docs)
    yield token_files.read_files(token_files.write_files(docs, folder, BYTE, 2), folder)
    yield exact_dedup.dedup(docs)
    yield exact_dedup.keep_one(docs)
    yield sentence_pieces.round_trips(docs, PIECE)
    yield pii.find_personal(docs, field)
    yield pii.mask_personal(docs, field)
    yield quality.score(docs, weights)
    yield quality.keep_good(docs, weights)
    yield licenses.scan_licenses(docs)


def test_empty_tables(spark, odd, labels):
    for df in runs(spark, odd.limit(0), labels.limit(0)):
        assert df.count() == 0
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_odd_tables_keep_their_rows(spark, odd, labels):
    counts = [df.count() for df in runs(spark, odd, labels)]
    n = len(ROWS)
    assert counts[1] == counts[2] == counts[4] == counts[5] == counts[7] == counts[8] == counts[9] == counts[10] == counts[12] == n
    different = len({t or "" for _, t in ROWS})
    assert counts[6] == different and counts[3] == different - 1


def ids(tokenizer, text, end):
    t = Tokenizer.from_file(tokenizer)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_holds_every_id_once(spark, odd):
    pieces = packing.pack(odd, WORD, with_ids=True).collect()
    whole = sorted(ids(WORD, t, 1).tobytes() for _, t in ROWS)
    flat = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)))
    places = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert len(flat) == sum(map(len, whole)) and all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
    ends, docs = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ends.append(bytes(p.ids))
        if not p.cut_after:
            docs.append(b"".join(ends))
            ends = []
    assert sorted(docs) == whole


def test_token_files_read_back(spark, odd):
    folder = new_path(spark, "tf")
    rows = token_files.read_files(token_files.write_files(odd, folder, BYTE, 2), folder, with_ids=True).orderBy("start").collect()
    assert sorted(bytes(r.ids) for r in rows) == sorted(ids(BYTE, t, 2).tobytes() for _, t in ROWS)
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known)


def test_token_file_random_access():
    out = io.BytesIO()
    w = token_files.TokenFileWriter(out, 2, frame_tokens=50)
    for i in range(40):
        w.add(i // 2, np.full(i, i, "<u2").tobytes())
    w.close()
    r = token_files.TokenFileReader(out)
    assert len(r.frames) > 5 and [len(x) for x in r.find(7)] == [14, 15]
    data = bytearray(out.getvalue())
    data[r.places[2] + 20] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's or ours
        token_files.TokenFileReader(io.BytesIO(bytes(data))).frame(2)


def test_added_tokens_in_a_text():
    text = "hi <|endoftext|> there"
    assert 50256 in np.frombuffer(ChunkEncoder(BYTE).encode([text])[0], "<u2")
    assert 50256 not in np.frombuffer(ChunkEncoder(BYTE, escape=True).encode([text])[0], "<u2")


@pytest.mark.parametrize("escape", [False, True])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_give_the_library_ids(path, escape):
    random.seed(5)
    parts = ["a", "B", "é", "Σ", " ", "  ", "\n", "\n\n", ".", ",", "...", "'s", "1", "22", "\t", "\x1c", "日本", "İ", "́", " \n", "<|endoftext|>", "Word.", "x.\ny", "\r\n"]
    texts = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(3000)]
    e = ChunkEncoder(path, escape=escape)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = escape
    want = [np.array(x.ids, e.dtype).tobytes() for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts) == want


def test_pieces_equal_the_library():
    random.seed(6)
    lib, e = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentence_pieces.piece_encoder(PIECE)
    texts = [t or "" for _, t in ROWS] + ["".join(random.choices(["the ", "ing", "Ä", "  ", "\n", "0", "=", "日", "😀", "tion"], k=12)) for _ in range(500)]
    for t, raw in zip(texts, e.encode(texts), strict=True):
        got = np.frombuffer(raw, "<u4")
        assert got.tolist() == lib.encode(t) and e.decode(got) == t


def test_unigram_viterbi_equals_brute_force():
    v = sentence_pieces.Vocabulary.__new__(sentence_pieces.Vocabulary)
    pieces = [("<unk>", 0.0, False, False)] + [(t, -s, True, False) for t, s in (("a", 2.1), ("b", 2.2), ("ab", 3.0), ("ba", 3.3), ("aba", 5.9), ("bb", 4.9))]
    v.setup(pieces, sentence_pieces.UNIGRAM, 0, False)
    e = sentence_pieces.PieceEncoder(v)

    def best(word):
        cuts = [[word[i:j] for i, j in itertools.pairwise([0, *c, len(word)])] for k in range(len(word)) for c in itertools.combinations(range(1, len(word)), k)]
        return max(sum(v.scores[v.ids[p]] for p in c) for c in cuts if all(p in v.ids for p in c))

    for n in range(1, 8):
        for w in map("".join, itertools.product("ab", repeat=n)):
            got = np.frombuffer(e.encode([w])[0], "<u4")
            assert abs(sum(v.scores[got]) - best(w)) < 1e-9 and "".join(v.texts[i] for i in got) == w


def test_exact_dedup_index_takes_later_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (10, ""), (11, "b"), (12, "b")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.dedup(first, index).where("kept").collect()} == {2, 3}
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(second, index).collect()}
    assert got == {9: (2, False), 10: (3, False), 11: (12, False), 12: (12, True)}
    assert index.table().count() == 3
    plan = index.placed(first.select(exact_dedup.digest().alias("digest"))).join(index.table().select("digest").hint("merge"), "digest", "left_anti")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    index.close()


def test_exact_dedup_index_outlasts_the_session(spark):
    path = new_path(spark, "kept-index")
    first = exact_dedup.DigestIndex(spark, path, buckets=3)
    exact_dedup.dedup(spark.createDataFrame([(i, f"t{i % 7}") for i in range(40)], "doc_id long, text string"), first).count()
    other = spark.newSession()
    first.close()  # as a catalog that forgets
    again = exact_dedup.DigestIndex(other, path, buckets=50)
    assert again.buckets == 3 and again.table().count() == 7
    docs = other.createDataFrame([(100 + i, f"t{i}") for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(docs, again).collect()}
    assert got == {100 + i: (max(x for x in range(40) if x % 7 == i), False) if i < 7 else (100 + i, True) for i in range(9)}
    assert again.table().count() == 9 and again.table().select("digest").distinct().count() == 9
    again.close()
    assert exact_dedup.DigestIndex(spark, path).table().count() == 9
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digests_") and t.name != again.name]



@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in QUERIES[name](spark, sf_dir).collect())


def test_fingerprints_against_jaccard(spark, sf_dir):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, sf_dir).collect()}
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    off = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(got[d].near_edited - len(sets(t) & sets(edited)) / len(sets(t) | sets(edited)))
    assert abs(np.mean(off)) < 0.01 and np.sqrt(np.mean(np.square(off))) < 0.06


def test_near_dedup_finds_all_links(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    sets = {d: frozenset(near_dedup.shingles(near_dedup.word_hashes(t)).tolist()) for d, t in rows}
    for (a, t), (b, u) in itertools.combinations(rows, 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            assert found[a] == found[b], (a, b)


def test_banded_edits_equal_the_full_table():
    random.seed(7)
    for _ in range(400):
        a = [random.randrange(1, 5) for _ in range(random.randrange(25))]
        b = [x for x in a if random.random() > 0.1] + [random.randrange(1, 5) for _ in range(random.randrange(3))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = random.randrange(12)
        assert near_dedup.banded_edits(np.array(a, np.uint64), np.array(b, np.uint64), most) == (row[-1] if row[-1] <= most else None)
        assert not a or not b or near_dedup.in_band(np.array(a, np.uint64), np.array(b, np.uint64), 30) == row[-1]


def test_personal_data_patterns():
    random.seed(8)
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda x: [int(c) for c in x if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    fits = {"email": lambda x: True, "ip": lambda x: all(int(y) <= 255 for y in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda x: 8 <= len(digits(x)) <= 15}
    parts = ["a", "@", ".", "1", "23", "456", " ", "-", "+", "(", ")", "x.y", "4111 1111 1111 1111", "1.2.3.4", "+1 555 123 4567", "\n", "é"]
    for _ in range(500):
        t = "".join(random.choices(parts, k=30))
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds for m in re.finditer(p, t) if fits[k](m[0])]
        assert pii.written(pii.base_spans(t)) == ",".join(want)


def test_skip_edges_carry_labels():
    text = "mail bob@mail.example.com now. " + "plain words " * 200 + "bob@mail.example.com, card 4111 1111 1111 1111"
    t = pii.tokens(text)
    assert t.skip.tolist() and t.spans
    field = pii.Field(np.zeros((len(pii.FORMS), 5)), np.zeros((5, 5)), 6.0)
    fixed = pii.labels_of(t.spans, pii.base_spans(text))
    fixed[int(t.skip[0, 1])] = 0  # as if the pattern had missed the repeat
    assert pii.marginals(field, t, fixed)[int(t.skip[0, 1])].argmax() == 1
    assert pii.masked("a b@c.de d", [(0, 2, 8)]) == "a [EMAIL] d"


def test_labels_reach_every_repeat_of_a_long_chain():
    t = pii.tokens("bob7x plain words " * 30)
    assert len(t.skip) == 29 and not len(t.chain)
    field = pii.Field(np.zeros((len(pii.FORMS), 5)), np.zeros((5, 5)), 10.0)
    fixed = np.zeros(30, np.int64)
    fixed[0] = 1
    # a pair keeps a label with chance e^10 / (e^10 + 4), another label has 1 / (e^10 + 4)
    keep = (np.exp(10) - 1) / (np.exp(10) + 4)
    assert np.allclose(pii.marginals(field, t, fixed)[:, 1], 0.2 + 0.8 * keep ** np.arange(30), atol=1e-4)


def test_quality_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    scored = QUERIES["op8_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "quality").toPandas()
    rank = scored["score"].rank().to_numpy()
    good = scored["quality"].to_numpy() == 1
    auc = (rank[good].mean() - rank[~good].mean()) / len(rank) + 0.5
    assert auc > 0.99


def test_main_text(spark):
    page = lambda own: f"<html><head><title>t</title></head><body><header>H</header><nav><li>menu</li></nav><article><h1>T &amp; {own}</h1><p>one  <b>two</b><br>three<p>{own}<aside>no</aside><div class='comments'><p>hi</p></div></article><footer>f</footer>"
    bare = lambda own: f"<body><div>Welcome to our site</div><p>{own}</p><form>f</form><div>Imprint</div>"
    rows = [(1, "http://h/a/1", page("x")), (2, "http://h/a/2", page("y")), (3, "http://g/1", bare("first")), (4, "http://g/2", bare("second")), (5, None, None), (6, "http://z/", "")]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x\none two three\nx", 2: "T & y\none two three\ny", 3: "first", 4: "second", 5: "", 6: ""}


def test_a_stray_quote_in_a_tag_swallows_nothing():
    page = main_text.read_page("<article><p>It is</p><div x' ><p>real text</p></div><p>tail don't</p><a href = \"x>y\" title='>'>end</a></article>")
    assert page.lines == ["It is", "real text", "tail don't", "end"]


def test_main_text_of_unmarked_copies_stays(spark):
    bare = lambda *own: "<body><div>Welcome</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Imprint</div>"
    rows = [(1, "http://g/a/1", bare("story", "end")), (2, "http://g/a/2", bare("story", "end")), (3, "http://g/b", bare("other")), (4, "http://h/1", bare("x")), (4, "http://h/1", bare("x"))]
    rows += [(5, "http://i/a/1", bare("first")), (6, "http://i/a/2", bare("long", "one")), (7, "http://i/a/2x", bare("long", "two"))]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "story\nend" and got[3] == "other"
    assert got[4] == "Welcome\nx\nImprint" and got[5] == "first" and got[6] == "long\none"


def test_main_text_equals_plain_differencing(spark):
    """Extraction of unmarked pages against a quadratic LCS over the sorted pages, for any
    number of ranges; repeated urls, clashing columns and a very long page among them."""
    random.seed(12)
    rows = []
    for i in range(90):
        own = [f"own {i % 70} {k}" for k in range(random.randrange(4))]
        lines = random.choices(["menu", "site", "help", "news"], k=3) + own + random.choices(["imprint", "top", "site"], k=2)
        rows.append((i, f"http://h{i % 3}/{random.choice('abc')}/{random.randrange(30)}", "".join(f"<div>{x}</div>" for x in lines)))
    rows.append((90, "http://h0/a/5", "".join(f"<p>line {i} of a long page</p>" for i in range(20_000))))
    parsed = [(u, i, main_text.read_page(h).lines) for i, u, h in rows]

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    host = lambda u: u.split("/")[2]
    want = {}
    ordered = sorted(parsed, key=lambda x: (host(x[0]), x[0][len("http://hx") :], x[1]))
    for k, (u, i, lines) in enumerate(ordered):
        other = [x for x in ordered if host(x[0]) == host(u)]
        at = other.index((u, i, lines))
        before = next((x for x in other[:at][::-1] if x[2] != lines), None)
        after = next((x for x in other[at + 1 :] if x[2] != lines), None)
        want[i] = [(len(lines) - lcs(lines, x[2]) if len(lines) < 100 and len(x[2]) < 100 else None) for x in (before, after) if x]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, own string, part int")
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append({r.page_id: r.text for r in main_text.extract(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    for i, n_left in want.items():
        got = len(results[0][i].split("\n")) if results[0][i] else 0
        if None not in n_left and n_left:  # what stays differs from one neighbour at least
            assert got >= max(n_left) if len(n_left) == 2 else got == n_left[0]


def test_common_is_longest():
    random.seed(9)
    for _ in range(300):
        a, b = ([random.randrange(5) for _ in range(random.randrange(18))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(main_text.common(a, b)) == len(main_text.common(a, b, most=4)) == table[-1][-1]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, sf_dir)
        assert new.columns == docs.columns and new.count() <= kept.count()
        kept = new
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_near_classes_are_the_components_of_all_candidate_links(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # edits of one text: many pairs lie just under or over the threshold
        words = list(base)
        for i in rng.choice(120, rng.integers(1, 6), replace=False):
            words[i] = f"v{rng.integers(1000)}"
        texts.append(" ".join(words))
    keys = [set(near_dedup.keys_of(near_dedup.shingles(near_dedup.word_hashes(t))).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if keys[a] & keys[b] and near_dedup.similarity(texts[a], texts[b], 0.8) is not None:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).select("doc_id", "class_id").collect()}
    assert got == dict(enumerate(root))


def test_near_dedup_links_short_texts_that_share_one_key(spark):
    rng, texts = random.Random(3), []
    while len(texts) < 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        pair = " ".join(words[:8]), " ".join(words)
        a, b = (set(near_dedup.keys_of(near_dedup.shingles(near_dedup.word_hashes(t))).tolist()) for t in pair)
        if 0 < len(a & b) < 7:
            texts += pair
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).select("doc_id", "class_id").collect()}
    assert got == {i: i - i % 2 for i in range(8)}


def exact_links(texts):
    """All pairs of different texts at 0.8, by the rarest fifth of each one's shingles."""
    sets = [np.unique(near_dedup.shingles(near_dedup.word_hashes(t))).tolist() for t in texts]
    often = collections.Counter(itertools.chain.from_iterable(sets))
    holds = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]:
            holds[x].append(i)
    met = {p for h in holds.values() for p in itertools.combinations(h, 2)}
    return [(a, b) for a, b in met if near_dedup.similarity(texts[a], texts[b], 0.8) is not None]


def test_near_dedup_recall_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    texts = list(first)
    links = exact_links(texts)
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    hit = sum(found[first[texts[a]]] == found[first[texts[b]]] for a, b in links)
    assert len(links) > 30 and hit >= 0.98 * len(links)
    assert all(found[d] == found[first[t]] for d, t in rows)


def test_near_dedup_of_one_large_group(spark):
    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(700):  # most pairs lie around the threshold
        words = list(base)
        for i in rng.choice(150, rng.integers(1, 9), replace=False):
            words[i] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(words))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in exact_links(texts):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    classes = len({find(x) for x in range(len(texts))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for every_pair, most in ((True, classes + 1), (False, classes + 3)):
        got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs, every_pair=every_pair).collect()}
        assert classes <= len(set(got.values())) <= most
        assert all(find(d) == find(c) for d, c in got.items())


def test_overlap_loses_no_link_of_a_large_group(spark):
    rng = np.random.default_rng(13)
    base, texts = [f"w{i}" for i in range(120)], []
    for k in range(300):  # texts of several sizes, most pairs of one group
        words = base[: 120 - k % 20]
        for i in rng.choice(len(words), rng.integers(0, 12), replace=False):
            words[i] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(words))
    sets = [set(near_dedup.hashed(t)[1].tolist()) for t in texts]
    node = lambda i: i.to_bytes(2, "big")
    pool = spark.createDataFrame([(node(i), node(i % 290)) for i in range(300)], "node binary, root binary")
    table = spark.createDataFrame([(node(i), t) for i, t in enumerate(texts)], "node binary, text string")
    found = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in near_dedup.overlapping(pool, table, 0.8).collect()}
    every = {(a, b) for a, b in itertools.combinations(range(300), 2) if a % 290 != b % 290}
    close = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(close) > 300 and close <= found <= every and len(found) < len(every) / 2


def test_lowest_equals_a_sort():
    rng = np.random.default_rng(4)
    for n in (7, 40, 96, 500, 3000):
        low = rng.integers(0, 2**64, (30, n), dtype=np.uint64)
        assert (near_dedup.lowest(low, 6) == np.sort(np.argsort(low, axis=1)[:, :6], axis=1)).all()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    n = len(pii.KINDS) + 1
    for _ in range(6):
        size = 6
        field = pii.Field(rng.normal(size=(len(pii.FORMS), n)), rng.normal(size=(n, n)), float(rng.uniform(0, 3)))
        forms = rng.integers(0, 2, (size, len(pii.FORMS))).astype(float) * 0.4
        chain, skip = [(0, 1), (2, 3), (4, 5)], [(1, 2), (0, 5)]  # a tree: messages are exact
        t = pii.Tokens([], forms, np.array(chain), np.array(skip))
        fixed = np.zeros(size, np.int64)
        fixed[3] = 2
        total = np.zeros((size, n))
        for y in itertools.product(range(n), repeat=size):
            if y[3] != 2:
                continue
            score = sum(forms[i] @ field.own[:, y[i]] for i in range(size) if i != 3)
            score += sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip * (y[a] == y[b]) for a, b in skip)
            for i, k in enumerate(y):
                total[i, k] += np.exp(score)
        assert np.allclose(pii.marginals(field, t, fixed), total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_entities_are_whole(spark, sf_dir):
    field = pii.train(spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet"))
    rng, wrong, found, planted = random.Random(4), 0, 0, 0
    words = "the report of that day was sent to all who came and asked for it again".split()
    for _ in range(300):
        a, b = f"({rng.randint(200, 989)})", f"{rng.randint(200, 989)}-{rng.randint(1000, 9999)}"
        while not pii.luhn(card := "".join(rng.choices("0123456789", k=16))):
            pass
        four = [card[i : i + 4] for i in range(0, 16, 4)]
        repeat, first = rng.choice([(f"{a} {b}", f"+1 {a} {b}"), (".".join(four), " ".join(four)), (None, f"room {rng.randint(100, 9999)} at 12:30 on 2024-03-12, 4.2 or 17")])
        fill = " ".join(rng.choices(words, k=40))
        text = f"{fill} {first} {fill} {repeat or 'x'} {fill}"
        _, more = pii.all_spans(text, field)
        got = [text[s:e] for _, s, e in more]
        planted += repeat is not None
        found += repeat in got
        wrong += sum(x != repeat for x in got)
    assert found >= 0.95 * planted and wrong <= 0.02 * planted


def test_ftrl_and_score_by_hand(spark):
    texts = [("good words here", 1), ("bad bad words", 0), ("here good", 1), ("", 0), ("bad. words", 0), (None, 1)]
    model, z, n = quality.Ftrl(), collections.Counter(), collections.Counter()
    alpha, beta, l1 = model.alpha, model.beta, model.l1

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha)

    def probability(places):
        value = {i: 1 / max(1, len(places)) ** 0.5 for i in places} | {"bias": 1.0}
        return value, 1 / (1 + np.exp(-sum(weight(i) * v for i, v in value.items())))

    for text, label in texts * 3:
        places = quality.features(text).tolist()
        value, p = probability(places)
        g = {i: (p - label) * v for i, v in value.items()}
        step = {i: ((n[i] + x * x) ** 0.5 - n[i] ** 0.5) / alpha * weight(i) for i, x in g.items()}
        for i, x in g.items():
            z[i] += x - step[i]
            n[i] += x * x
        model.learn(np.array(places, np.int64), label)
    learned = model.weights()
    assert all(abs(learned[1 << quality.BITS if i == "bias" else i] - weight(i)) < 1e-9 for i in n)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.score(docs, learned.astype(np.float32)).collect()}
    for i, (t, _) in enumerate(texts):
        p = probability(quality.features(t).tolist())[1]
        assert abs(got[i][0] - p) < 1e-5 and got[i][1] == int(p >= 0.5) and got[i][2] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_rows_that_repeat_an_id_count_once_in_training(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 400 + [(1, "x")] + [(3, "bad bad")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    want = quality.train(spark.createDataFrame([(1, "x"), (3, "bad bad")], "doc_id long, text string"), labels)
    assert (quality.train(docs, labels) == want).all() and np.abs(want).sum() > 0
    assert np.abs(quality.train(docs, labels, most_bytes=0)).sum() == 0


def test_stages_take_odd_rows(spark, odd, sf_dir):
    """Stages on nulls, empties, ties, repeats and clashing columns: no row of a different text
    is lost but by the classifier and the near-dedup, and an empty table stays empty."""
    for (name, stage), lost in zip(corpus_pipeline.STAGES, (None, 0, 1, 0, 0), strict=True):
        got = stage(spark, odd, sf_dir)
        ids = {r.doc_id for r in got.select("doc_id").collect()}
        assert ids <= {d for d, _ in ROWS}
        if name == "exact_dedup":
            assert got.count() == len({t or "" for _, t in ROWS})
        if name == "near_dedup":
            assert 3 not in ids and got.count() == len({t or "" for _, t in ROWS}) - 1
        if name in ("personal_data", "packing"):
            assert ids == {d for d, _ in ROWS}
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_hadoop_names_of_stores():
    try:
        where = token_files.opened("s3a://bucket/folder")[1]
    except (ImportError, OSError) as e:
        pytest.skip(str(e))
    assert where == "bucket/folder"
