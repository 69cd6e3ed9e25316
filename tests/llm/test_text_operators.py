"""Operators on texts against the library, brute force and edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, common, fingerprints, graph, mixing, ngramjoin, pieces, quality, ranges, rollups, textkit, tokenstore, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, component_id long, _score string"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", -1, "x") for i, t, s in rows], SCHEMA)


def odd_rows():
    base = "one two three four five six seven eight nine ten eleven twelve"
    return [(5, base, "b"), (3, base.upper(), "a"), (7, base + " thirteen", None), (8, None, "a"), (9, "", "a"), (10, " \t\n", "b"), (11, "two words", "a"), (12, "two  words", "b"), (13, "lone", "b"), (5, base, "b"), (None, base, "a"), (14, "x" * 70_000 + " y", "b"), (15, "word " * 6000, "a"), (16, "ⅷ Straße", "a"), (17, "viii STRASSE", "a")]


def odd(spark):
    return frame(spark, odd_rows())


def empty(spark):
    return frame(spark, [])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """{id: smallest id reachable} by comparing all pairs."""
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            o = len(a & b)
            if a and b and 100 * o >= 75 * (len(a) + len(b) - o):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def near_texts(seed, n=160):
    """Families of edited copies, chains, shared passages, boundary similarities."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    passage, out = [word() for _ in range(40)], []
    while len(out) < n:
        t = [word() for _ in range(r.choice([3, 5, 8, 30, 120]))]
        if r.random() < 0.3:
            t += passage
        for _ in range(r.choice([1, 1, 3, 12])):
            out.append(" ".join(t))
            t = list(t)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = word()
    return list(enumerate(out[:n]))


@pytest.mark.parametrize(("few", "block"), [(48, 256), (2, 3)])
def test_ngram_components_equal_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = near_texts(few)
    got = ngramjoin.ngram_components(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert len(set(want.values())) < len(rows) - 20


@pytest.mark.parametrize(("few", "block", "ordered"), [(48, 4, 1 << 18), (3, 4, 5), (1000, 3, 2)])
def test_ngram_components_of_chains(spark, monkeypatch, few, block, ordered):
    """Candidates that hang together in their hundreds: by pairs, by a shingle that many share, with few late shingles."""
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "ORDERED", ordered)
    monkeypatch.setattr(ngramjoin, "SHINGLES", 60)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    head = [word() for _ in range(6)]
    chain = [word() for _ in range(400)]
    texts = [" ".join(head + [word() for _ in range(8)]) for _ in range(60)]  # a common beginning, nothing else
    texts += [" ".join(chain[k : k + 26]) for k in range(0, 340, 2)]  # each like its neighbours, not like those beyond
    texts += [" ".join(chain[k : k + 26][::-1]) for k in range(0, 200, 9)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in ngramjoin.ngram_components(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def test_crowd_of_edited_copies_is_dealt_in_proportion(spark, monkeypatch):
    """Copies of one text, most alike, some edited too much to be like any: those are told apart without comparing all with all."""
    for name, value in (("FEW", 4), ("BLOCK", 8), ("SHINGLES", 10_000)):
        monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(100)], []
    for i in range(240):
        t = list(base)
        for k in r.sample(range(100), r.choice([0, 1, 2, 5, 6])):
            t[k] = word()
        rows.append((i, " ".join(t)))
    near = rows[0][1].split()  # a chain away from the first text: alike one by one only
    for i in range(240, 260):
        near[(i * 5) % 100] = word()
        rows.append((i, " ".join(near)))
    dealt, compared = [], ngramjoin._compared
    monkeypatch.setattr(ngramjoin, "_compared", lambda d, *how: (dealt.append(d.count()), compared(d, *how))[1])
    got = {x.doc_id: x.component_id for x in ngramjoin.ngram_components(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)
    assert 1 < len(set(got.values())) < len(rows) - 100
    assert max(dealt) < 6 * len(rows)  # all pairs of blocks were 3,828 rows


def test_words_of_equal_polynomial_hashes_are_told_apart(spark):
    a, b = thue_morse(10)
    rows = [(1, a), (2, b), (3, f"{a} x y z w v"), (4, f"{b} x y z w v"), (5, a.upper())]
    got = {x.doc_id: x.component_id for x in ngramjoin.ngram_components(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_exact_sets():
    sets = textkit.exact_sets([(buf, off) for _, _, buf, off in textkit.groups(pa.array([t for _, t in near_texts(3, 80)] + [None, "", "a b", "A  b", "a b c"]))])
    plain = [shingles(t) for _, t in near_texts(3, 80)] + [set(), set(), shingles("a b"), shingles("a b"), shingles("a b c")]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    assert all(len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j]) for i in range(0, len(sets), 3) for j in range(len(sets)))


def test_plain_words():
    for texts in (["A b", " a\tB \n", "", None, "x", "  "], ["", "é Z", "  "], ["a "], [" a", "b ", "c"]):
        got = [x for _, _, buf, off in textkit.groups(pa.array(texts)) for x in textkit.plain_words(buf, off)]
        assert got == [b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())) for t in texts]


def test_word_hashes_are_spread():
    words_ = [bytes([97 + k % 26]) * (k % 90 + 1) + str(k).encode() for k in range(3000)]
    buf, at = np.frombuffer(b" ".join(words_) + b" " + b" ".join(words_), np.uint8), []
    s, e, _ = textkit.words(buf, np.array([0, len(buf)]))
    h = textkit.word_hashes(buf, s, e)
    assert (h[:3000] == h[3000:]).all() and len(np.unique(h)) == 3000 and not at


def test_ngram_components_edges(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.ngram_components(odd(spark)).collect()), key=str)
    comp = {i: c for i, _, c in got}
    assert len(got) == len(odd_rows())
    assert comp[5] == comp[3] == comp[7] == 3 and comp[12] == comp[11] == 11 and comp[8] == 8 and comp[None] is None
    assert ngramjoin.ngram_components(empty(spark)).count() == 0
    kept = ngramjoin.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [3, 8, 9, 10, 11, 13, 14, 15, 16, 17]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(900, 900), (1000, None)], "a long, b long").repartition(7)
    got = graph.connected_components(e).collect()
    assert {r.component for r in got} == {0} and len(got) == 301
    assert graph.connected_components(e.limit(0)).count() == 0


FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def thue_morse(n):
    """Two different words that polynomial hashes modulo a power of two take for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def crafted_texts(seed, n):
    """Control, combining and blank characters at every edge, special tokens, apostrophes, long words, colliding words."""
    r = random.Random(seed)
    alphabet = " \n\tabé.,!1'sñ ́日<|>É\u0085:;\x00\x08\x1b\x1c\u00a0\u3000sltre'×÷İ"
    words_ = ["hello", "don't", "we'll", "<|endoftext|>", "<|startoftext|>", "x1y2", " ", "  ", "\n", "ÅNGSTRÖM", "ΑΣ", "word,", "(a)", "日本語", "한국 어"]
    out = ["", None, " ", "\x00ab", "\x1f", "ab\x08 cd", "İ, x", "<|ENDOFTEXT|> A", "I\u0307 A\u030a", "🙂 🙂", "a" * 5000, "word " * 400, *thue_morse(10), " ".join(thue_morse(10))]
    for _ in range(n):
        out.append("".join(r.choice(alphabet) for _ in range(r.randint(1, 150))))
        out.append(r.choice(["", " "]).join(r.choice(words_) for _ in range(r.randint(1, 60))))
    return out


def edge_texts():
    return [t for c in map(chr, [*range(0x250), *range(0x300, 0x370, 5)]) for t in (c + "ab cd", "ab" + c + " cd", "ab " + c + "cd", "ab" + c + ", cd", "ab," + c, "a\n" + c + "\nb", c, " " + c, c + " ", c + ".")]


def library_ids(path, texts):
    return [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def own_ids(enc, texts):
    got = []
    for _, _, ids, at, _ in enc.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return got


@pytest.mark.parametrize("name", FILES)
def test_pieces_agree_with_the_library(name):
    enc = bpe.fast_encoder(public.path(name))
    assert isinstance(enc, pieces.PieceEncoder)
    for texts in (crafted_texts(4, 1500), edge_texts()):
        assert own_ids(enc, texts) == library_ids(public.path(name), texts)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("library", [False, True])
@pytest.mark.parametrize(("least", "mean"), [(1, 4), (8, 8), (64, 256)])
def test_chunks_agree_with_the_library(name, least, mean, library):
    enc = bpe.ChunkEncoder(public.path(name), least, mean)
    if library:
        with open(public.path(name), encoding="utf-8") as f:
            enc.pieces, enc.tok = None, bpe.plain_tokenizer(json.load(f))  # chunks by the library itself
    for texts in (crafted_texts(least, 400), edge_texts()[::7]):
        assert own_ids(enc, texts) == library_ids(public.path(name), texts)
    assert enc.repaired and enc.merged


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "Digits", "individual_digits": True}}, {"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": "x"}}])
def test_chunks_agree_with_the_library_for_other_files(tmp_path, change):
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f) | change
    spec["model"]["unk_token"] = "!"
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert pieces.family(spec) is None
    texts = crafted_texts(9, 150)
    assert own_ids(bpe.fast_encoder(path), texts) == library_ids(path, texts)
    assert own_ids(bpe.ChunkEncoder(path, 8, 8), texts) == library_ids(path, texts)


def test_equal_chunks_are_encoded_once():
    enc = bpe.ChunkEncoder(public.path("byte_bpe_50k.json"))
    r = random.Random(5)
    passage = " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(1600))
    texts = [f"{k} lead in of its own {passage} and end {k}" for k in range(20)]
    assert own_ids(enc, texts) == library_ids(public.path("byte_bpe_50k.json"), texts)
    assert enc.reused > 3 * enc.made


@pytest.mark.parametrize("kind", ["chunks", "pieces"])
def test_encoders_forget_and_go_on(monkeypatch, kind):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 40)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 2)
    monkeypatch.setattr(pieces, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "CHUNK", 16)
    monkeypatch.setattr(pieces, "CHUNK", 16)
    texts = ["one two three four five six"] * 3 + ["seven eight nine ten", "one two"]
    path = public.path("byte_bpe_50k.json")
    enc = bpe.ChunkEncoder(path, 4, 4) if kind == "chunks" else pieces.PieceEncoder(path, False)
    assert own_ids(enc, texts) == library_ids(path, texts)


def test_bpe_round_trip(spark):
    out = bpe.bpe_round_trip(odd(spark)).collect()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in out) and len(out) == len(odd_rows())
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for r in bpe.bpe_digests(frame(spark, [(1, "Hello, wörld <|endoftext|>", "s"), (2, None, "s")])).collect():
        ids = tok.encode("Hello, wörld <|endoftext|>" if r.doc_id == 1 else "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_round_trip(empty(spark)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)).view(np.uint64)
    h = tokenstore.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert len(tokenstore.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


@pytest.mark.parametrize("docs_a_shard", [4, 1000])
def test_token_store(spark, docs_a_shard):
    path = public.path("word_bpe_49k.json")
    docs = odd(spark)
    manifest = tokenstore.write_token_store(docs, common.shared_dir(spark), path, shard_docs=docs_a_shard)
    got = tokenstore.read_token_store(manifest).orderBy("start").collect()
    tok = tokenizers.Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in odd_rows()}
    order = sorted((i for i, _, _ in odd_rows()), key=lambda i: (i is None, i or 0))
    assert [r.doc_id for r in got] == order
    assert [r.start for r in got] == np.cumsum([0, *(len(ids[i]) for i in order)])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(ids[i], "<u4").tobytes()) for i in order]
    store = tokenstore.TokenStore(manifest)
    assert all(store.get(i).tolist() == ids[i] for i in ids if i is not None)
    assert store.get(6) is None and store.get(10**12) is None
    assert tokenstore.read_token_store(tokenstore.write_token_store(empty(spark), common.shared_dir(spark), path)).count() == 0


def test_stored_rows_are_placed_by_the_index():
    keys, has, asked = np.array([3, 5, 5, 9, 0]), np.array([True, True, True, True, False]), []

    def find(k):
        asked.extend(k.tolist())
        return np.array([{3: 0, 5: 2, 9: 3}[x] for x in k.tolist()])

    assert tokenstore.places(keys, has, find).tolist() == [0, 2, 2, 3, 4] and asked == [3, 5, 9]
    for bad in (-1, 0):
        with pytest.raises(ValueError):
            tokenstore.places(keys, has, lambda k, bad=bad: np.where(k == 9, bad, find(k)))


def test_fingerprints(spark, monkeypatch):
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(odd(spark)).collect()}
    assert got[5] == got[3] != got[7] and got[8] == got[9] == got[10] and got[11] == got[12] and got[16] == got[17]
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    # a hash that puts every text in one bucket: only the comparison of bytes tells them apart
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    rows = [(1, "a", "s"), (2, "a ", "s"), (3, "b", "s"), (4, "A", "s"), (5, "B", "s"), (6, "c", "s")]
    weak = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(spark, rows), hasher=lambda plain: "0").collect()}
    assert weak[1] == weak[2] == weak[4] == "0" and weak[3] == weak[5] and len(set(weak.values())) == 3


def test_fingerprints_in_chunks_of_buckets(spark, monkeypatch):
    rows = [(i, "abc"[i % 3] if i < 9 else f"text {i}", "s") for i in range(-5, 400)]
    hasher = lambda plain: "0" if len(plain) == 1 else plain.hex()
    want = sorted(map(tuple, fingerprints.fingerprints(frame(spark, rows), hasher=hasher).collect()))
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    assert sorted(map(tuple, fingerprints.fingerprints(frame(spark, rows), hasher=hasher).collect())) == want
    assert len({f for _, f in want}) == 3 + 391
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(odd(spark)).collect()}
    assert got[5] == got[3] != got[7] and got[8] == got[9] == got[10] and got[11] == got[12] and got[16] == got[17]
    ids = spark.range(-50, 50).select(F.col("id").alias("doc_id"))
    kept = {r.doc_id for r in common.likely(spark.range(-500, 500).select(F.col("id").alias("doc_id")), ids).collect()}
    assert set(range(-50, 50)) <= kept and len(kept) < 120


@pytest.mark.parametrize(("rows_a_range", "held"), [(3, 2), (1000, 7), (1000, 1000)])
def test_next_text_across_ranges(spark, monkeypatch, rows_a_range, held):
    monkeypatch.setattr(fingerprints, "HELD_ROWS", held)
    rows = [(i * 3, f"text {i}", "s") for i in range(20)]

    def work(ids, texts, after):
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array(after)], names=["id", "a", "b"])

    got = fingerprints.with_next(frame(spark, rows), work, "id long, a string, b string", range_rows=rows_a_range).collect()
    assert {(r.a, r.b) for r in got} == {(f"text {i}", f"text {(i + 1) % 20}") for i in range(20)} and len(got) == 20
    assert fingerprints.with_next(empty(spark), work, "id long, a string, b string").count() == 0
    assert fingerprints.with_next(odd(spark), work, "id long, a string, b string", range_rows=rows_a_range).count() == len(odd_rows())
    # an id, and null, that hold most rows: a ring through all rows all the same
    many = [(5 if i % 3 else None, f"text {i}", "s") for i in range(120)] + [(i, f"own {i}", "s") for i in range(10)]
    ring = {r.a: r.b for r in fingerprints.with_next(frame(spark, many), work, "id long, a string, b string", range_rows=rows_a_range).collect()}
    at, seen = "own 0", []
    for _ in many:
        seen.append(at)
        at = ring[at]
    assert at == "own 0" and len(set(seen)) == len(many)
    assert seen[:10] == [f"own {i}" for i in range(5)] + [x for x in seen[5:10]] and seen[-40:] == sorted(seen[-40:], key=seen.index)
    assert {x for x in seen[-40:]} == {t for i, t, _ in many if i is None}


def test_ranges_part_a_hot_key():
    import numpy as np

    r = ranges.Ranges(np.array([3, 5, 5, 5, 8]), np.array([10, -4, 0, 4, 7]), np.array([0]))
    keys, hashes = pa.array([2, 3, 3, 4, 5, 5, 5, 5, 6, 8, 8, 9, None, None]), pa.array([0, 9, 10, 0, -9, -4, 3, 99, 0, 6, 7, 0, -1, 1])
    assert r.place(keys, hashes).tolist() == [0, 0, 1, 1, 1, 2, 3, 4, 4, 4, 5, 5, 6, 7]


def test_op4_equals_brute_force(spark, small, tmp_path):
    """The query, row by row, from the texts alone; and on a table with copies, edits, nulls and empty texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = ["", None, "a b c d", "A  b c\td", "ẞtraße Ⅷ", "x" * 9000, "abcd", "abcd", "e", "ﬁn\u00a0e  "]
    own = [(i * 2, texts[i % len(texts)], "s") for i in range(31)] + [(900, "abcdefgh", "s"), (901, "ghxxxxxx", "s"), (902, "abcdefgh", "s"), (903, "abcdefgh", "s")]
    frame(spark, own).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, rows in ((small, [(r.doc_id, r.text) for r in docs.collect()]), (str(tmp_path), [(i, t) for i, t, _ in own])):
        rows = sorted((i, t or "") for i, t in rows)
        got = {r.doc_id: r for r in fingerprints.op4(spark, folder).collect()}
        assert len(got) == len(rows)
        plain = lambda t: fingerprints.canonical(t)
        same: dict = {}
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            cut = len(t) // 4
            changed = t[: len(t) - cut] + nxt[:cut]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
            assert (r.near_edited, r.near_next) == (float(plain(t) == plain(changed)), float(plain(t) == plain(nxt)))
            assert same.setdefault(plain(t), r.fingerprint) == r.fingerprint and same.setdefault(plain(changed), r.edited_fingerprint) == r.edited_fingerprint
        assert len(set(same.values())) == len(same)


def test_edited_fingerprints_where_digests_collide(spark):
    """With a digest that is the text's length, equal fingerprints still mean equal texts, edited ones included."""
    texts = ["abcdabcd", "efghefgh", "abcdabef", "zz", "abcdabcd", "", "yy", "ABCDabcd"]
    rows = sorted(((i, t, "s") for i, t in enumerate(texts)))
    got = fingerprints.edited_fingerprints(frame(spark, rows), hasher=lambda x: str(len(x))).collect()
    same: dict = {}
    for r in got:
        t, nxt = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        for plain, f in ((t, r.fingerprint), (fingerprints.edited(t, nxt), r.edited_fingerprint)):
            assert same.setdefault(fingerprints.canonical(plain), f) == f
    assert len(got) == len(texts) and len(set(same.values())) == len(same)


def test_op2_equals_the_library(spark, small):
    path = public.path("word_bpe_49k.json")
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    ids = [[*x, 1] for x in library_ids(path, [t for _, t in rows])]
    starts = np.cumsum([0, *map(len, ids)])
    got = sorted(map(tuple, tokenstore.op2(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == [(i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids, strict=False)]


def test_op6_equals_the_library(spark, small):
    path = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, library_ids(path, [t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, bpe.op6(spark, small).collect())) == want


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{min(i % 7, 3)}") for i in range(400)] + [(1000, "w " * 900, None), (1001, None, "s1")]
    got = mixing.take(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1 and target <= 2 * size
    assert abs(sum(t for _, t in by) - 1.5 * sum(len((t or "").split()) for _, t, _ in rows)) < 1
    again = mixing.take(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.take(empty(spark)).count() == 0
    assert mixing.mixed_documents(odd(spark)).columns == odd(spark).columns


def test_mixed_documents_with_null_and_repeated_ids(spark):
    """Each row as often as its own taken says, whatever its id."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(60)]
    rows += [(None, f"null {i} " * (1 + i), "a") for i in range(6)] + [(None, "null twice", "b")] * 2
    rows += [(3, "other text of three", "a"), (3, "third text", "b")] + [(5, "equal rows", "a")] * 5
    docs = frame(spark, rows)
    mark = F.struct("text", "source")
    want = Counter()
    for r in mixing.take(docs, mark=mark).collect():
        want[r.doc_id, r.mark.text, r.mark.source] += int(r.taken / r.size + 0.5)
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(docs).collect())
    assert got == +want and sum(n for (i, _, _), n in got.items() if i is None) > 5
    once = [r for r in rows if rows.count(r) == 1]
    for r in mixing.take(docs, mark=mark).collect():
        if (r.doc_id, r.mark.text, r.mark.source) in once:
            assert got[r.doc_id, r.mark.text, r.mark.source] == int(r.taken / r.size + 0.5)


def test_mix_order_follows_the_keys(spark):
    """Documents that give their last epoch are those with the smallest keys of their source."""
    rows = [(i, "w " * 5, "a") for i in range(50)] + [(100 + i, "w " * 5, "b") for i in range(200)]
    docs = frame(spark, rows)
    key = docs.select("doc_id", (-F.log(mixing.uniform(F.col("doc_id"), F.col("text"), "mix-1"))).alias("k"))  # all weigh 1
    for lo, hi in ((0, 100), (100, 400)):
        r = mixing.take(docs).join(key, "doc_id").where(f"doc_id >= {lo} and doc_id < {hi}").orderBy("k").collect()
        taken = [x.taken for x in r]
        assert taken == sorted(taken, reverse=True)


def test_mix_by_a_quality_column(spark):
    """Among documents of one size those of better quality are taken more often; the column goes."""
    rows = [(i, "w " * 5, "a") for i in range(300)] + [(1000 + i, "w " * 5, "b") for i in range(300)] + [(2000 + i, "w " * 5, "c") for i in range(300)]
    docs = frame(spark, rows).withColumn("q", F.when(F.col("doc_id") % 3 == 0, 1.0).when(F.col("doc_id") % 3 == 1, F.lit(0.05)).when(F.col("doc_id") % 6 == 2, float("nan")))
    taken = Counter()
    for r in mixing.take(docs, quality="q").where("doc_id >= 1000").collect():
        taken[r.doc_id % 3] += r.taken
    assert taken[0] > taken[1] and taken[0] > taken[2] and abs(taken[1] - taken[2]) < taken[1] / 2
    out = mixing.mixed_documents(docs, quality="q")
    assert out.columns == frame(spark, rows).columns


def test_op5_equals_its_sql(spark, small, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (small, str(tmp_path)):
        c = duckdb.connect()
        path = f"{folder}/documents.parquet" + ("/*.parquet" if folder == str(tmp_path) else "")
        c.sql(f"CREATE VIEW documents AS FROM '{path}'")
        want = c.sql("SELECT doc_id, size, source_size, target, taken FROM (" + mixing.OP5_SQL + ")").fetchall()
        got = [tuple(r) for r in mixing.op5(spark, folder).select("doc_id", "size", "source_size", "target", "taken").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, extra string")


def planted(n=500):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7)))
    docs, marks = [], []
    for i in range(n):
        w, bad, poor = [word() for _ in range(r.randint(20, 80))], i % 6 == 0, i % 5 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["you moron", "zorgle", "zorglet"])
        if poor:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "s"))
        marks.append((i, int(not poor), int(bad), "e"))
    return docs, marks


@pytest.mark.parametrize(("score", "label", "mod", "held"), [(toxicity.toxicity_scores, 2, 5, 0), (quality.quality_scores, 1, 3, 1)])
def test_classifiers_on_held_out_rows(spark, score, label, mod, held):
    docs, marks = planted()
    got = {r.doc_id: r for r in score(frame(spark, docs), labels(spark, marks)).collect()}
    assert len(got) == len(docs)
    out = [(got[m[0]].predicted, m[label]) for m in marks if got[m[0]].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % mod == held) for i in got)
    assert sum(p == y for p, y in out) / len(out) > 0.93


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_do_not_learn_from_held_out_labels(spark, score):
    docs, marks = planted(200)
    mod, held = (5, 0) if score is toxicity.toxicity_scores else (3, 1)
    turned = [(i, 1 - q, 1 - t, e) if zlib.crc32(str(i).encode()) % mod == held else (i, q, t, e) for i, q, t, e in marks]
    a, b = (sorted((r.doc_id, r.score) for r in score(frame(spark, docs), labels(spark, m)).collect()) for m in (marks, turned))
    assert a == b


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_on_edges(spark, score):
    none = labels(spark, [])
    for ls in (none, labels(spark, [(3, 1, 0, "e"), (5, None, None, "e"), (None, 1, 1, "e"), (7, 0, 1, "e"), (7, 1, 0, "e")])):
        got = score(odd(spark), ls).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in got)
    assert score(empty(spark), none).count() == 0


def test_sample_is_bounded_before_it_is_collected(spark):
    from quillspark.llm import labelled

    rows = [(i, f"text {i} " * 10, "s") for i in range(100)] + [(3, f"again {i}", "s") for i in range(500)]
    marks = labels(spark, [(i, 1, i % 2, "e") for i in range(100)] + [(None, 1, 1, "e")])
    texts, y = labelled.sample(frame(spark, rows), marks, "toxic", labelled.remainder("doc_id", 5) != 0, 40)
    assert len(texts) == len(y) == 40
    texts, y = labelled.sample(frame(spark, rows), marks, "toxic", labelled.remainder("doc_id", 5) != 0, 90, 1000)
    assert 8 <= len(texts) == len(y) <= 14


def test_large_texts_teach_where_the_others_leave_room(spark):
    from quillspark.llm import labelled

    sizes = [5000, 20, 20, 600, 20, 300]
    marks = labels(spark, [(i, 1, i % 2, "e") for i in range(6)])
    texts, y = labelled.sample(frame(spark, [(i, chr(97 + i) * n, "s") for i, n in enumerate(sizes)]), marks, "toxic", labelled.remainder("doc_id", 5) < 5, 90, 1000)
    assert [len(t) for t in texts.to_pylist()] == [20, 20, 600, 20, 300] and y.tolist() == [1, 0, 1, 0, 1]


def test_characters_of_words():
    for text in ("ab é", "日本 🙂x", "", "a\tb\nc"):
        buf, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        if len(buf):
            code, of = quality._characters(buf, off)
            assert code.tolist() == [0x20 if c in " \t\n" else ord(c) for c in text] and not of.any()
    a, b = (dict(zip("wtfp", (sorted(s.tolist()) for _, s in quality._slots(np.frombuffer(t, np.uint8), np.array([0, len(t)]))), strict=True)) for t in (b"abc abc", b"abc def abc"))
    assert set(a["t"]) <= set(b["t"]) and not set(a["p"]) & set(b["p"])


def test_isotonic_is_monotone():
    x = np.random.default_rng(0).random(300)
    at, value = toxicity.isotonic(x, (x + np.random.default_rng(1).normal(0, 0.3, 300) > 0.5).astype(float))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def test_rollups(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    store = rollups.TokenRollup(spark, folder)
    assert store.totals().count() == 0
    counts = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, "en", "v1", None)], "source string, lang string, tokenizer string, n_tokens long")
    assert store.apply("one", rollups.insert(counts)) and not store.apply("one", rollups.insert(counts))
    store.apply("two", rollups.delete(counts.where("n_tokens = 5")))
    store.apply("three", rollups.revise(counts.where("n_tokens = 10").withColumn("old_tokens", F.col("n_tokens")).withColumn("n_tokens", F.lit(7))))
    store.apply("nothing", rollups.insert(counts.limit(0)))
    want = {("a", "en", "v1", 1, 7), (None, "en", "v1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact("x")
    assert {tuple(r) for r in store.totals().collect()} == want
    assert not store.apply("two", rollups.delete(counts)) and all(map(store.committed, ("one", "two", "three"))) and not store.committed("four")
    store.apply("four", rollups.insert(counts.where("n_tokens = 5")))
    store.compact("y")
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 2, 12), (None, "en", "v1", 1, 0)}
    assert not store.apply("one", rollups.insert(counts)) and not store.apply("four", rollups.insert(counts))
    assert store.apply("compact-of-mine", rollups.insert(counts.where("n_tokens = 5"))) and store.committed("compact-of-mine")
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 3, 17), (None, "en", "v1", 1, 0)}


def test_rollup_stopped_anywhere(spark, tmp_path, monkeypatch):
    """A batch or compaction that stops before its rename changes nothing; one that stops before its deletes changes nothing either and is finished later."""
    store = rollups.TokenRollup(spark, f"file://{tmp_path}/r")
    counts = spark.createDataFrame([("a", "en", "v1", 10)], "source string, lang string, tokenizer string, n_tokens long")
    (tmp_path / "r" / "stage-lost" / "sums").mkdir(parents=True)
    assert store.totals().count() == 0 and not store.committed("one")
    assert store.apply("one", rollups.insert(counts)) and store.apply("two", rollups.insert(counts))
    real = rollups.TokenRollup._live

    def stops(self):
        found = real(self)
        if found[1]:
            raise OSError("lost")
        return found

    monkeypatch.setattr(rollups.TokenRollup, "_live", stops)
    with pytest.raises(OSError):
        store.compact("x")
    monkeypatch.setattr(rollups.TokenRollup, "_live", real)
    for _ in range(2):
        assert store.totals().first().n_tokens == 20 and store.committed("one") and not store.apply("two", rollups.insert(counts))
        store.compact("x")
    assert store._names("batch") == set() and store._names("done") == {"one", "two"}
    store.compact("z")
    assert store._names("fold") == {"z"} and store.totals().first().n_docs == 2


def test_op10_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = Counter()
    for name in rollups.FILES:
        for r, x in zip(rows, library_ids(public.path(f"{name}.json"), [r.text for r in rows]), strict=True):
            want[r.source, r.lang, f"{name}-1", "docs"] += 1
            want[r.source, r.lang, f"{name}-1", "tokens"] += len(x)
    got = {(r.source, r.lang, r.tokenizer, k): v for r in rollups.op10(spark, small).collect() for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens))}
    assert got == dict(want)
    counted = rollups.token_counts(odd(spark), {"b": public.path("byte_bpe_50k.json")})
    assert counted.columns == [c for c in odd(spark).columns if c != "text"] + ["words", "b"]
    assert sorted(r.b for r in counted.collect()) == sorted(map(len, library_ids(public.path("byte_bpe_50k.json"), [t for _, t, _ in odd_rows()])))
    assert rollups.token_counts(empty(spark), {}).count() == 0


def test_shingle_sets_match_plain_python():
    for text in ["", "a", "a b c d", "A b C d e f g a b c d e", "é\x0bx y z w v", "a b c"]:
        n = [len(s) for _, _, buf, off in textkit.groups(pa.array([text, None, text])) for s in textkit.shingle_sets(buf, off)]
        assert n == [len(shingles(text)), 0, len(shingles(text))]
    assert Counter(map(len, [shingles("a b c d e f")])) == {2: 1}


def test_rows_without_an_id_draw_each_their_own_key(spark):
    """As many bins as for rows with ids: no bin of one task holds all null or repeated ids."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    keys = rows.groupBy("doc_id").agg(F.count_distinct(mixing.uniform(F.col("doc_id"), F.col("text"), "s")).alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in keys) == [(0, 10_000), (7, 10_000)]


def test_parked_tables_leave_no_shuffle_files(spark):
    from quillspark.llm import common
    from quillspark.sources import files

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = held()
    t = common.park(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    assert spark.conf.get(files.SWEEP, "false") == "false" and held() <= before
    assert t.count() == 700 and t.agg(F.sum("count")).first()[0] == 5000
    common.unpark(t)
