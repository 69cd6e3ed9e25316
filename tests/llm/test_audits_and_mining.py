"""Benchmark overlap, filter audit and hard negatives against brute force on awkward rows."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark.llm import decontamination, filteraudit, hardnegatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, key string, item_id string, lang string"


def overlap(docs, bench):
    windows = {}
    for item, text in bench:
        ws = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows.setdefault(tuple(ws[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws = WORD.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if (got := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= {str(x) for x in got if x is not None}
        out.append((doc, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize("most", [10**6, 0])
def test_benchmark_overlap(spark, most):
    rnd = random.Random(5)
    vocab = ["a", "B", "été", "ÉTÉ", "x1", "日本", "Zz", "q"]
    bench = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 9, 10, 11, 25, 40])))) for i in range(12)]
    bench += [(3, "one item, two ROWS"), (None, "nobody's own words stand here in a row of more than ten"), (90, None), (91, "  ,;"), (92, bench[0][1]), (93, bench[0][1])]
    docs = []
    for i in range(60):
        ws = rnd.choices(vocab, k=rnd.choice([0, 1, 5, 12, 60]))
        for _ in range(rnd.randrange(3)):
            part = WORD.findall(rnd.choice(bench)[1] or "")
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = part[rnd.randrange(3) :]
        docs.append((i, rnd.choice([" ", ", ", "\n\x00"]).join(ws)))
    docs += [(None, docs[0][1]), (None, docs[0][1]), (5, "another text of a repeated id"), (70, None), (71, ""), (72, "One item; two rows!"), (73, " ".join(rnd.choices(vocab, k=30_000)) + " " + bench[5][1])]
    d = spark.createDataFrame([(*r, "k", "i", "en") for r in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, doc_id int")
    got = decontamination.contamination(d, b, most_windows=most)
    same([tuple(r) for r in got.collect()], overlap(docs, bench))
    if most:
        empty = decontamination.contamination(d, b.limit(0)).collect()
        assert len(empty) == len(docs) and not any(r.contaminated for r in empty)
        assert decontamination.contamination(d.limit(0), b).count() == 0


def test_windows_of_one_span_share_a_fingerprint(spark):
    text = " ".join(f"w{i}" for i in range(14))
    row = spark.createDataFrame([(text, "other words before " + text + " and after")], "a string, b string")
    f = lambda c: decontamination.let(decontamination.words(c, decontamination.F.xxhash64), decontamination.fingerprints)
    a, b = row.select(f(decontamination.F.col("a")), f(decontamination.F.col("b"))).first()
    assert len(a) == 5 and b[3:8] == a


def audit(docs, labels):
    marks = {}
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (False, False))
            marks[i] = (old[0] or q == 1, old[1] or t == 1)
    first, rows = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > first[text])
        rows.append((lang or "", fails, *marks.get(i, (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], [0] * 5, []
        for order in permutations(range(5)):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                failing = [r for r in own if r[1][f]]
                lines.append((f, part, "".join("ABCDE"[x] for x in order), k + 1, len(left), len(gone), len(failing) - len(gone), sum(sum(r[1]) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*line[1:], shapley[line[0]]) for line in lines]
    return out


def test_filter_audit(spark):
    rnd = random.Random(2)
    long = " ".join(f"word{i}" for i in range(250))
    kinds = [long, long + " #", "A" * 40 + " " + long, "same " * 300, "same " * 300 + "$", "short", "SHORT!", "", None, " \t\n", "é ß " * 150]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(kinds), rnd.choice(["en", "de", "", None])) for _ in range(150)] + [(7, long, "en")] * 5
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1, 2])) for _ in range(60)]
    d = spark.createDataFrame([(*r, 1, "n") for r in docs], "doc_id long, text string, lang string, n int, part string").repartition(3)
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string")
    same([tuple(r) for r in filteraudit.filter_audit(d, lab).collect()], audit(docs, labels))
    assert filteraudit.filter_audit(d.limit(0), lab).count() == 0
    assert filteraudit.filter_audit(d, lab.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_exact_failures_come_from_joint_ones(spark):
    rng = np.random.default_rng(1)
    exact = rng.integers(0, 9, 32)
    joint = [int(sum(exact[t] for t in range(32) if t & s == s)) for s in range(32)]
    df = spark.createDataFrame([(joint,)], "v array<long>")
    assert df.select(filteraudit.exact_failures(df.v)).first()[0] == exact.tolist()


def test_null_ids_of_many_texts_are_many_tasks(spark):
    """Rows with a null id meet no label, so they are dealt by their text where labels are joined."""
    d = spark.range(20_000).selectExpr("cast(null as long) AS doc_id", "concat('t', id) AS text", "'en' AS lang")
    lab = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    got = filteraudit.filter_audit(d, lab).where("step = 1 and filter_order like 'A%'").first()
    assert (got.removed, got.kept) == (20_000, 0)


def negatives(rows):
    ok, seen = [], {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or not all(x is not None and np.isfinite(x) and abs(x) <= 2.0**40 for x in v):
            continue
        whole = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in whole) < 1 << 62:
            seen.setdefault(i, []).append((lab, v, whole))
    for i, all_of in seen.items():
        lab, _, whole = min(all_of)
        ok.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, whole))
    out = []
    for a, la, va in ok:
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, vb, strict=True)), b, lb) for b, lb, vb in ok if b != a and len(vb) == len(va))
        for p, b, _ in [s for s in scores if s[2] == la][:5]:
            band = [s for s in scores if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, b, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(band)]
    return out


@pytest.mark.parametrize(("anchors", "group", "batch", "lead"), [(2048, 65536, 2048, 16), (3, 50, 7, 2)])
def test_hard_negatives(spark, monkeypatch, anchors, group, batch, lead):
    for k, v in {"ANCHORS": anchors, "GROUP": group, "BATCH": batch, "LEAD": lead}.items():
        monkeypatch.setattr(hardnegatives, k, v)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8)) * [3, 2, 1, 1, 0.5, 0.2, 0.1, 0.1]
    rows = [(int(i), [float(np.float32(x)) for x in base[rng.integers(6)] + rng.normal(size=8) * rng.choice([0, 0.1, 1])], int(rng.integers(3))) for i in rng.permutation(900)]
    rows += [(1000 + i, [1.0, 0.5], i % 2) for i in range(0, 300, 50)]  # other length, all scores tie
    rows += [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] * 8, 1), (2400, [1.0] * 8, None), (2500, [], 1), (2600, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (2700, [1e300] * 8, 1), (2800, [float(2**39)] * 8, 1)]
    rows += [(100, [9.0] * 8, 9), (100, [8.0] * 8, 9), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, positive string, score int").repartition(5)
    got = hardnegatives.hard_negatives(df)
    want = negatives(rows)
    same([tuple(r) for r in got.collect()], want)
    assert len(want) > 100
    assert hardnegatives.hard_negatives(df.limit(0)).count() == 0


def test_bounds_drop_early_and_miss_nothing():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    x = np.floor(rng.normal(size=(300, 64)) * 32 * np.linspace(2, 0.1, 64)).astype(np.int64)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    make = lambda rows: hardnegatives.Block(pa.array(rows.tolist(), pa.list_(pa.int64())), 64, turn)
    a, b = make(x[:50]), make(x)
    want = x[:50] @ x.T
    least = np.sort(want, axis=1)[:, -10]
    i, j, score = hardnegatives.survivors(a, b, least, np.ones(want.shape, bool))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(want >= least[:, None])), strict=True))
    assert (score == want[i, j]).all()
    # the leading components decide more pairs than as many components of vectors that are not turned
    left = lambda p, q, k: (p.turned[:, : 16 * k + 16] @ q.turned[:, : 16 * k + 16].T + np.outer(p.rest[k], q.rest[k]) >= least[:, None]).mean()
    plain = lambda rows: hardnegatives.Block(pa.array(rows[:, ::-1].tolist(), pa.list_(pa.int64())), 64, None)
    assert left(a, b, 1) < 0.3 and left(a, b, 1) < 0.5 * left(plain(x[:50]), plain(x), 1)


@pytest.mark.parametrize(("query", "sql"), [(decontamination.op11, decontamination.OP11_SQL), (filteraudit.op12, filteraudit.OP12_SQL), (hardnegatives.op13, hardnegatives.OP13_SQL)])
def test_queries_against_sql(spark, small, query, sql):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    got, want = query(spark, small).toPandas(), c.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_one_long_text_does_not_empty_the_training_sample(spark):
    from quillspark.llm import labelled

    texts = [(i, "short text " + str(i)) for i in range(60)]
    first = min(range(60), key=lambda i: spark.sql(f"SELECT xxhash64(cast({i} AS long))").first()[0])
    texts[first] = (first, "x" * 4000)
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got, y = labelled.sample(docs, labels, "quality", labelled.F.lit(True), 100, most_bytes=3000)
    assert len(got) == len(y) == 59 and max(map(len, got.to_pylist())) < 100
    got, _ = labelled.sample(docs, labels, "quality", labelled.F.lit(True), 100, most_bytes=300)
    assert 0 < sum(len(t) for t in got.to_pylist()) <= 300


def test_unknown_id_with_the_fingerprint_of_a_stored_one(tmp_path, monkeypatch):
    from quillspark.llm import fsio, tokenstore

    monkeypatch.setattr(tokenstore, "fingerprint", lambda keys: np.zeros(len(keys), np.uint32))
    keys = np.array([3, 8, 21], np.int64)
    fsio.write_whole(str(tmp_path / "s.qts"), tokenstore.pack_shard(keys, np.ones(3, bool), np.array([0, 1, 2, 3]), np.array([7, 8, 9], "<u2")))
    shard = tokenstore.Shard(str(tmp_path / "s.qts"))
    assert shard.find(np.arange(200)).tolist() == [{3: 0, 8: 1, 21: 2}.get(i, -1) for i in range(200)]


def test_lookup_of_an_id_that_spans_shards(spark):
    """The first stored row of an id answers."""
    import public_tokenizers

    from quillspark.llm import common, tokenstore

    rows = [(5, "five"), (7, "b"), (7, "a"), (7, "c d"), (7, "e f g"), (9, "nine nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = tokenstore.write_token_store(docs, common.shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), shard_docs=2)
    assert manifest.count() == 3
    stored = [r for r in tokenstore.read_token_store(manifest).orderBy("start").collect() if r.doc_id == 7]
    import zlib

    store = tokenstore.TokenStore(manifest)
    assert zlib.crc32(store.get(7).astype("<u4").tobytes()) == stored[0].ids_crc32
    assert store.get(6) is None and store.get(8) is None and store.get(4) is None and store.get(10) is None
    assert len(store.get(5)) and len(store.get(9))
