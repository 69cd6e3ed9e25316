"""Vectors against brute force, archives against what was written, the pipeline against its stages."""

import base64
import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import common, vectors, warc

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, cell string"


def brute(rows, t=0.98):
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a, la) in enumerate(ok):
        for j, b, lb in ok[k + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= t:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize(("cell", "block", "a_cell"), [(8000, 2048, 20), (20, 7, 5), (3, 7, 40)])
def test_near_duplicate_vectors(spark, monkeypatch, cell, block, a_cell):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SAMPLE_A_CELL", a_cell)  # few centroids a codebook: several codebooks
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 8))
    rows = []
    for i in range(400):
        v = base[rng.integers(25)] + rng.normal(size=8) * rng.choice([0.0, 0.03, 0.12, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 1, 4])], int(rng.integers(3))))
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0, 2.0], 1), (504, [1.0, 2.0], 1), (505, [1.0] * 8, None), (506, [1.0] * 8, None), (507, [], 1), (508, [None] + [1.0] * 7, 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = vectors.near_duplicate_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows) and len(got) == len(rows)


def test_codebooks_part_a_label_again_and_again(monkeypatch):
    x = np.random.default_rng(2).normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = vectors.codebooks(x, 10**12)
    assert len(books) == vectors.MOST_BOOKS and all(len(c) == 20 for c in books[:1]) and vectors.codebooks(x, 100) == []


def test_stars_connect_what_edges_connect():
    node, root = vectors.stars(np.array([0, 1, 5, 7]), np.array([1, 2, 6, 5]), 9)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {1: 0, 2: 0, 6: 5, 7: 5}
    assert not len(vectors.stars(np.zeros(0, np.int64), np.zeros(0, np.int64), 4)[0])


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, first_id string, path string")


def test_warc_round_trip(spark):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", r.choice(["<p>a</p>", "", None, f"<p>é {i}</p>\r\n\r\nWARC/1.1\r\n", "x" * 50_000])) for i in range(60)] + [(None, None, "<p>a</p>")]
    files = warc.write_warc(pages(spark, rows), common.shared_dir(spark), file_bytes=40_000)
    got = warc.transactions(warc.read_warc(files)).collect()
    assert len(got) == len(rows) and files.count() > 1
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for g in got:
        assert len(g.requests) == 1 and len(g.metadata) == 1
        page = g.record_id.removeprefix("<urn:page:").split(":")[0]
        if not page:
            continue
        html = dict((i, h) for i, _, h in rows)[int(page)] or ""
        assert g.payload_digest == sha(html) and g.payload_bytes == len(html.encode())
        assert (g.warc_type == "response") == (first[html] == int(page))
        if g.warc_type == "response":
            assert warc.payload_of(g.body) == html.encode() and g.refers_to is None
        else:
            assert g.refers_to == f"<urn:page:{first[html]}:{sha(html)}:1>"


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_op7_equals_brute_force(spark, small, tmp_path):
    """The query's rows from the pages alone: repeated ids with other and equal payloads, null ids, null and empty payloads."""
    odd = [(1, "u", "AAA"), (2, "u", "BBB"), (9, "u", "AAA"), (9, "u", "BBB"), (4, "u", "D"), (4, "u", "D"), (4, "v", "D"), (3, "u", None), (7, "u", ""), (None, "u", "AAA"), (None, "u", "AAA"), (None, None, "Z"), (8, None, "é")]
    pages(spark, odd).write.parquet(f"{tmp_path}/pages.parquet")
    kept = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    for folder, rows in ((str(tmp_path), odd), (small, kept)):
        least = {}
        for i, _, h in rows:
            if i is not None:
                least[h or ""] = min(i, least.get(h or "", i))
        want, led = [], set()
        for i, _, h in rows:
            h = h or ""
            leads = i is None or (least[h] == i and h not in led)
            if i is not None and leads:
                led.add(h)
            want.append((i, len(h.encode()), sha(h), "response" if leads else "revisit", None if leads else least[h], 2))
        got = [tuple(r) for r in warc.op7(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        files = warc.write_warc(spark.read.parquet(f"{folder}/pages.parquet"), common.shared_dir(spark))
        ids = [r.record_id for r in warc.read_warc(files, bodies=False).collect()]
        assert len(ids) == len(set(ids)) == 3 * len(rows)


def test_warc_edges(spark):
    folder = common.shared_dir(spark)
    assert warc.transactions(warc.read_warc(warc.write_warc(pages(spark, []), folder))).count() == 0
    rows = [(3, "u", "short"), (2, "u", "short"), (1, "u", "longer text"), (4, "u", "longer text")]
    files = warc.write_warc(pages(spark, rows), common.shared_dir(spark), min_bytes=8)
    kinds = {r.record_id: r.warc_type for r in warc.transactions(warc.read_warc(files, bodies=False)).collect()}
    assert {i[: len("<urn:page:3")]: k for i, k in kinds.items()} == {"<urn:page:3": "response", "<urn:page:2": "response", "<urn:page:1": "response", "<urn:page:4": "revisit"}


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "ngram_join", "mix", "bpe"]
    before, now = docs.columns, docs.withColumn("_score", docs["lang"]).withColumn("row", docs["doc_id"])
    for name, stage in corpus_pipeline.STAGES:
        out = common.park(stage(spark, now, small))
        if name != "bpe":
            assert out.columns == now.columns
            assert out.select("doc_id").exceptAll(now.select("doc_id")).count() == 0 or name == "mix"
        now = out
    assert {"doc_id", "n_tokens", "ids", "decoded_sha256"} <= set(now.columns) and 0 < now.count()
    assert set(before) - {"text"} <= set(now.columns)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0


def odd_documents(spark):
    """Documents with null and repeated ids, repeated rows, null, empty and long texts."""
    text = "the quick brown fox jumps over the lazy dog and runs through the green fields of the old farm"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, text + " again", "en", "b"), (None, text, "en", "a"), (None, None, None, None), (2, None, "en", "a"), (3, "", "en", "a"), (4, "you stupid moron you idiot shut up", "en", "b"), (5, "###%%% $$$ &&& ***", "en", None), (6, "word " * 20_000, "en", "c"), (7, text.upper(), "fr", "c")]
    return spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages_on_odd_rows(spark, small):
    """Each stage alone: which rows stay is what its model, the brute-force groups or the mix say of each row."""
    from collections import Counter

    import corpus_pipeline
    from pyspark.sql import functions as F

    from quillspark.llm import mixing, quality, toxicity
    from test_text_operators import brute_components

    docs = odd_documents(spark)
    count = lambda df: Counter(map(tuple, df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    source, marks = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    for name, fit, keep in (("toxicity", toxicity.fit_toxicity, lambda s: s < 0.5), ("quality", quality.fit_quality, lambda s: s >= 0.5)):
        scored = toxicity.score_texts(docs, fit(source, marks), "text", "p").collect()
        assert count(stages[name](spark, docs, small)) == Counter(tuple(r)[:-1] for r in scored if keep(r.p))
    joined = stages["ngram_join"](spark, docs, small)
    groups = brute_components([(i, t) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if i is not None])
    assert count(joined) == Counter(tuple(r) for r in docs.collect() if r.doc_id is None or groups[r.doc_id] == r.doc_id)
    weighed = toxicity.score_texts(docs, quality.fit_quality(source, marks), "text", "q")
    want = Counter()
    for r in mixing.take(weighed, quality="q", mark=F.struct(*docs.columns)).collect():
        want[tuple(r.mark)] += int(r.taken / r["size"] + 0.5) if r["size"] else 0
    assert count(stages["mix"](spark, docs, small)) == +want
    coded = stages["bpe"](spark, docs, small)
    assert coded.count() == docs.count() and set(coded.columns) == set(docs.columns) - {"text"} | {"n_tokens", "ids", "decoded_sha256"}
    assert {(r.n_tokens, r.decoded_sha256) for r in coded.where("n_chars = 0").collect()} == {(0, hashlib.sha256(b"").hexdigest())}


def test_pipeline_keeps_one_of_each_group(spark, small):
    """The third stage on what the first two keep, against all pairs."""
    import corpus_pipeline
    from test_text_operators import brute_components

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.select("doc_id", "text").collect() if name == "ngram_join" else None
        docs = common.park(stage(spark, docs, small))
    groups = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(set(groups.values()))
