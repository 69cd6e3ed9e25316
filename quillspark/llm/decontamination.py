"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is ``SPAN`` words. The hashes of its runs of ``RUN`` words are compared and the smallest is the
window's fingerprint, so equal windows have equal fingerprints wherever they stand and every shared
span of ``SPAN`` words or more is found. A document's distinct fingerprints are joined with those of the
benchmark; where one meets, the windows that have it are compared word by word. Items of fewer words
are one window each: their hash is looked up at every place of a text.

Scale. Texts are never shuffled. The first pass writes a document's fingerprints (0.4 a word), the
second reads again only the texts whose key is in a bit table of 16 MB at most, whatever the corpus.
Benchmark fingerprints and windows are broadcast if they are few and short (both are counted), else the
same joins shuffle. A passage that many documents or items share is one window: it meets a text by
equality, not by pairs, and the items of a window are looked up once for a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely, park

#: Words of a window, and of the runs whose smallest hash stands for it: SPAN - RUN + 1 hashes a window.
SPAN, RUN = 10, 7
#: Windows of the benchmark, and bytes of their words, that are broadcast at most.
MOST_WINDOWS, MOST_BYTES = 300_000, 64 << 20
#: What parts words while A-Z are not yet lower-cased: every ASCII character but letters and digits (one by one, which the regex engine looks up in a table).
BREAK = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def lowered(word: Column) -> Column:
    """The word with A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: Column, use: Callable[[Column], Column] = lambda w: w) -> Column:
    """``use`` of each word of a text, A-Z lower-cased; null has none."""

    def parts(t: Column) -> Column:
        return F.array_remove(F.split(t, BREAK), "")

    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII alone
    return F.when(plain, F.transform(parts(F.lower(text)), lambda w: use(w))).otherwise(F.transform(parts(text), lambda w: use(lowered(w))))


def _from(x: Column, k: int) -> Column:
    return F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))


def sliding(x: Column, n: int, op: Callable[[Column, Column], Column]) -> Column:
    """op over each n neighbours of x, by doubling; only the first size(x) - n + 1 entries are whole."""

    def step(v: Column, k: int) -> Column:
        return let(v, lambda u: F.zip_with(u, _from(u, k), lambda a, b: op(a, b)))

    have = 1
    while 2 * have <= n:
        x, have = step(x, have), 2 * have
    return step(x, n - have) if have < n else x


def _whole(x: Column, n: Column, width: int) -> Column:
    return F.slice(x, 1, F.greatest(n - (width - 1), F.lit(0)))


def fingerprints(h: Column, span: int = SPAN, run: int = RUN) -> Column:
    """The fingerprint of each window of ``span`` words, from the hashes of the words."""
    hashed = let(h, lambda v: _whole(sliding(v, run, F.xxhash64), F.size(v), run))
    return let(hashed, lambda g: _whole(sliding(g, span - run + 1, F.least), F.size(g), span - run + 1))


def short_prints(h: Column, n: int) -> Column:
    """Hashes of all runs of n words, told apart from fingerprints and other lengths."""
    return F.transform(let(h, lambda v: _whole(sliding(v, n, F.xxhash64), F.size(v), n)), lambda x: F.xxhash64(F.lit(n), x))


def _spots(h: Column, lengths: list[int]) -> Column:
    """(start, words, print) of all windows of a text: ``SPAN`` words, and those of ``lengths``."""
    spot = lambda n: lambda f, i: F.struct(i.alias("start"), F.lit(n).alias("n"), f.alias("print"))
    parts = [F.transform(fingerprints(h), spot(SPAN))] + [F.transform(short_prints(h, n), spot(n)) for n in lengths]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _placed(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(keep, start, n, print, window) of all windows of ``rows.ws``; a window is its words, none of which holds a space."""
    spots = rows.select(*keep, "ws", F.inline(let(F.transform("ws", lambda w: F.xxhash64(w)), lambda h: _spots(h, lengths))))
    return spots.select(*keep, "start", "n", "print", F.size("ws").alias("size"), F.array_join(F.slice("ws", F.col("start") + 1, F.col("n")), " ").alias("window"))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(item, n, print, window) of every item's windows, and the lengths below ``SPAN`` that occur (nine at most). Texts without words have none."""
    items = park(benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0))
    lengths = sorted(r[0] for r in items.select(F.size("ws").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # SPAN - 1 rows at most
    return _placed(items, lengths, "item").where((F.col("n") == SPAN) | (F.col("n") == F.col("size"))).select("item", "n", "print", "window"), lengths


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    Null and empty texts have no words. Rows with a null or repeated id are rows like any other, equal
    rows have equal results. Of the benchmark, rows that repeat an item_id are one item with the windows
    of all of them; windows of a row with a null item_id mark words but name no item. A very long text is
    one row: its arrays are a few times its size. An empty benchmark hits nothing.
    """
    own, lengths = benchmark_windows(benchmark, item_col, item_text_col)
    sets = park(own.groupBy("window", "n", "print").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("set", F.sha2(F.to_json("items"), 256)))
    windows = sets.select("window", "n", "print", "set")
    size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
    hint = F.broadcast if size[0] <= most_windows and (size[1] or 0) <= most_bytes else (lambda df: df)
    prints = windows.select("print").distinct()

    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col)), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))

    def one_text(h: Column) -> Column:
        found = [F.array_distinct(fingerprints(h)), *(F.array_distinct(short_prints(h, n)) for n in lengths)]
        return F.struct(F.size(h).cast("long").alias("n_words"), (F.concat(*found) if len(found) > 1 else found[0]).alias("prints"))

    held = park(rows.select("doc_id", "key", let(words(F.col("text"), F.xxhash64), one_text).alias("r")).select("doc_id", "key", "r.n_words", "r.prints"))
    met = held.select("key", F.explode("prints").alias("print")).join(hint(prints), "print", "left_semi").select("key").distinct()
    again = likely(rows.select("key", "text"), park(met), "key").select("key", words(F.col("text")).alias("ws"))
    spots = _placed(again, lengths, "key").join(hint(prints), "print", "left_semi")
    hits = park(spots.join(hint(windows.select("window", "n", "set")), ["window", "n"]).select("key", "start", "n", "set"))

    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")))).alias("spans"))
    # spans ascend by their start: each adds what lies past the furthest end so far
    add = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"))
    covered = spans.select("key", F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda acc: acc["n"].cast("long")).alias("n_hit"))
    named = hits.select("key", "set").distinct().join(sets.select("set", F.explode("items").alias("item")).distinct(), "set")
    named = named.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(named, "key", "left").select("key", "n_hit", F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256"))
    out = held.select("doc_id", "key", "n_words").join(found, "key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op11(spark, sf_dir):
    """Full result over ``documents`` and ``benchmark``."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every window of every text by its words, without fingerprints.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON n <= len(ws))),
hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, w)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
