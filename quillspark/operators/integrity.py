"""Manifests, violations, leakage, corruption and caches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import programs as P


def row_hash(*cols: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols)), 256)


def manifest(df: DataFrame, kind: str, cols: list[str], parents: dict[str, str] | None = None) -> DataFrame:
    """One row: kind, rows, an order-free digest of all rows, parents. The digest sums hashes by parts, so no task holds them all."""
    h = df.select(row_hash(*cols).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    g = h.agg(F.count("*").alias("rows"), *(F.coalesce(part(k), F.lit(0)).cast("string").alias(f"p{k}") for k in range(5)))
    chain = F.concat_ws("|", F.lit(kind), F.col("rows").cast("string"), *(f"p{k}" for k in range(5)), *(F.lit(f"{k}={v}") for k, v in sorted((parents or {}).items())))
    return g.select(F.lit(kind).alias("kind"), "rows", F.sha2(chain, 256).alias("digest"))


def violations(**checks: DataFrame) -> DataFrame:
    """(check, id) of all checks; each gives rows with one id column. Empty means passed."""
    out = None
    for name, df in checks.items():
        d = df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("string").alias("id"))
        out = d if out is None else out.unionByName(d)
    return out


def leaks(texts: DataFrame, key: str, text: str, secrets: dict[str, Column]) -> DataFrame:
    """(key, check): rows whose text holds one of the secret values of the row, or a year."""
    found = F.array_compact(F.array(*(F.when((F.length(v) > 0) & F.contains(F.lower(F.col(text)), F.lower(v)), F.lit(n)) for n, v in secrets.items()), F.when(F.col(text).rlike(r"\b(19|20)[0-9]{2}\b"), F.lit("year"))))
    return texts.select(key, F.explode(found).alias("check"))


def corrupt_operation(x: Column) -> Column:
    """The first of add, subtract, multiply and divide swapped with its opposite."""
    op = F.regexp_extract(x, r"\b(add|subtract|multiply|divide)\b", 1)
    other = F.when(op == "add", "subtract").when(op == "subtract", "add").when(op == "multiply", "divide").when(op == "divide", "multiply")
    at = F.instr(x, op)
    return F.when(op != "", F.overlay(x, other, at, F.length(op))).otherwise(x)


def misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Wanted rows without a cached answer: what a resumed run still has to do."""
    return wanted.join(cache.select(key), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def drifted(cache: DataFrame, *runtime: str) -> DataFrame:
    """(setting, values) of runtime settings of which the cache holds several values; empty if it may be used."""
    g = cache.agg(*(F.count_distinct(c).alias(c) for c in runtime))
    return g.unpivot([], list(runtime), "setting", "values").where("values > 1")


def answered(wanted: DataFrame, cache: DataFrame, call, schema: str, key: str = "key") -> DataFrame:
    """Cached answers, and answers of ``call`` (an Arrow function given by the user) for what is missing."""
    live = misses(wanted, cache, key).mapInArrow(call, schema)
    return cache.join(wanted.select(key), key, "left_semi").select(*live.columns).unionByName(live)


def case_violations(cases: DataFrame, key: str) -> DataFrame:
    """(check, id) of cases that do not hold what their program says.

    cases: program, table, steps (array<struct<op, a, b>>), vals (array<double>), grounding (map of row
    label to numbers), answer. contract: a field is missing. fidelity: the steps are not those of the
    program. grounding: the steps do not give the stored values from the grounding alone. official: the
    public scorer does not get the answer. Comparisons are null-safe; all faults of a case are listed.
    """
    fields = ("program", "table", "steps", "vals", "grounding", "answer")
    r = cases.withColumn("_parsed", P.parse_linear(F.col("program"))).withColumn("_run", P.execute(F.col("steps"), known_rows=F.col("grounding"))).withColumn("_official", P.official_run(F.col("program"), F.col("table")))
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b)), a.isNull() & b.isNull())
    same = F.coalesce((F.size("_run.vals") == F.size("vals")) & F.forall(F.zip_with("_run.vals", "vals", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: near(z["a"], z["b"])), F.lit(False))
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    checks = {"contract": missing, "fidelity": ~F.col("_parsed").eqNullSafe(F.col("steps")), "grounding": ~same, "official": F.coalesce(F.col("_official.invalid"), F.lit(True)) | ~near(F.col("_official.value"), F.round("answer", 5))}
    found = F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in checks.items()))))
    return r.select(found.alias("check"), F.col(key).cast("string").alias("id"))


def grounding(steps: Column, table: Column) -> Column:
    """Rows of the table that a program's table operations read: map of label to numbers."""
    labels = F.array_distinct(F.transform(F.filter(steps, lambda s: s["op"].startswith("table_")), lambda s: s["a"]))
    return F.map_from_arrays(labels, F.transform(labels, lambda x: P.row_values(table, x)))


def label_leaks(texts: DataFrame, key: str, text: str, labels: dict[str, Column]) -> DataFrame:
    """(key, field) of retrieval texts that hold one of their own labels; labels of fewer than three characters are not told from chance."""
    low = F.lower(F.col(text))
    found = F.explode(F.array_compact(F.array(*(F.when((F.length(v) > 2) & F.contains(low, F.lower(v)), name) for name, v in labels.items()))))
    return texts.select(key, found.alias("field"))


def total_faults(parts: DataFrame, totals: DataFrame, key: str, *counts: str) -> DataFrame:
    """(key, field, parts, total) where counts of audit rows do not add up to the stated totals; missing ones count 0."""
    a = parts.groupBy(key).agg(*(F.sum(c).alias(f"_{c}") for c in counts))
    j = a.join(totals, key, "full_outer")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("long").alias("parts"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("total")) for c in counts)))
    return j.select(key, each.alias("f")).select(key, "f.*").where("parts <> total")


def strategy_faults(strategies: DataFrame, key: str, fields: str, required: list[str], text: str, support: str, train_rows: int, least_share: float = 0.0) -> DataFrame:
    """(check, id) of strategies (map of fields): keys that are missing, texts that name a number or year, texts that repeat, too little support."""
    lack = F.array_except(F.array(*map(F.lit, required)), F.map_keys(F.map_filter(fields, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")))
    plain = F.lower(F.regexp_replace(F.trim(F.col(text)), r"\s+", " "))
    s = strategies.select(F.col(key).cast("string").alias("id"), lack.alias("lack"), plain.alias("plain"), F.col(support).alias("support"))
    again = s.groupBy("plain").agg(F.count("*").alias("m"), F.min("id").alias("first")).where("m > 1")
    faults = F.array_compact(F.array(F.when(F.size("lack") > 0, F.concat(F.lit("missing:"), F.array_join("lack", ","))), F.when(F.col("plain").rlike(r"[0-9]"), "leak"), F.when(F.col("support") < train_rows * least_share, "coverage")))
    return s.select(F.explode(faults).alias("check"), "id").unionByName(s.join(again, "plain").where("id <> first").select(F.lit("duplicate").alias("check"), "id"))


def truncation(contexts: DataFrame, key: str, paragraphs: str, most: int = 600) -> DataFrame:
    """(key, chars, kept, lost_share): how much of the paragraphs a cap on each one's length leaves."""
    total = lambda f: F.aggregate(F.transform(paragraphs, f), F.lit(0), lambda a, v: a + v).cast("long")
    c = contexts.select(key, total(F.length).alias("chars"), total(lambda p: F.least(F.length(p), F.lit(most))).alias("kept"))
    return c.withColumn("lost_share", F.coalesce(1 - F.try_divide("kept", "chars"), F.lit(0.0)))


def case_leaks(texts: DataFrame, key: str, text: str, company: Column, answer: Column, entities: Column) -> DataFrame:
    """(key, check) of strategies that name their source's company, a year, its answer or one of its entities (array)."""
    low = F.lower(F.col(text))
    holds = lambda v: (F.length(v) > 0) & F.contains(low, F.lower(v))
    checks = {"company": holds(company), "year": F.col(text).rlike(r"\b(19|20)[0-9]{2}\b"), "answer": holds(answer), "entity": F.exists(entities, lambda e: (F.length(e) > 2) & F.contains(low, F.lower(e)))}
    return texts.select(key, F.explode(F.array_compact(F.array(*(F.when(t, n) for n, t in checks.items())))).alias("check"))


def corrupted(text: Column, kind: Column) -> Column:
    """struct<text, mutation>: a strategy text with a drift of its scale, operation or operand roles, and what was changed; null if nothing was.

    scale: the first of times 100 and by 100 swapped. operation: as ``corrupt_operation``. operand_role: the first pair of role words swapped.
    """
    swap = lambda a, b: F.when(F.contains(text, F.lit(a)), F.struct(F.replace(text, F.lit(a), F.lit(b)).alias("text"), F.lit(f"{a} -> {b}").alias("mutation")))
    scale = F.coalesce(swap("multiply by 100", "divide by 100"), swap("divide by 100", "multiply by 100"), swap("percent", "decimal"))
    other = corrupt_operation(text)
    operation = F.when(other != text, F.struct(other.alias("text"), F.concat(F.regexp_extract(text, r"\b(add|subtract|multiply|divide)\b", 1), F.lit(" -> other")).alias("mutation")))
    both = lambda a, b: F.when(F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)), F.struct(F.replace(F.replace(F.replace(text, F.lit(a), F.lit("\x01")), F.lit(b), F.lit(a)), F.lit("\x01"), F.lit(b)).alias("text"), F.lit(f"{a} <-> {b}").alias("mutation")))
    role = F.coalesce(both("numerator", "denominator"), both("current", "prior"), both("first", "second"))
    none = F.struct(text.alias("text"), F.lit(None).cast("string").alias("mutation"))
    return F.coalesce(F.when(kind == "scale", scale).when(kind == "operation", operation).when(kind == "operand_role", role), none)


def usable(cache: DataFrame, runtime: dict[str, object]) -> DataFrame:
    """(rows of the cache, ``hit``): whether a cached row was made with the settings of now; others must be answered anew."""
    same = F.lit(True)
    for k, v in runtime.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return cache.withColumn("hit", same)


def release_report(checks: dict[str, DataFrame], expected_rows: dict[str, tuple[DataFrame, int]] | None = None) -> DataFrame:
    """(check, faults, first): every check recomputed from the tables, with its number of faults and smallest id; a release is valid if all are 0.

    ``expected_rows`` adds a check of each table's row count. No check stops another.
    """
    names = [*checks, *(f"rows:{k}" for k in expected_rows or {})]
    found = violations(**checks) if checks else None
    for k, (df, n) in (expected_rows or {}).items():
        bad = df.agg(F.count("*").alias("n")).where(F.col("n") != n).select(F.lit(f"rows:{k}").alias("check"), F.col("n").cast("string").alias("id"))
        found = bad if found is None else found.unionByName(bad)
    every = found.sparkSession.createDataFrame([(n,) for n in names], "check string")
    return every.join(found.groupBy("check").agg(F.count("*").alias("faults"), F.min("id").alias("first")), "check", "left").select("check", F.coalesce("faults", F.lit(0)).alias("faults"), "first")
