"""Answer metrics: exact match and F1 of bags of spans with scales and an optimal one-to-one alignment."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N

_SCALE = {"": 1.0, "thousand": 1e3, "million": 1e6, "billion": 1e9, "percent": 0.01}
_ARTICLE = re.compile(r"\b(a|an|the)\b")


def number(text: str) -> float | None:
    """A number with $ , %, brackets for negatives or a word scale; null for other text."""
    t = text.strip().lower()
    scale = next((v for k, v in _SCALE.items() if k and k in t), 1.0)
    t = re.sub("thousand|million|billion|percent", "", t).strip()
    negative = bool(re.fullmatch(r"\(.*\)", t)) and "-" not in t
    t = t.strip("()").replace(",", "").replace("$", "").strip()
    percent = t.endswith("%")
    try:
        v = float(t.rstrip("%"))
    except ValueError:
        return None
    return round((-v if negative else v) * (0.01 if percent else scale), 4)


def normalize(text: str) -> str:
    """Lower case without punctuation and articles; numbers in one form."""
    out = []
    for w in text.lower().split():
        v = number(w)
        w = str(v) if v is not None else "".join(c for c in w if c not in string.punctuation)
        w = _ARTICLE.sub(" ", w).strip()
        if w:
            out.append(w)
    return " ".join(out)


def answer_text(answers: list[str], scale: str, raw: bool = False) -> str:
    """The answers in order, numbers as four places at their scale (``raw``: as they stand), spans with their scale word."""
    out = []
    for a in sorted(answers):
        v = number(a)
        if v is None:
            out.append(f"{a} {scale}".strip())
        elif raw or "%" in a:
            out.append(f"{v:.4f}")
        else:
            out.append(f"{round(v, 2) * _SCALE.get(scale, 1.0):.4f}")
    return " ".join(out)


def align(a: list[set], b: list[set], need_number: bool = False) -> float:
    """Mean F1 under the best one-to-one alignment of two lists of bags, zeros for what is left over."""
    n = max(len(a), len(b))
    if not n:
        return 1.0

    def f1(x: set, y: set) -> float:
        if need_number:
            nx, ny = ({w for w in z if number(w) is not None} for z in (x, y))
            if ny and not nx & ny:
                return 0.0
        i = len(x & y)
        p, r = i / len(x) if x else 1.0, i / len(y) if y else 1.0
        return 2 * p * r / (p + r) if p + r else 0.0

    cost = [[-f1(a[i], b[j]) if i < len(a) and j < len(b) else 0.0 for j in range(n)] for i in range(n)]
    # shortest augmenting paths with potentials
    inf, u, v, match = float("inf"), [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0, least, came, done = i, 0, [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            done[j0] = True
            i0, step, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], came[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[came[j0]]
            j0 = came[j0]
    return round(-sum(cost[match[j] - 1][j - 1] for j in range(1, n + 1)) / n, 2)


def span_metrics(predicted: list[str], gold: list[str], need_number: bool = False) -> tuple[float, float]:
    """(exact match, F1) of lists of spans."""
    p, g = [normalize(x) for x in predicted], [normalize(x) for x in gold]
    em = float(set(p) == set(g) and len(p) == len(g))
    return em, align([set(x.split()) for x in p], [set(x.split()) for x in g], need_number)


def qa_metrics(gold: list[str], gold_scale: str, kind: str, predicted: list[str], scale: str) -> tuple[float, float, float]:
    """(exact match, F1, scale right) of one answer; arithmetic and counts take F1 from the exact match."""
    right = float((gold_scale or "") == (scale or ""))
    if not predicted or all(x == "" for x in predicted):
        return 0.0, 0.0, right
    if kind in ("span", "multi-span"):
        em, f1 = span_metrics([f"{x} {scale}".strip() if scale else x for x in predicted], [f"{x} {gold_scale}".strip() if gold_scale else x for x in gold])
        return em, f1, right
    want = answer_text(gold, gold_scale or "")
    tries = [answer_text(predicted, scale or "")]
    if not scale and not any("%" in x for x in predicted):
        tries.append(answer_text(predicted, "", raw=True))
    em, f1 = max(span_metrics([t], [want]) for t in tries)
    return em, em if kind in ("arithmetic", "count") else f1, right


_OUT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("em", "f1", "scale_right")])


@F.pandas_udf(_OUT)
def qa(gold: pd.Series, gold_scale: pd.Series, kind: pd.Series, predicted: pd.Series, scale: pd.Series) -> pd.DataFrame:
    """Metrics of each row; null answers are empty."""
    some = lambda x: [] if x is None else list(x)
    return pd.DataFrame([qa_metrics(some(g), gs or "", k or "", some(p), s or "") for g, gs, k, p, s in zip(gold, gold_scale, kind, predicted, scale, strict=True)], columns=["em", "f1", "scale_right"])


def mixed(gold_answer: Column, gold_program: Column, gold_value: Column, answer: Column, program: Column, value: Column) -> Column:
    """struct<mode, em, f1, invalid> of an answer that is a program or a span, against a gold that is one or the other.

    ``gold_value`` and ``value`` are what the programs execute to (null: they do not). Numbers are
    compared within a thousandth of the smaller one, other answers as spans.
    """
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    spans = lambda g, p: qa(F.array(F.coalesce(g, F.lit(""))), F.lit(""), F.lit("span"), F.array(F.coalesce(p, F.lit(""))), F.lit(""))
    number = lambda c: N.lenient_number(c)
    close = lambda a, b: F.coalesce(N.mixed_close(a, b), F.lit(False)).cast("double")
    mode = F.when(has(gold_program), F.when(has(program), "program_vs_program").otherwise("answer_vs_program")).otherwise(F.when(has(program), "program_vs_span").otherwise("span_vs_span"))
    as_span = spans(gold_answer, answer)
    by_number = F.when(has(gold_program), F.when(has(program), close(value, gold_value)).when(gold_value.isNull(), 0.0).when(number(answer).isNotNull(), close(number(answer), gold_value)).otherwise(0.0)).otherwise(F.when(value.isNull(), 0.0).otherwise(close(value, number(gold_answer))))
    plain = ~has(gold_program) & ~has(program)
    invalid = F.when(has(program), value.isNull()).when(has(gold_program), gold_value.isNull()).otherwise(F.lit(False))
    return F.struct(mode.alias("mode"), F.when(plain, as_span["em"]).otherwise(by_number).alias("em"), F.when(plain, as_span["f1"]).otherwise(by_number).alias("f1"), invalid.alias("invalid"))


def self_check(golds: DataFrame, *columns: str) -> DataFrame:
    """Golds that do not score 1 as their own prediction; columns: answers, scale, kind. An empty result is what is wanted."""
    answers, scale, kind = map(F.col, columns)
    return golds.withColumn("m", qa(answers, scale, kind, answers, scale)).where("m.em < 1 or m.f1 < 1 or m.scale_right < 1").drop("m")


def grouped(scored: DataFrame, *by: str) -> DataFrame:
    """Count, sums and means of em and f1; a group without rows has means of 0."""
    ratio = lambda c: F.coalesce(F.try_divide(F.sum(c), F.count("*")), F.lit(0.0))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("em", "f1") for k, f in (("sum", F.sum), ("mean", ratio))))
