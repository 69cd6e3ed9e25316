"""The library's functions by name in SQL: scalar functions and table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import qa
from ..operators.rendering import html_markdown
from ..shipping import ship
from .programs import _nested, canonical_form, parse_nested, same_algebra


class ProgramSteps:
    """(step, op, a, b) of a nested program in post-order; no row for one that does not parse."""

    def eval(self, program: str | None) -> Iterator[tuple[int, str, str, str]]:
        steps, _ = _nested(program)
        for i, s in enumerate(steps or []):
            yield i, s["op"], s["a"], s["b"]


class DerivationTokens:
    """(position, kind, token) of a derivation: numbers, operators, brackets and words in order."""

    FORM = re.compile(r"(?P<number>[$]?[0-9][0-9,]*(?:[.][0-9]+)?%?)|(?P<operator>[-+*/])|(?P<bracket>[()])|(?P<word>[A-Za-z]+)")

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        for i, m in enumerate(self.FORM.finditer(text or "")):
            yield i, m.lastgroup, m.group()


def register(spark: SparkSession) -> list[str]:
    """Register all of them; returns their names."""
    ship(spark)
    scalar = {"program_parse": parse_nested, "program_canonical": canonical_form, "program_same": same_algebra, "answer_metrics": qa, "html_markdown": html_markdown}
    for name, f in scalar.items():
        spark.udf.register(name, f)
    tables = {"program_steps": (ProgramSteps, "step int, op string, a string, b string"), "derivation_tokens": (DerivationTokens, "position int, kind string, token string")}
    for name, (c, schema) in tables.items():
        spark.udtf.register(name, F.udtf(c, returnType=schema))
    return [*scalar, *tables]
