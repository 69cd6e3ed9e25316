"""String, regex and HTML functions: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def collapse(x: Column, lower: bool = True) -> Column:
    """Runs of white space as one space, trimmed, lower-cased."""
    y = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.lower(y) if lower else y


def truncate(x: Column, most: int) -> Column:
    """Texts of more than ``most`` characters are cut and end in three dots."""
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most))), F.lit("..."))).otherwise(x)


def norm_tokens(x: Column) -> Column:
    """Lower-case alphanumeric tokens (one inner hyphen allowed) and percent signs."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?|%"), F.lit(0))


def token_estimate(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"))


def question_template(x: Column, years_first: bool = True) -> Column:
    """Numbers become <num>, years <year>. The two dialects differ in which goes first."""
    year = lambda c: F.regexp_replace(c, r"\b(19|20)[0-9][0-9]\b", "<year>")
    number = lambda c: F.regexp_replace(c, r"[$]?[0-9][0-9,]*([.][0-9]+)?%?", "<num>")
    y = collapse(x)
    return number(year(y)) if years_first else year(number(y))


def html_to_text(x: Column, most: int | None = None) -> Column:
    """Row and block ends become lines, cells are parted by bars, other tags go, empty cells and lines go."""
    y = F.regexp_replace(x, r"(?i)</(tr|p|div|li|h[1-6])\s*>", "\n")
    y = F.regexp_replace(y, r"(?i)<(td|th)[^>]*>", "|")
    y = F.regexp_replace(y, r"<[^>]*>", "")
    lines = F.transform(F.split(y, "\n"), lambda line: F.array_join(F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(F.regexp_replace(c, r"[ \t\r]+", " "))), lambda c: c != ""), " | "))
    out = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    return F.left(out, F.lit(most)) if most else out


def hierarchy_markers(x: Column) -> Column:
    """Counts of markup that hints at structure."""
    count = lambda p: F.regexp_count(x, F.lit(p)).cast("long")
    return F.struct(count("rowspan").alias("rowspans"), count("colspan").alias("colspans"), count("<th").alias("heads"), count("<li").alias("items"), count("<p").alias("paragraphs"))


def json_object(x: Column) -> Column:
    """From the first opening to the last closing brace of a noisy text; null if there is none."""
    y = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(y != "", y)


def count_label(n: Column) -> Column:
    words = F.array(*(F.lit(w) for w in "zero one two three four five six seven eight".split()))
    return F.when(n.between(0, 8), F.get(words, n.cast("int")))


def report_of(x: Column) -> Column:
    """First two parts of a path-like id."""
    return F.substring_index(x, "/", 2)


def company_of(x: Column) -> Column:
    return F.substring_index(x, "/", 1)


#: Words for scales and what they are called.
SCALES = {"none": "", "thousand": "thousand", "thousands": "thousand", "million": "million", "millions": "million", "billion": "billion", "billions": "billion", "percent": "percent", "percentage": "percent", "%": "percent"}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_tokens(x: Column) -> Column:
    """Words between white space without the punctuation at their ends; empty ones go."""
    return F.filter(F.transform(F.split(F.trim(x), r"\s+"), lambda w: F.trim(w, F.lit(_PUNCTUATION))), lambda w: w != "")


def contains_any(x: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text between blanks, whatever its case."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(x, F.lit(""))), F.lit(" "))
    return F.exists(F.array(*(F.lit(f" {t.lower()} ") for t in terms)), lambda t: F.contains(padded, t)) if terms else F.lit(False)


def same_items(a: Column, b: Column) -> Column:
    """Whether two lists of strings are equal but for order, case and blanks around them."""
    plain = lambda c: F.array_sort(F.transform(c, lambda v: F.lower(F.trim(v))))
    return plain(a) == plain(b)


def scale_name(x: Column) -> Column:
    """One name for each scale; unknown ones stay as they are, lower-cased."""
    y = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in SCALES.items() for v in kv)), y), y)


def canonical_answer(answer: Column, scale: Column) -> Column:
    """struct<answer, scale, changes> of a plain number with signs and a scale word around it; other texts stay.

    A scale word in the answer becomes the scale if there is none; ``changes`` names what was done, in order of the alphabet.
    """
    form = r"(?i)^[$€£¥]?\s*([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?|[+-]?[.][0-9]+)\s*(thousands?|millions?|billions?|percent(?:age)?|%)?$"
    text = F.regexp_replace(F.trim(answer), r"\s+", " ")
    parts = F.struct(text.alias("t"), F.regexp_replace(F.regexp_extract(text, form, 1), r"^[+]|,", "").alias("n"), scale_name(F.regexp_extract(text, form, 2)).alias("own"), scale_name(scale).alias("s"))

    def read(v: Column) -> Column:
        made = F.array(
            F.when(v["n"] != v["t"], "numeric_format"),
            F.when(v["own"] != "", F.concat(F.lit("embedded_scale:"), v["own"])),
            F.when((v["own"] != "") & (v["s"] == ""), "scale_split").when((v["own"] != "") & (v["s"] == v["own"]), "duplicate_scale_removed").when(v["own"] != "", F.concat(F.lit("scale_conflict:"), v["own"], F.lit("->"), v["s"])),
        )
        s = F.when(v["s"] == "", v["own"]).otherwise(v["s"])
        changed = F.struct(F.when((v["own"] == "percent") & (s == "percent"), F.concat(v["n"], F.lit("%"))).otherwise(v["n"]).alias("answer"), s.alias("scale"), F.array_sort(F.array_compact(made)).alias("changes"))
        return F.when(v["n"] != "", changed).otherwise(F.struct(answer.alias("answer"), v["s"].alias("scale"), F.array().cast("array<string>").alias("changes")))

    return let(parts, read)


def answer_of_json(x: Column) -> Column:
    """struct<answer, error> of a model's JSON reply: fences go, the object with an ``answer`` may stand among other text.

    error: no_json, json_not_object, no_answer or parse_error. Values that are no strings come as JSON text.
    """
    clean = F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")

    def read(c: Column) -> Column:
        loose = F.filter(F.regexp_extract_all(c, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0)), lambda o: F.get_json_object(o, "$.answer").isNotNull())
        bare = F.regexp_extract(c, r"(?s)^\s*\{\s*\"answer\"\s*:\s*(.*?)\s*\}\s*$", 1)
        found = F.coalesce(F.get_json_object(c, "$.answer"), F.get_json_object(F.get(loose, F.lit(0)), "$.answer"), F.nullif(F.trim(F.trim(bare, F.lit("\"'"))), F.lit("")))
        whole = F.try_parse_json(c).isNotNull()
        error = F.when(found.isNotNull(), None).when(~c.contains("{"), F.when(whole, "json_not_object").otherwise("no_json")).when(whole, "no_answer").otherwise("parse_error")
        return F.struct(found.alias("answer"), error.alias("error"))

    return let(clean, read)


def allowed(answer: Column, values: list[str]) -> Column:
    return F.coalesce(F.lower(F.trim(answer)).isin(*(v.lower() for v in values)), F.lit(False))


def prediction(x: Column) -> Column:
    """struct<answers, scale, program> of a prediction entry in JSON: a pair [answer, scale], an object with answer (or prediction), scale and program, or a plain value. Answers are a list of strings."""
    g = lambda path: F.get_json_object(x, path)
    text = F.trim(x)
    many = lambda v: F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<string>"))
    pair = text.startswith("[") & (F.coalesce(F.json_array_length(text), F.lit(0)) == 2)
    value = F.when(pair, g("$[0]")).when(text.startswith("{"), F.coalesce(g("$.answer.answer"), g("$.answer"), g("$.prediction"))).otherwise(F.coalesce(g("$"), text))
    return F.struct(many(value).alias("answers"), F.coalesce(F.when(pair, g("$[1]")).when(text.startswith("{"), F.coalesce(g("$.answer.scale"), g("$.scale"))), F.lit("")).alias("scale"), F.when(text.startswith("{"), g("$.program")).alias("program"))


def entity_template(x: Column, entities: Column, years_first: bool = True) -> Column:
    """``question_template`` with every one of the row's entity words (an array, longest first) as ``<entity>``."""
    plain = F.aggregate(F.array_sort(entities, lambda a, b: F.length(b) - F.length(a)), x, lambda t, e: F.when(F.length(e) > 0, F.regexp_replace(t, F.concat(F.lit(r"(?i)\b\Q"), e, F.lit(r"\E\b")), F.lit("<entity>"))).otherwise(t))
    return question_template(plain, years_first)
