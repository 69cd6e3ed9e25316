"""Runs of injected calls (models, services) over pending work: retries, dead letters, rounds of regeneration."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_of_json
from ..shipping import ship

#: A call takes a prompt and the number of the attempt (0 first) and returns a text; it raises when it fails.
Call = Callable[[str, int], str]


def called(pending: DataFrame, key: str, prompt: str, call: Call, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """(key, response, attempts, error): every pending prompt called until it answers, at most ``attempts`` times.

    The wait before attempt k is k times ``pause`` seconds. A failure is a row with an error, never an
    exception, so what else the task holds goes on. Tasks work side by side; a lost task's prompts are
    called again, so results should be kept by key (``resumed``).
    """
    ship(pending.sparkSession)
    rows = pending.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["key"], b["prompt"], strict=True):
                response, error, n = None, None, 0
                while n < attempts and response is None:
                    if n and pause:
                        time.sleep(pause * n)
                    n += 1
                    try:
                        response, error = call(text, n - 1), None
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                out.append((k, response, n, error))
            yield pd.DataFrame(out, columns=["key", "response", "attempts", "error"])

    return rows.mapInPandas(run, "key string, response string, attempts int, error string").withColumnRenamed("key", key)


def resumed(work: DataFrame, done: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """Work whose key is not done yet; with ``dry_run`` a miss fails the query instead of being called."""
    left = work.join(done.select(F.col(key).cast("string").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")
    return left if not dry_run else left.where(F.raise_error(F.concat(F.lit("not in the cache: "), F.col(key).cast("string"))).isNull())


def dead_letters(results: DataFrame) -> DataFrame:
    return results.where("error is not null")


def parsed(pending: DataFrame, key: str, prompt: str, call: Call, parse: Callable[[Column], Column] = answer_of_json, rounds: int = 2, attempts: int = 1) -> DataFrame:
    """(key, answer, error, round): calls whose reply does not parse are called again, ``rounds`` times at most; the last error stays.

    ``call`` sees the round as its attempt. Every round is written down by Spark's checkpoint, as calls must not run twice.
    """
    spark, left, out = pending.sparkSession, pending, None
    for r in range(rounds):
        again = lambda text, n, r=r: call(text, r * attempts + n)
        got = called(left, key, prompt, again, attempts)
        if spark.sparkContext.getCheckpointDir():
            got = got.checkpoint()
        got = got.withColumn("p", parse(F.col("response")))
        got = got.select(key, F.col("p.answer").alias("answer"), F.coalesce("error", "p.error").alias("error"), F.lit(r).alias("round"))
        last = r == rounds - 1
        kept = got if last else got.where("error is null")
        out = kept if out is None else out.unionByName(kept)
        if not last:
            left = left.join(got.where("error is not null").select(F.col(key).alias("_left")), F.col(key).cast("string") == F.col("_left"), "left_semi")
    return out


def arm_prompts(targets: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """(target_id, arm, prompt): one prompt for each target and arm; an arm's prompt is built from the target's columns."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), p.alias("prompt")) for a, p in arms.items())))
    return targets.select("target_id", each.alias("e")).select("target_id", "e.*")


def run_arms(targets: DataFrame, arms: dict[str, Column], call: Call, gold: str, attempts: int = 2) -> DataFrame:
    """(target_id, arm, answer, error, correct): sample, prompt, call and record for every arm at once."""
    p = arm_prompts(targets, arms).withColumn("id", F.concat_ws("|", F.col("target_id").cast("string"), "arm"))
    got = called(p, "id", "prompt", call, attempts)
    j = p.join(got, "id").join(targets.select("target_id", F.col(gold).cast("string").alias("_gold")), "target_id")
    a = answer_of_json(F.col("response"))
    return j.select("target_id", "arm", a["answer"].alias("answer"), F.coalesce("error", a["error"]).alias("error"), F.coalesce(a["answer"] == F.col("_gold"), F.lit(False)).alias("correct"))


def regenerated(pending: DataFrame, key: str, prompt: str, call: Call, faults: Callable[[Column], Column], rounds: int = 3) -> DataFrame:
    """(key, text, faults, round): texts generated, checked and generated anew with a stricter prompt until they pass; what never passes comes back with its faults.

    ``faults`` gives an array of issues; they are added to the next round's prompt.
    """
    left, out = pending.select(F.col(key).cast("string").alias(key), F.col(prompt).alias("prompt")), None
    for r in range(rounds):
        again = lambda text, n, r=r: call(text, r)
        got = called(left, key, "prompt", again, 1)
        if pending.sparkSession.sparkContext.getCheckpointDir():
            got = got.checkpoint()
        got = got.withColumn("f", F.coalesce(faults(F.col("response")), F.array(F.lit("no_text"))))
        row = got.select(key, F.col("response").alias("text"), F.col("f").alias("faults"), F.lit(r).alias("round"))
        last = r == rounds - 1
        kept = row if last else row.where(F.size("faults") == 0)
        out = kept if out is None else out.unionByName(kept)
        if not last:
            bad = row.where(F.size("faults") > 0).select(key, "faults")
            left = left.join(bad, key).select(key, F.concat("prompt", F.lit("\nAvoid: "), F.array_join("faults", ", ")).alias("prompt"))
    return out
