"""Sentences on bridges from a generator outside, with the measured ones to fall back on.

The generator is any function that takes a list of prompts and gives an answer, or an exception, for each, in order; it is
called in batches inside Spark's tasks, each prompt at most ``tries`` times. An answer that isn't JSON with a ``why`` and an
``angle``, a raised error or a missing answer costs that row its generated text, nothing else: what it keeps is the measured
text, and why is said in ``error``. Without a generator nothing is called. Labels and texts pass the redactor before they
leave, and answers before they come in.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship
from . import graph

Generator = Callable[[list[str]], Sequence[str | BaseException]]

TRIES, WAIT_SECONDS, BATCH = 3, 0.5, 16
# How much of a concept's text is shown, and how long answers may be.
SHOWN, MOST_WHY, MOST_ANGLE = 200, 240, 200


def prompts(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cards(i, j, li, lj)`` with a ``prompt`` on both ends, whose texts ``nodes(i, text)`` has."""
    shown = lambda name: T.redact_secrets(F.left(F.coalesce(name, F.lit("")), F.lit(SHOWN)))
    a, b = nodes.select("i", F.col("text").alias("_a")), nodes.select(F.col("i").alias("j"), F.col("text").alias("_b"))
    both = cards.join(a, "i", "left").join(b, "j", "left")
    said = F.concat(
        F.lit("Two notes are linked although no neighbours join them.\nFirst: "), T.redact_secrets(F.coalesce("li", F.lit(""))), F.lit(": "), shown(F.col("_a")),
        F.lit("\nSecond: "), T.redact_secrets(F.coalesce("lj", F.lit(""))), F.lit(": "), shown(F.col("_b")),
        F.lit('\nSay in one sentence why the link matters, and ask one short question it raises. Answer as JSON: {"why": "...", "angle": "..."}'),
    )
    return both.withColumn("prompt", said).drop("_a", "_b")


def parsed(answer: object) -> tuple[str, str]:
    """``why`` and ``angle`` of an answer; raises where there are none."""
    if isinstance(answer, BaseException):
        raise answer
    data = json.loads(answer)
    if not isinstance(data, dict):
        raise ValueError("the answer is no JSON object")
    return str(data.get("why") or ""), str(data.get("angle") or "")


def ask(call: Generator, texts: list[str], tries: int, wait: float) -> list[tuple[str | None, str | None, str | None]]:
    """(why, angle, error) for each prompt; those that failed are asked again, together."""
    out: list[tuple[str | None, str | None, str | None]] = [(None, None, "not asked")] * len(texts)
    left = list(range(len(texts)))
    for turn in range(tries):
        if turn:
            time.sleep(wait * 2 ** (turn - 1))
        try:
            answers: list[object] = list(call([texts[k] for k in left]))
        except Exception as error:  # noqa: BLE001  whatever a generator raises is that batch's error
            answers = [error] * len(left)
        answers += [ValueError("no answer")] * (len(left) - len(answers))
        for k, answer in zip(left, answers, strict=False):
            try:
                out[k] = (*parsed(answer), None)
            except Exception as error:  # noqa: BLE001
                out[k] = (None, None, f"{type(error).__name__}: {error}"[:200])
        left = [k for k in left if out[k][2] is not None]
        if not left:
            break
    return out


def described(bridges: DataFrame, nodes: DataFrame, call: Generator | None = None, tries: int = TRIES, wait: float = WAIT_SECONDS, at_once: int = BATCH) -> DataFrame:
    """``graph.cards`` of ``bridges`` with generated (boolean) and error; why and angle are the generator's where it gave any."""
    cards = graph.cards(bridges)
    if call is None:
        return cards.withColumn("generated", F.lit(False)).withColumn("error", F.lit(None).cast("string"))
    ship(bridges.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), at_once):
                part = frame.iloc[lo : lo + at_once]
                got = ask(call, part["prompt"].tolist(), tries, wait)
                yield pd.DataFrame({"i": part["i"].to_numpy(), "j": part["j"].to_numpy(), "_why": [g[0] for g in got], "_angle": [g[1] for g in got], "error": [g[2] for g in got]})

    told = prompts(cards, nodes).select("i", "j", "prompt").mapInPandas(run, "i long, j long, _why string, _angle string, error string")
    clean = lambda name, most: F.nullif(T.trim_to(T.redact_secrets(F.col(name)), most), F.lit(""))
    told = told.select("i", "j", clean("_why", MOST_WHY).alias("_why"), clean("_angle", MOST_ANGLE).alias("_angle"), "error")
    both = cards.join(told, ["i", "j"], "left")
    some = F.col("_why").isNotNull() | F.col("_angle").isNotNull()
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("why", "angle") else F.col(c) for c in cards.columns], some.alias("generated"), "error")
