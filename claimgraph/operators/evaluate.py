"""Evaluation of notices: a native screen, a pluggable evaluator that answers in text, and a native fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.relational import unused
from claimgraph.sources.readers import json_block

# Words of a binding duty, and what counts as a quantity.
DUTY = r"(?i)\b(rule|order|decree|enforce|duty|mandate|article|regulation|clause|transparency|watermark)\b"
QUANTITY = r"\b[0-9]+(\.[0-9]+)?%|\$[0-9]+"
FINDING = "struct<is_duty:boolean,duty_type:string,reference:string,quantity:boolean,denominator:string,priority:int>"


def priority(score: Column, base: Column) -> Column:
    """The evaluated score, 1 being the most urgent; the source's base where there is none or it is 0. Not the lesser of both: a source of base 1 would make all it says urgent."""
    return F.coalesce(F.nullif(score, F.lit(0)), base).cast("int")


class Evaluator(Protocol):
    """Whatever answers a prompt; sent to the executors, so it must pickle and open its own connections there."""

    def __call__(self, prompt: str) -> str: ...


def retried(call: Callable[[], str], tries: int = 2, wait: float = 5.0) -> str:
    """call(), tried again after any error; the last one is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if not left:
                raise
            time.sleep(wait)
    raise ValueError("tries must be 1 or more")


def finding(duty, kind, reference, quantity, denominator, priority) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(duty).alias("is_duty"), c(kind).alias("duty_type"), c(reference).cast("string").alias("reference"), c(quantity).alias("quantity"), c(denominator).alias("denominator"), c(priority).cast("int").alias("priority"))


def routine() -> Column:
    """What is found of an administrative notice, without asking anyone."""
    return finding(False, "none", None, False, "n/a", 5)


def heuristic(title: Column, summary: Column) -> Column:
    """The finding of a notice when no evaluator answers; null texts count as empty, and title and summary are read as one text without a space between."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    duty = F.concat(t, s).rlike(DUTY)
    return finding(duty, F.when(duty, "transparency").otherwise("none"), None, s.rlike(QUANTITY), "partial", F.when(duty, 2).otherwise(4))


def answers(df: DataFrame, prompt: str, evaluator: Evaluator, tries: int = 2, wait: float = 5.0) -> DataFrame:
    """``df`` with answer: what the evaluator says of each prompt; null where the prompt is null or each try failed."""
    schema = f"{df.drop('answer')._jdf.schema().toDDL()}, answer string"

    def ask(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return retried(lambda: evaluator(text), tries, wait)
        except Exception:  # noqa: BLE001 - one failed call must not end the job
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(answer=[ask(None if pd.isna(x) else x) for x in part[prompt]])

    return df.drop("answer").mapInPandas(run, schema)


def evaluated(df: DataFrame, title: str, summary: str, noise: Column, evaluator: Evaluator | None = None, tries: int = 2, wait: float = 5.0) -> DataFrame:
    """``df`` with finding: ``routine`` for noise, else what the evaluator's JSON says, else ``heuristic``.

    Without an evaluator all is native. With one, only rows that are no noise carry a prompt.
    """
    quiet = F.coalesce(noise, F.lit(False))
    fallback = heuristic(F.col(title), F.col(summary))
    if evaluator is None:
        return df.withColumn("finding", F.when(quiet, routine()).otherwise(fallback))
    prompt = F.when(~quiet, F.concat_ws("\n", F.lit("Evaluate this notice and answer with one JSON object."), F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Summary: "), F.coalesce(summary, F.lit("")))))
    name = unused("prompt", df)
    asked = answers(df.withColumn(name, prompt), name, evaluator, tries, wait)
    said = F.from_json(json_block(F.col("answer")), FINDING)
    return asked.withColumn("finding", F.when(F.col(name).isNull(), routine()).otherwise(F.coalesce(said, fallback))).drop(name, "answer")


def last_list(text: Column) -> Column:
    """The last JSON list with something in it of a model's answer, a thinking trace being passed over; else the span from the first bracket to the last if it is one; else null."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    is_list = lambda x: F.try_parse_json(x).isNotNull() & ~x.rlike(r"^\[\s*\]$")
    short = F.filter(F.regexp_extract_all(plain, F.lit(r"(?s)\[.*?\]"), 0), is_list)
    wide = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    return F.coalesce(F.try_element_at(short, F.lit(-1)), F.when((wide != "") & is_list(wide), wide))


def labels(text: Column) -> Column:
    """array<struct<i, denominator>> of a model's answer; entries without an index go."""
    return F.filter(F.from_json(last_list(text), "array<struct<i:int,denominator:string>>"), lambda x: x["i"].isNotNull())


def label_ladder(fetched: Column, n_spans: Column, n_based: Column, prompt_chars: Column, budget: int, answer: Column) -> Column:
    """struct<denominator, method, seen, total> of an item that no human labelled.

    Not fetched, or a prompt over the budget: unassessed, never judged from a sample. No figures, or all with a base:
    settled by rule. Else the model's answer Y or N; any other answer, and 'n/a' where there are figures, is none.
    """
    total = F.coalesce(n_spans, F.lit(0)).cast("int")
    out = lambda d, m, seen, of: F.struct(F.lit(d).alias("denominator") if isinstance(d, str) else d.alias("denominator"), F.lit(m).alias("method"), seen.alias("seen"), of.alias("total"))
    none = F.lit(0)
    return (
        F.when(~F.coalesce(fetched, F.lit(False)), out("?", "unassessed", none, none))
        .when(F.coalesce(prompt_chars, F.lit(0)) > budget, out("?", "unassessed", none, total))
        .when(total == 0, out("n/a", "rule", total, total))
        .when(n_based == total, out("Y", "rule", total, total))
        .when(answer.isin("Y", "N"), out(answer, "model", total, total))
        .otherwise(out("?", "unassessed", none, total))
    )
