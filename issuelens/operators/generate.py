"""Prompt -> completion through a pluggable generator (UDF-02), label extraction.

A generator is a picklable object with
``generate(prompt, max_new_tokens=512, system_prompt=None) -> str``. It is built
on the driver (an unknown back end fails there, before any task runs), shipped
with the task, and called once per prompt inside ``mapInPandas``; a model can be
loaded lazily on first use so it is loaded once per task. Errors are kept per
row: ``llm_output`` is null and ``error`` holds the message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import extract_issuetype
from ..plans.inspect import spread

SCORE_SCHEMA = "query_id string, llm_output string, error string"


class NearestLabelGenerator:
    """Deterministic stand-in for a model: answers with the first neighbour's type.

    It reads the prompt like a model would and replies in the requested output
    format, so every downstream step (extraction, scoring) is exercised.
    """

    _pat = re.compile(r"^Original Issue Type: (.*)$", re.M)

    def generate(self, prompt: str, max_new_tokens: int = 512, system_prompt: str | None = None) -> str:
        m = self._pat.search(prompt or "")
        if not m:
            return "Reasoning: no similar tickets were given."
        return f"Issuetype: {m.group(1)}\nReasoning: most similar historical ticket."


class CallableGenerator:
    """Wrap a plain function ``f(prompt) -> str``."""

    def __init__(self, fn: Callable[[str], str]):
        self.fn = fn

    def generate(self, prompt: str, max_new_tokens: int = 512, system_prompt: str | None = None) -> str:
        return self.fn(prompt)


def make_generator(backend: str = "nearest", **kwargs):
    """Build a generator on the driver; an unknown back end raises here."""
    if backend == "nearest":
        return NearestLabelGenerator()
    if backend == "callable":
        return CallableGenerator(kwargs["fn"])
    raise ValueError(f"Unknown backend: {backend}")


def score(prompts: DataFrame, generator, system_prompt: str | None = None,
          max_new_tokens: int = 512, prompt_col: str = "prompt") -> DataFrame:
    """(query_id, prompt) -> (query_id, llm_output, error)."""
    gen = generator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            outs, errs = [], []
            for p in pdf[prompt_col].tolist():
                try:
                    o = gen.generate(p, max_new_tokens=max_new_tokens, system_prompt=system_prompt)
                    outs.append(None if o is None else str(o))
                    errs.append(None if o is not None else "generator returned None")
                except Exception as e:  # per-row failure, the job goes on
                    outs.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"query_id": pdf["query_id"].astype(str), "llm_output": outs,
                                "error": errs})

    return spread(prompts.select("query_id", prompt_col)).mapInPandas(run, SCORE_SCHEMA)


def predict(scored: DataFrame) -> DataFrame:
    """SCL-01 + SCL-03: predicted label; failures get the sentinels."""
    failed = F.col("llm_output").isNull()
    return scored.select(
        "query_id",
        F.when(failed, F.lit(K.PREDICTED_ON_FAILURE)).otherwise(extract_issuetype("llm_output"))
        .alias("predicted"),
        F.coalesce(F.col("llm_output"), F.lit(K.OUTPUT_ON_FAILURE)).alias("llm_output"),
        failed.alias("failed"),
    )
