"""Completions that are asked for once (UDF-02, JOB-04).

A store of ``snapshot.py`` holds one row for each attempt at a prompt: the prompt's key (a
SHA-256 of model name, system prompt, token limit and prompt), the output or the error.
``complete`` sends each distinct prompt without an output to the generator, commits what
comes back in one step, and answers all prompts from the store. A run that dies before its
commit is repeated as a whole; a later run asks only for what is new or had failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import snapshot as sn
from .generate import SCORE_SCHEMA, score


def prompt_key(prompt: Column, model: str, system_prompt: str | None, max_new_tokens: int) -> Column:
    """The same for equal requests only: every part goes in with its length."""
    parts = [F.lit(model), F.lit(system_prompt or ""), F.lit(str(max_new_tokens)), F.coalesce(prompt, F.lit(""))]
    return F.sha2(F.concat(*[x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)]), 256)


def answers(store: DataFrame) -> DataFrame:
    """(prompt_key, llm_output, error): the output of a prompt, else the error of its last attempt."""
    last = F.max_by(F.struct("llm_output", "error"), F.struct(F.col("llm_output").isNotNull(), "attempt"))
    return store.groupBy("prompt_key").agg(last.alias("a")).select("prompt_key", "a.llm_output", "a.error")


def complete(prompts: DataFrame, root: str, generator, model: str | None = None, system_prompt: str | None = None,
             max_new_tokens: int = 512) -> DataFrame:
    """(query_id, prompt) -> (query_id, llm_output, error), through the store at ``root``.

    ``model`` names what answers (the generator's class by default): another name asks anew.
    """
    spark = prompts.sparkSession
    name = model or type(generator).__name__
    keyed = prompts.select("query_id", "prompt", prompt_key(F.col("prompt"), name, system_prompt, max_new_tokens).alias("prompt_key"))
    held = sn.latest(spark, root)
    new = keyed.select(F.col("prompt_key").alias("query_id"), "prompt").dropDuplicates(["query_id"])
    if sn.MAIN in held.schemas:
        answered = sn.read(spark, root, snapshot=held).where(F.col("llm_output").isNotNull())
        new = new.join(answered.select(F.col("prompt_key").alias("query_id")), "query_id", "left_anti")
    asked = score(new, generator, system_prompt, max_new_tokens).withColumnRenamed("query_id", "prompt_key")
    held = sn.commit(spark, root, {sn.MAIN: asked.withColumn("attempt", F.lit(held.version + 1))}, base=held)
    found = answers(sn.read(spark, root, snapshot=held))
    return keyed.join(found, "prompt_key", "left").select(*[c.split()[0] for c in SCORE_SCHEMA.split(", ")])
