"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.session import scratch_path
from issuelens.sources.files import remove

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(condition: Column) -> Column:
    """The condition as a column that the optimizer does not move.

    A filter on a computed column is else pushed below the projection that computes it,
    which then evaluates the whole computation twice, and inside lambdas once an element.
    Filters are not moved below what depends on the partition; the test itself always holds.
    """
    return condition & (F.spark_partition_id() >= 0)


def text_of(column: Column | str) -> Column:
    """The text, the empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text, in order, repeats included; none gives an empty array.

    Splitting at one plain character is several times faster than at a pattern, so the
    other blanks become spaces first and the empty pieces between two blanks are removed.
    """
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    spaced = F.when(lines.rlike(r"[\x09-\x0D]"), F.regexp_replace(lines, r"[\x09-\x0D]", " ")).otherwise(lines)
    return F.array_remove(F.split(spaced, " ", -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_row(docs: DataFrame) -> DataFrame:
    """All input columns as one struct ``row``, so that working columns can clash with none of them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def row_hashes(docs: DataFrame) -> list[Column]:
    """h1, h2: 128 bits that are equal for rows equal in every column (of ``keep_row``); maps are left out."""
    fields = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    return [F.xxhash64(*fields).alias("h1"), F.xxhash64(F.lit("h2"), *fields[::-1]).alias("h2")]


def land(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unland(df: DataFrame) -> None:
    """Delete a table of ``land`` that nothing will read again, by the folder of its first file."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_process(name: str, make: Callable[[], object]) -> object:
    """One object for each Python worker process, shared by the tasks that run in it.

    Functions of this package reach the workers by value, so their module globals
    are new in every task; a module entry lives as long as the process.
    """
    home = sys.modules.setdefault("_issuelens_llm_process", types.ModuleType("_issuelens_llm_process"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
