"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is weight * total / size. Each document gets a uniform
number from a seeded hash of its id and inverts the Poisson distribution of that rate:
the count is a function of seed and document alone, so a recomputed task gives the same
copies. Rates over ``STEP`` are cut into equal parts of at most ``STEP`` with a hash each
(a sum of independent Poisson counts is Poisson), so no row explodes by more than some
dozens at once and no rate underflows. The copies are ordered by another seeded hash.

The table of sources is written out and joined as the planner sees fit: a broadcast
below its size threshold, beyond it a join whose hot keys adaptive execution splits.

Defined results: a null source is a source of its own; a null id is replaced by a hash
of the text; rows with equal ids get equal counts; a null text has size 1 like the empty
one; sources absent from ``weights`` have weight 0 there; empty tables give empty results;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, text_of

STEP = 16.0  # largest rate inverted at once
SEED = 20


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def uniform(key: Column, seed: int, stratum: Column) -> Column:
    """In [0, 1), with 52 bits of the MD5 of seed, key and stratum."""
    return F.conv(F.substring(_hash(F.lit(str(seed)), key, stratum.cast("string")), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def poisson(u: Column, rate: Column) -> Column:
    """The smallest n with u < P(X <= n), X Poisson of ``rate`` (at most ``STEP``)."""
    p0 = F.exp(-rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")  # P(X > last) < 2 ** -52
    state = lambda n, p, c: F.struct(n.cast("int").alias("n"), p.alias("p"), c.alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return state(s["n"] + F.when(u >= s["c"], 1).otherwise(0), p, s["c"] + p)

    return F.aggregate(F.sequence(F.lit(1), last), state(F.lit(0), p0, p0), step, lambda s: s["n"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, epochs: float = 1.0,
          source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): by given weights, or by size ** power; the total is ``epochs`` times the size of all."""
    size = F.octet_length(text_of(text)) + 1
    sized = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        sized = sized.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        sized = (sized.alias("a").join(F.broadcast(given).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
                 .select("a.source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    all_ = sized.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    rate = F.col("weight") / F.col("weights") * F.col("total") * epochs / F.col("size")
    return sized.crossJoin(F.broadcast(all_)).select("source", F.round(rate, 9).alias("rate"))  # one row beside each


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, epochs: float = 1.0,
              seed: int = SEED, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``row``, ``copy`` and ``order_key`` of every copy, shuffled globally: in the order of order_key."""
    table = land(rates(docs, weights, power, epochs, source, text), "rates")
    table = table.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk"), "rate").filter("rate > 0")
    rows = keep_row(docs).withColumns({
        "sk": F.coalesce(F.concat(F.lit("s"), F.col("row")[source]), F.lit("n")),
        "key": F.coalesce(F.col("row")[id].cast("string"), F.concat(F.lit("t"), F.md5(text_of(F.col("row")[text]))))})
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("long")
    part = rows.join(table, "sk").withColumns({"parts": parts}).withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), "parts")))
    count = poisson(uniform(F.col("key"), seed, F.col("part")), F.col("rate") / F.col("parts"))
    copies = (part.withColumn("n", count).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
              .withColumn("copy", (F.col("part") - 1) * 256 + F.col("k")))  # n is below 256 for a rate of STEP
    order = _hash(F.lit(f"{seed} order"), F.col("key"), F.col("copy").cast("string"))
    return copies.select("row", "copy", order.alias("order_key")).orderBy("order_key")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The copies with the columns of ``docs``, in shuffled order."""
    return replicate(docs, **settings).select("row.*")
