"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics``: a projection of built-in functions, without shuffle, over whole texts;
2. ``fit``: a random forest of shallow trees on labelled rows; every path from a root to a
   node, inner ones too, is a rule, a conjunction of thresholds; a logistic regression
   with L1 penalty (lasso) weighs the rules and leaves most at zero;
3. ``score``: the rules with a weight compiled into one Spark column expression.

The fit takes at most ``SAMPLE`` labelled rows: those whose id hashes lowest, in one file
read in one order, so the same tables give the same rules whatever the partitions. Every
document is measured and scored.

Only the statistics enter a score, never an id, label, language or source.

Defined results: a null text counts as empty; texts without words have all statistics 0
and a score like any other; repeated rows are scored one by one; a label that is not 0 or
1, or whose id is null or in no document, is not used; of several documents under one
labelled id the one of smallest statistics stands for them in the fit, a document
labelled both ways counts both ways. With labels of one kind or none the score is
(ones + 1) / (labels + 2) for all. Empty tables give empty results. Other columns are
kept in ``row``, whatever their names.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, settled, text_of, words_of
from issuelens.llm.quality import STOP_WORDS

SAMPLE = 8192  # labelled rows of a fit, at most
TREES, DEPTH, BINS = 24, 3, 64
PENALTY = 0.002
PASSES = 200  # of the regression, at most
KEEP_AT = 0.7
SEED = 11

STATISTICS = ("n_words", "chars_per_word", "distinct_words", "same_as_before", "upper_chars", "symbols", "bangs", "bars",
              "full_stops", "commas", "digits", "stop_words", "letter_chars", "words_per_line", "repeated_lines")


class Condition(NamedTuple):
    statistic: str
    above: bool
    threshold: float


class Ensemble(NamedTuple):
    """rules: (conditions that must all hold, weight)."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns) and ``s``, a struct of ``STATISTICS`` (double)."""
    base = keep_row(docs).withColumn("t", text_of(F.col("row")[text]))
    split = base.withColumns({
        "words": words_of(F.col("t")),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "chars": F.char_length("t"),
    })
    n, w = F.greatest(F.size("words"), F.lit(1)), F.col("words")
    without = lambda c: F.col("chars") - F.char_length(F.replace("t", F.lit(c), F.lit("")))
    only = lambda pattern: F.char_length(F.regexp_replace("t", pattern, ""))
    adjacent = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    value = {
        "n_words": F.size(w),
        "chars_per_word": F.char_length(F.concat_ws("", w)) / n,
        "distinct_words": F.size(F.array_distinct(w)) / n,
        "same_as_before": F.size(F.array_remove(adjacent, False)) / n,
        "upper_chars": only(r"[^\p{Lu}]+") / F.greatest("chars", F.lit(1)),
        "symbols": F.when(F.col("t").rlike("[#*$%&<>]"), only("[^#*$%&<>]+")).otherwise(0) / n,
        "bangs": without("!") / n,
        "bars": without("|") / n,
        "full_stops": without(".") / n,
        "commas": without(",") / n,
        "digits": F.when(F.col("t").rlike("[0-9]"), only("[^0-9]+")).otherwise(0) / n,
        "stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))) / n,
        "letter_chars": only(r"[^\p{L}]+") / F.greatest("chars", F.lit(1)),
        "words_per_line": F.size(w) / F.greatest(F.size("lines"), F.lit(1)),
        "repeated_lines": (F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1)),
    }
    return split.select("row", F.struct(*[value[k].cast("double").alias(k) for k in STATISTICS]).alias("s"))


def training_rows(measured: DataFrame, labels: DataFrame, key: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """``s`` and ``label`` (double) of at most ``sample`` labelled ids, in one file and a fixed order.

    ``measured`` has ``id`` and ``s``.
    """
    used = (labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label"))
            .filter(F.col("id").isNotNull() & F.col("label").isin(0.0, 1.0)).distinct())
    drawn = used.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "label").limit(sample)
    # At most ``sample`` rows of two numbers: fit for a broadcast whatever the tables.
    known = measured.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("s").alias("s"))
    return land(known.repartition(1).sortWithinPartitions("id", "label"), "rules")


def conditions_of(debug: str) -> list[tuple[Condition, ...]]:
    """The path to every node but the roots, from the printed form of a forest."""
    paths, above = [], []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found is None:
            continue
        indent = len(found[1])
        while above and above[-1][0] >= indent:
            above.pop()
        above.append((indent, Condition(STATISTICS[int(found[2])], found[3] == ">", float(found[4]))))
        paths.append(simplified([c for _, c in above]))
    return sorted(set(paths))


def simplified(path: list[Condition]) -> tuple[Condition, ...]:
    """The tightest condition for each statistic and direction, in order of names."""
    held: dict[tuple[str, bool], float] = {}
    for statistic, above, threshold in path:
        tighter = max if above else min
        held[statistic, above] = tighter(held.get((statistic, above), threshold), threshold)
    return tuple(sorted(Condition(s, a, t) for (s, a), t in held.items()))


def holds(s: Column, rule: tuple[Condition, ...]) -> Column:
    """Whether all conditions of the rule hold for the statistics."""
    out = F.lit(True)
    for c in rule:
        out = out & (s[c.statistic] > F.lit(c.threshold) if c.above else s[c.statistic] <= F.lit(c.threshold))
    return out


def _fires(s: Column, rule: tuple[Condition, ...]) -> Column:
    return F.when(holds(s, rule), F.lit(1.0)).otherwise(F.lit(0.0))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Rules and weights from ``s`` and ``label`` of ``training_rows``."""
    s = F.col("s")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, total = counts.get(1.0, 0), sum(counts.values())
    if len(counts) < 2:
        return Ensemble(math.log((ones + 1) / (total - ones + 1)), [])
    vector = array_to_vector(F.array(*[s[k] for k in STATISTICS]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=BINS, seed=SEED, featureSubsetStrategy="0.4",
                                    subsamplingRate=0.7, minInstancesPerNode=max(2, min(20, total // 100)))
    found = forest.fit(rows.select(vector.alias("features"), "label"))
    paths = conditions_of(found.toDebugString)
    if not paths:
        return Ensemble(math.log((ones + 1) / (total - ones + 1)), [])
    fired = rows.select(array_to_vector(F.array(*[_fires(s, p) for p in paths])).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=PASSES).fit(fired)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), [(p, w) for p, w in zip(paths, weights) if w])


def score(s: Column, ensemble: Ensemble) -> Column:
    """Probability of label 1 as one expression over the statistics."""
    total = F.lit(ensemble.intercept)
    for rule, weight in ensemble.rules:
        total = total + F.when(holds(s, rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def verdict(scored: Column) -> Column:
    """1 if the score reaches ``KEEP_AT``, else 0."""
    return (scored >= KEEP_AT).cast("int")


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``s``, ``score`` and ``predicted`` of every document, fitted on ``labels`` (``key``, ``label``).

    Texts are read once; their statistics are written, and both the fit and the score read those.
    """
    measured = land(statistics(docs, text).select(F.col("row")[key].alias("id"), "s"), "statistics")
    ensemble = fit(training_rows(measured, labels, key, label))
    return measured.withColumn("score", score(F.col("s"), ensemble)).withColumn("predicted", verdict(F.col("score")))


def keep_good(docs: DataFrame, ensemble: Ensemble, text: str = "text") -> DataFrame:
    """The documents that the ensemble predicts good, with their columns as they are."""
    done = statistics(docs, text).select("row", settled(score(F.col("s"), ensemble) >= KEEP_AT).alias("good"))
    return done.filter("good").select("row.*")


def held_out(key: str) -> Column:
    """Whether a row is kept from the fit: crc32 of the key's decimal text is 2 modulo 4 (null keys are not)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
