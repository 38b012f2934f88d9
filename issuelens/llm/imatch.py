"""I-Match fingerprints with randomised lexicon subsets.

1. ``lexicon``: terms (lower-cased words, as hashes) whose inverse document frequency lies
   in a band, ln(N / df) from ``LOW`` to ``HIGH``. A term needs N / exp(HIGH) documents,
   so the lexicon has at most (mean distinct terms of a document) * exp(HIGH) terms,
   however large the corpus: that bounds what is sent to the tasks.
2. A text keeps its distinct lexicon terms, sorted (a text with none keeps all its terms).
3. ``FAMILIES`` seeded hashes each give nested random subsets of the lexicon, every one
   half of the one before. The kept terms in a subset are hashed to 12 bits. The
   fingerprint lists the subsets' hashes as hexadecimal digits, - for a subset without terms.

Two fingerprints are compared, per family, at the sparsest subset that holds a term of
either: likeness is the share of families that agree there.

Defined results: a null text is empty; equal texts have equal fingerprints; two texts
without words are alike (1), a text with and one without are not (0); empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, tasks, text_of, words_of

LOW, HIGH = math.log(4), math.log(2000)
FAMILIES, LEVELS, DIGITS = 16, 12, 3
SLICE = 1 << 17  # terms of the texts worked on at once
EMPTY = "-" * DIGITS


def term_hashes(text: Column) -> Column:
    """A hash of every word of a non-null text, in order, repeats included."""
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text: str = "text") -> np.ndarray:
    """Sorted term hashes of the band, from counts over all documents."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(term_hashes(text_of(text)))).alias("term"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    band = terms.groupBy("term").agg(F.count("*").alias("df")).filter((idf >= low) & (idf <= high))
    return np.sort(np.array([r.term for r in band.select("term").collect()], np.int64))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % 2 ** 64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _prints(terms: list[np.ndarray], band: np.ndarray) -> list[str]:
    """Fingerprints of texts given as arrays of term hashes."""
    n = len(terms)
    if not n:
        return []
    of = np.repeat(np.arange(n), [len(t) for t in terms])
    known, term = np.unique(np.concatenate(terms), return_inverse=True)  # what depends on a term alone is worked out once
    if not len(known):
        return [EMPTY * FAMILIES * LEVELS] * n
    if len(band):
        at = np.minimum(np.searchsorted(band, known), len(band) - 1)
        inside = (band[at] == known)[term]
    else:
        inside = np.zeros(len(term), bool)
    keep = inside | (np.bincount(of[inside], minlength=n) == 0)[of]
    pairs = np.sort(of[keep] * len(known) + term[keep])  # each text's terms, sorted
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    of, term = np.divmod(pairs[first], len(known))
    codes = np.full((n, FAMILIES, LEVELS), 16 ** DIGITS, np.int64)
    with np.errstate(over="ignore"):
        for f in range(FAMILIES):
            draw = _mixed(known, f + 1)
            # A term is in the subsets up to its draw's number of trailing zero bits.
            deepest = np.minimum(np.bitwise_count((draw & -draw) - np.uint64(1)), LEVELS - 1).astype(np.int64)
            cell = of * LEVELS + deepest[term]
            sums = np.zeros(n * LEVELS, np.uint64)
            np.add.at(sums, cell, _mixed(draw, 77)[term])
            some = np.bincount(cell, minlength=n * LEVELS).reshape(n, LEVELS)
            some = np.cumsum(some[:, ::-1], axis=1)[:, ::-1] > 0
            sums = np.cumsum(sums.reshape(n, LEVELS)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            for level in range(LEVELS):
                code = (_mixed(sums[:, level], level) >> np.uint64(64 - 4 * DIGITS)).astype(np.int64)
                codes[:, f, level] = np.where(some[:, level], code, 16 ** DIGITS)
    names = np.array([f"{k:0{DIGITS}x}" for k in range(16 ** DIGITS)] + [EMPTY], f"S{DIGITS}")
    digits, width = names[codes.reshape(n, -1)].tobytes().decode(), FAMILIES * LEVELS * DIGITS
    return [digits[k:k + width] for k in range(0, n * width, width)]


def fingerprint(terms: Column, band: np.ndarray) -> Column:
    """Fingerprint of an array of term hashes."""

    @F.pandas_udf("string")
    def of(hashes: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for h in hashes:
            held.append(np.asarray(h, np.int64))
            size += len(h)
            if size >= SLICE:
                out += _prints(held, band)
                held, size = [], 0
        return pd.Series(out + _prints(held, band))

    return of(terms)


def likeness(one: Column, other: Column) -> Column:
    """Share of families whose sparsest subset with a term of either text has the same hash in both."""
    width = LEVELS * DIGITS

    def digits(texts: pd.Series) -> np.ndarray:
        return np.array([t.encode() for t in texts], f"S{FAMILIES * width}").view(f"S{DIGITS}").reshape(-1, LEVELS)

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = digits(a), digits(b)
        some = (x != EMPTY.encode()) | (y != EMPTY.encode())
        deepest = LEVELS - 1 - some[:, ::-1].argmax(axis=1)
        rows = np.arange(len(x))
        return pd.Series((x[rows, deepest] == y[rows, deepest]).reshape(-1, FAMILIES).mean(axis=1))

    return of(one, other)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fingerprint of every document."""
    row = F.col("row")
    band = lexicon(docs, low, high, text)
    return keep_row(docs).select(row[id].alias("id"), fingerprint(term_hashes(text_of(row[text])), band).alias("fingerprint"))


def edited_neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, kind, place, id, text, next_text, own: every document beside the next by id (after the last: the first).

    Texts are shuffled once, by ranges of ids; the first document of a range is also sent
    to the range before (own is false, kind over 0 there). Ids are integers. Within equal ids rows stand by a hash of
    their texts; null ids stand first.
    """
    row = F.col("row")
    rows = keep_row(docs).select(row[id].alias("id"), text_of(row[text]).alias("text"))
    place = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.xxhash64("text").alias("h1"),
                     F.xxhash64(F.lit("h2"), "text").alias("h2")).alias("place")
    parts = 4 * tasks(docs.sparkSession)
    cuts = docs.select(F.col(id).alias("id")).filter("id is not null").agg(F.percentile_approx(
        "id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 100 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))

    @F.pandas_udf("int")
    def reached(ids: pd.Series) -> pd.Series:  # how many of the cuts an id reaches
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(), side="right").astype(np.int32))

    bucket = F.when(F.col("id").isNull(), 0).otherwise(reached(F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")))).alias("bucket")
    firsts = rows.select(bucket, place).groupBy("bucket").agg(F.min("place").alias("first")).orderBy("bucket").collect()  # one a range
    schema = rows.select(place).schema["place"].dataType.simpleString()
    before = [(r["first"], firsts[k - 1]["bucket"], k == 0) for k, r in enumerate(firsts)]
    extra = docs.sparkSession.createDataFrame(before, f"first {schema}, to int, wraps boolean")
    placed = rows.select("id", "text", place, bucket)
    tails = (placed.join(F.broadcast(extra), F.col("place").eqNullSafe(F.col("first")))
             .select("id", "text", "place", F.col("to").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("kind")))
    both = placed.withColumn("kind", F.lit(0)).unionByName(tails).repartition(parts, "bucket")
    # Copies that stand for the next range's first come last in their own range.
    w = W.partitionBy("bucket").orderBy("kind", "place")
    return both.withColumns({"next_text": F.lead("text").over(w), "own": F.col("kind") == 0})


def edit_report(docs: DataFrame, low: float = LOW, high: float = HIGH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """How fingerprints bear an edit: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of characters replaced by the first ones of the
    next document.
    """
    band = lexicon(docs, low, high, text)
    beside = edited_neighbours(docs, id, text)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(text_of("next_text"), F.lit(1), cut))
    # The next document's fingerprint is made anew here: a second exchange of fingerprints would cost more.
    done = beside.filter("own").withColumns({"n_chars": n.cast("long"), "edited": edited}).withColumns({
        "edited_sha256": F.sha2("edited", 256),
        "fingerprint": fingerprint(term_hashes(F.col("text")), band),
        "edited_fingerprint": fingerprint(term_hashes(F.col("edited")), band),
        "next_fingerprint": fingerprint(term_hashes(text_of("next_text")), band)})
    return done.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
