"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` names a measure and the range it must lie in. ``measures`` adds every
measure with built-in functions, ``verdicts`` compiles a table into boolean columns.
There is no shuffle and no user function, a row's cost is linear in its text (sorting
happens only inside a text that repeats eight words).

Defined results: a null text counts as empty (no words, so the base rule fails); empty
tables give empty results; repeated rows are measured one by one; other columns of the
input are ignored, whatever their names. Texts of any length are measured whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import BLANK, keep_row, let, settled, text_of, words_of

WINDOW = 8  # words of a repetition window


class Rule(NamedTuple):
    name: str
    measure: str
    least: float | None
    most: float | None


#: A document is kept if every measure lies in its range (ends included).
RULES = (
    Rule("few_words", "n_words", 20, None),
    Rule("word_length", "chars_per_word", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_words_per_word", 0.02, None),
    Rule("letters", "letter_words_per_word", 0.7, None),
    Rule("repeated_words", "repeat_words_per_word", None, 0.3),
    Rule("repeated_lines", "dup_lines_per_line", None, 0.3),
    Rule("ellipsis_lines", "ellipsis_lines_per_line", None, 0.3),
    Rule("bullet_lines", "bullet_lines_per_line", None, 0.9),
)

#: Common function words of English, German, French and Spanish.
_STOP = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an they which you "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les de des et un une du en que qui dans pour sur au pas par il elle avec son ce "
    "el los las y del se con no su al lo como más pero sus o si sin sobre"
).split()
STOP_WORDS = sorted({form for word in _STOP for form in (word, word.capitalize())})
#: A word without a letter.
LETTERLESS = rf"(?:^|{BLANK})[^\p{{L}}\x20\x09-\x0D]+(?={BLANK}|$)"


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words inside eight-word windows that occur twice or more, the first occurrence included.

    Window hashes tell whether anything can repeat (equal windows have equal hashes);
    only then are the windows themselves sorted, so the count is exact. Covered words
    are summed over the sorted window starts: each start adds the words up to the next.
    """
    last = n_words - WINDOW
    # Hashes of 1, 2, 4, then 8 words; the last seven hash what is left of the text.
    joined = lambda h, by: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    hashed = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h1: let(joined(h1, 1), lambda h2: let(
        joined(h2, 2), lambda h4: joined(h4, 4))))

    def starts(sorted_windows: Column) -> Column:
        same = lambda i, k: F.get(sorted_windows, i)["w"] == F.get(sorted_windows, k)["w"]
        flags = F.transform(sorted_windows, lambda s, i: F.when(
            F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), s["i"]))
        return F.sort_array(F.filter(flags, lambda x: x.isNotNull()))

    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i")))
    covered = let(F.sort_array(windows), lambda s: let(starts(s), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)))
    repeated = let(hashed, lambda g: F.size(F.array_distinct(g)) < F.size(g))
    return F.when(last < 1, 0).when(~repeated, 0).otherwise(covered)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns) and ``m``, a struct of the counts and ratios of ``RULES``."""
    base = keep_row(docs).withColumn("t", text_of(F.col("row")[text]))
    split = base.withColumns({
        "words": words_of(F.col("t")),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    w, lines, n = F.col("words"), F.col("lines"), F.size("words")
    count = lambda keep, of: F.size(F.filter(of, keep))
    counted = split.withColumns({
        "n_words": n,
        "word_chars": F.char_length(F.concat_ws("", w)),
        "n_symbols": F.when(F.col("t").rlike("[#*$%&|<>]"), F.char_length(
            F.regexp_replace("t", "[^#*$%&|<>]+", ""))).otherwise(0),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(w, n),
        "n_stop": count(lambda x: x.isin(STOP_WORDS), w),
        "n_letter": n - F.regexp_count("t", F.lit(LETTERLESS)),
        "n_ellipsis": count(lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"), lines),
        "n_bullet": count(lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"), lines),
    })
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    long = lambda c: F.col(c).cast("long").alias(c)
    return counted.select("row", F.struct(
        *map(long, ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")),
        per("word_chars", "n_words").alias("chars_per_word"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_stop", "n_words").alias("stop_words_per_word"),
        per("n_letter", "n_words").alias("letter_words_per_word"),
        per("n_repeat_words", "n_words").alias("repeat_words_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_lines_per_line"),
        per("n_ellipsis", "n_lines").alias("ellipsis_lines_per_line"),
        per("n_bullet", "n_lines").alias("bullet_lines_per_line"),
    ).alias("m"))


def verdicts(m: Column, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """``base_failed``, ``failed`` (names of the broken rules, in table order) and ``kept``."""
    broken = []
    for r in rules:
        out = F.lit(False)
        if r.least is not None:
            out = out | (m[r.measure] < F.lit(r.least))
        if r.most is not None:
            out = out | (m[r.measure] > F.lit(r.most))
        broken.append((r.name, out))
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    ok = ~base
    for _, out in broken:
        ok = ok & ~out
    return {"base_failed": base, "failed": F.concat_ws(",", *[F.when(out, F.lit(name)) for name, out in broken]), "kept": ok}


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``row``, ``m`` and the verdict columns of ``rules`` for every document."""
    return measures(docs, text).withColumns(verdicts(F.col("m"), rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that every rule accepts, with their columns as they are."""
    return quality(docs, rules, text).select("row", settled(F.col("kept")).alias("kept")).filter("kept").select("row.*")
