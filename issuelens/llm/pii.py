"""Personal data: base spans by pattern, then terms that give protected entities away.

Everything is a DataFrame or SQL expression; no Python runs on the executors.

1. *Base spans.* Four kinds of values are found in whole texts. Positions come from the
   pieces between matches (``split``) and a prefix scan of their lengths.
2. *Information content.* A protected entity is one value (an address, a number). For an
   entity c and a term t (a run of letters, lower-cased) the corpus gives df(c), df(t)
   and df(c, t): the documents (copies counted) that hold c, t, or both, wherever in them.
   IC(c) = ln(N / df(c)) is what c's disclosure is worth, PMI(c; t) = ln(N df(c, t) /
   (df(c) df(t))) what t tells of it. Their ratio is 1 if t occurs only with c.
3. *Sanitising.* In documents that mention c, every occurrence of a term whose ratio
   reaches ``generalise_at`` becomes a general tag, from ``remove_at`` on nothing.
   A ratio counts if chance does not explain it: of all terms of the corpus, fewer than
   ``chance`` are to be expected in as many documents of c (Hoeffding's bound on the
   hypergeometric tail). A single document never decides; two do in a corpus large enough.

PMI is at most ln(N / df(t)), so terms of many documents drop out exactly, before they are
paired: pairs of entity and term are those whose df(t) alone lets the ratio suffice. And an entity
of df(c) documents can show at most df(c) ln(N / df(c)) against chance: where that is not enough, as
for most entities of one document, it is not paired at all.
Counts are partial sums before each shuffle; texts are shuffled only for documents with
a base span, and by a hash of the text, so that equal texts share their result.

Defined results: a null text is empty and has no spans; equal texts have equal spans;
empty tables give empty results; other columns are carried along, whatever their names;
long texts are scanned whole, in time linear in their length (runs are scanned once).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, let, settled, text_of

TERM = r"\p{L}+"


class Kind(NamedTuple):
    name: str
    hint: Callable[[Column], Column]  # cheap test that no text with a match fails
    pattern: str  # the base pattern, made to scan a run of characters once
    holds: Callable[[Column], Column]
    value: Callable[[Column], Column]  # the entity that a match stands for


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    from_right = F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(
        F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
        lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(from_right, F.lit(0), lambda a, d: a + d) % 10 == 0


def _card(x: Column) -> Column:
    return let(_digits(x), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False))


_BYTE = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"

#: In the order in which spans that start together are listed. A match may start only at
#: the start of a run, or where the match before it ended: elsewhere in a run it could
#: start only if it could at the run's start. Possessive groups do not recurse.
KINDS = (
    Kind("email", lambda t: F.contains(t, F.lit("@")),
         rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda x: F.lit(True), F.lower),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda x: x.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"), lambda x: x),
    Kind("card", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
         r"[0-9](?:[\x20-]?[0-9])++", _card, _digits),
    Kind("phone", lambda t: F.contains(t, F.lit("+")),
         r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda x: F.char_length(_digits(x)).between(9, 15), _digits),
)
TERM_RANK = len(KINDS)
NAMES = [k.name for k in KINDS] + ["term"]
SPAN = "struct<start:bigint,rank:int,end:bigint,bstart:bigint,bend:bigint,value:string>"


def _scan(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix scan of an array by doubling strides: n log n steps."""
    return let(values, lambda x: F.aggregate(
        F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(x)), x,
        lambda a, s: F.transform(a, lambda v, i: F.when(i >= s, step(F.get(a, i - s), v)).otherwise(v))))


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """Every match of ``pattern`` as a ``SPAN``."""
    def spans(found: Column, between: Column) -> Column:
        ends = lambda size: _scan(F.transform(found, lambda x, i: (size(F.get(between, i)) + size(x)).cast("long")), lambda a, b: a + b)
        return let(ends(F.char_length), lambda e: let(ends(F.octet_length), lambda b: F.transform(found, lambda x, i: F.struct(
            (F.get(e, i) - F.char_length(x)).alias("start"), F.lit(rank).alias("rank"), F.get(e, i).alias("end"),
            (F.get(b, i) - F.octet_length(x)).alias("bstart"), F.get(b, i).alias("bend"), x.alias("value")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(
        F.split(text, pattern, -1), lambda g: spans(m, g))).otherwise(F.array().cast(f"array<{SPAN}>")))


def base_spans(text: Column) -> Column:
    """All base spans of a non-null text, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    holding = lambda k: lambda s: k.holds(s["value"])
    kinds = [F.when(k.hint(text), F.filter(_matches(text, k.pattern, r), holding(k))).otherwise(none) for r, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*kinds))


def _named(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), rank + 1)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _named(s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _slice(data: Column, start: Column, end: Column) -> Column:
    return F.substr(data, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def _terms(text: Column) -> Column:
    """Distinct terms of a non-null text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+", -1)), "")


def _entity(span: Column) -> Column:
    out = F.lit(None).cast("string")
    for r, k in enumerate(KINDS):
        out = F.when(span["rank"] == r, F.concat(F.lit(k.name + ":"), k.value(span["value"]))).otherwise(out)
    return out


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """row, t (the text), h1 and h2 (its hash), base (its base spans) and hit (if there are any)."""
    return (keep_row(docs).withColumn("t", text_of(F.col("row")[text]))
            .withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit("h2"), "t"), "base": base_spans(F.col("t"))})
            .withColumn("hit", settled(F.size("base") > 0)))


def _against_chance(both: Column, one: Column, other: Column, total: Column) -> Column:
    """A lower bound of -ln of the chance that ``one`` and ``other`` of ``total`` documents have ``both`` or more in common."""
    def bound(drawn: Column, marked: Column) -> Column:
        p, q = marked / total, both / drawn
        rest = F.when(q < 1, (1 - q) * F.log((1 - q) / F.greatest(1 - p, F.lit(1e-300)))).otherwise(0.0)
        return F.when(q > p, drawn * (q * F.log(q / p) + rest)).otherwise(0.0)

    return F.greatest(bound(one, other), bound(other, one))


def disclosing_terms(docs: DataFrame, text: str = "text", chance: float = 0.01, generalise_at: float = 0.9,
                     remove_at: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(mentions h1, h2, c) and (c, term, ratio, removed) for the terms that give c away."""
    hit = _scanned(docs, text).filter("hit")
    # A document counts once for an entity, however often it mentions it; copies count as rows do.
    of_c = land(hit.select("h1", "h2", F.explode(F.array_distinct(F.transform("base", _entity))).alias("c"))
                .groupBy("h1", "h2", "c").agg(F.count("*").alias("copies")), "mentions")
    df_c = land(of_c.groupBy("c").agg(F.sum("copies").alias("df_c")), "entities")
    mentions = of_c.select("h1", "h2", "c")
    df_t = land(docs.select(F.explode(_terms(text_of(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")), "df_t")
    total, least = F.lit(float(docs.count())), math.log(max(df_t.count(), 1) / chance)
    worth = lambda n: F.log(total / n)
    # No term can speak more clearly than one that stands in the documents of c and nowhere else: where even that
    # could be chance, c is not paired with any term. This is exact, and leaves out most entities of few documents.
    decided = land(df_c.filter(F.col("df_c") * worth(F.col("df_c")) > least - 1e-9), "decided")
    most = decided.agg(F.max("df_c")).first()[0]
    if most is None:
        none = df_c.select("c", F.col("c").alias("term"), F.lit(0.0).alias("ratio"), F.lit(False).alias("removed"))
        return mentions, none.limit(0)
    # The ratio is at most worth(df_t) / worth(df_c): a bound for all entities first, then for each.
    enough = lambda n: worth(F.col("df_t")) >= generalise_at * worth(n) - 1e-9
    rare = df_t.filter(enough(F.lit(float(most))))
    of_decided = land(mentions.join(decided, "c"), "decided_mentions")
    spoken = hit.select("h1", "h2", "t").join(of_decided.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    held = (spoken.select("h1", "h2", F.explode(_terms(F.col("t"))).alias("term")).join(rare, "term")
            .groupBy("h1", "h2", "term", "df_t").agg(F.count("*").alias("n")))
    pairs = held.join(of_decided, ["h1", "h2"]).filter(enough(F.col("df_c")))
    df_ct = pairs.groupBy("c", "term", "df_c", "df_t").agg(F.sum("n").alias("df_ct"))
    tells = F.log(total * F.col("df_ct") / (F.col("df_c") * F.col("df_t")))
    ratio = F.when(F.col("df_c") < total, tells / worth(F.col("df_c"))).otherwise(0.0)
    surprise = _against_chance(F.col("df_ct"), F.col("df_c"), F.col("df_t"), total)
    terms = (df_ct.withColumn("ratio", ratio).filter((F.col("ratio") >= generalise_at) & (surprise > least))
             .select("c", "term", "ratio", (F.col("ratio") >= remove_at).alias("removed")))
    return mentions, land(terms, "terms")


def find(docs: DataFrame, text: str = "text", chance: float = 0.01, generalise_at: float = 0.9, remove_at: float = 0.99) -> DataFrame:
    """``row`` (all columns), ``t``, ``base`` and ``spans`` (base spans and disclosing terms, by start, then kind).

    Terms inside a base span are covered by it. A term's ``value`` is its tag: empty if it is removed, [TERM] if it is generalised.
    """
    mentions, terms = disclosing_terms(docs, text, chance, generalise_at, remove_at)
    marked = land(mentions.join(terms, "c").groupBy("h1", "h2", "term").agg(F.max("removed").alias("removed")), "marked")
    scanned = _scanned(docs, text)
    hit = scanned.filter("hit")
    texts = hit.select("h1", "h2", "t").join(marked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    words = (texts.select("h1", "h2", F.explode(_matches(F.col("t"), TERM, TERM_RANK)).alias("s"))
             .withColumn("term", F.lower("s.value")))
    found = words.join(marked, ["h1", "h2", "term"]).groupBy("h1", "h2").agg(F.collect_list(F.struct(
        "s.start", "s.rank", "s.end", "s.bstart", "s.bend",
        F.when(F.col("removed"), "").otherwise("[TERM]").alias("value"))).alias("more"))
    beside = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    with_base = (hit.join(found, ["h1", "h2"], "left").withColumn("more", beside)
                 .withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more")))))
    without = scanned.filter("not hit").withColumn("spans", F.col("base"))
    columns = ("row", "t", "base", "spans")
    return with_base.select(*columns).unionByName(without.select(*columns))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its tag; of spans that overlap, the first one's tag stands for all."""
    tag = lambda s: F.when(s["rank"] == TERM_RANK, s["value"]).otherwise(
        F.concat(F.lit("["), F.upper(_named(s["rank"])), F.lit("]")))

    def pieces(s: Column, ends: Column, data: Column) -> Column:
        """ends: the largest end so far."""
        parts = F.transform(s, lambda x, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long")), lambda e: F.when(
            x["bstart"] >= e, F.concat(_slice(data, e, x["bstart"]), tag(x))).otherwise(F.lit(""))))
        tail = let(F.element_at(ends, -1), lambda e: _slice(data, e, F.octet_length(data).cast("long")))
        return F.concat(F.concat_ws("", parts), tail)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda s: let(
        _scan(F.transform(s, lambda x: x["bend"]), lambda a, b: F.greatest(a, b)),
        lambda e: let(text.cast("binary"), lambda data: pieces(s, e, data)))))


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """The documents with personal data and disclosing terms replaced in ``text``; a null text stays null."""
    found = find(docs, text, **thresholds)
    masked = F.when(F.col("row")[text].isNull(), None).otherwise(_masked(F.col("t"), F.col("spans")))
    return found.select(*[masked.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
