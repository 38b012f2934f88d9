import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from issuelens.llm import queries, rules

SF = "/root/testdata/sf0.01"


def test_statistics_against_a_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "Ä b Ä b", "a a a B! | c.\n\nx x,", "\U0001f600 Ünder 12", "the THE of\nthe\nthe", "w " * 300_000]
    texts += [" ".join(rng.choice(["the", "A!", "b.", "c,", "|", "9#", "\n", "é", "THE"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, s string, words string").repartition(3)
    got = {r.doc_id: r for r in rules.statistics(frame).select("row.doc_id", "s.*").collect()}
    assert len(got) == len(texts)
    stop = set(rules.STOP_WORDS)
    for k, text in enumerate(texts):
        t, r = text or "", got[k]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = max(len(w), 1)
        want = {
            "n_words": len(w), "chars_per_word": sum(map(len, w)) / n, "distinct_words": len(set(w)) / n,
            "same_as_before": sum(a == b for a, b in zip(w, w[1:])) / n, "upper_chars": sum(c.isupper() for c in t) / max(len(t), 1),
            "symbols": sum(c in "#*$%&<>" for c in t) / n, "bangs": t.count("!") / n, "bars": t.count("|") / n,
            "full_stops": t.count(".") / n, "commas": t.count(",") / n, "digits": sum(c in "0123456789" for c in t) / n,
            "stop_words": sum(x in stop for x in w) / n, "letter_chars": sum(c.isalpha() for c in t) / max(len(t), 1),
            "words_per_line": len(w) / max(len(lines), 1), "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1)}
        assert tuple(want) == rules.STATISTICS
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (k, name)


def test_paths_and_expressions(spark):
    debug = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.5)
     If (feature 2 <= 0.25)
      Predict: 0.0
     Else (feature 2 > 0.25)
      Predict: 1.0
    Else (feature 0 > 5.5)
     If (feature 0 <= 9.0)
      Predict: 1.0
     Else (feature 0 > 9.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 6 <= 1.0E-4)
     Predict: 0.0
    Else (feature 6 > 1.0E-4)
     Predict: 1.0
"""
    c = rules.Condition
    want = {(c("n_words", False, 5.5),), (c("distinct_words", False, .25), c("n_words", False, 5.5)), (c("distinct_words", True, .25), c("n_words", False, 5.5)),
            (c("n_words", True, 5.5),), (c("n_words", False, 9.0), c("n_words", True, 5.5)), (c("n_words", True, 9.0),),
            (c("bangs", False, 1e-4),), (c("bangs", True, 1e-4),)}
    paths = rules.conditions_of(debug)
    assert set(paths) == want and len(paths) == len(want)
    model = rules.Ensemble(-1.0, [((c("n_words", True, 2.0), c("bangs", False, .5)), 3.0), ((c("commas", True, 0.0),), -2.0)])
    frame = rules.statistics(spark.createDataFrame([("a b c",), ("a b, c",), ("a!",), (None,)], "text string"))
    scores = {r.text: r.p for r in frame.select("row.text", rules.score(F.col("s"), model).alias("p")).collect()}
    for text, total in (("a b c", 2.0), ("a b, c", 0.0), ("a!", -1.0), (None, -1.0)):
        assert scores[text] == pytest.approx(1 / (1 + 2.718281828459045 ** -total))


def test_held_out_accuracy_of_the_query(spark):
    scored = queries.op11_rule_ensemble(spark, SF)
    rows = scored.collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by = {r.doc_id: r for r in rows}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if by[r.doc_id].held_out]
    assert len(labels) > 50 and sum(by[r.doc_id].predicted == r.quality for r in labels) >= 0.97 * len(labels)
    again = {r.doc_id: r.score for r in queries.op11_rule_ensemble(spark, SF).collect()}
    assert all(again[k] == r.score for k, r in by.items())


def test_labels_held_out_and_odd_ones_change_nothing(spark):
    docs = spark.createDataFrame([(k, ("Good words, and more. " if k % 3 else "BAD!! ") * 9, "z") for k in range(60)] + [(None, None, "z"), (7, "second", "z")],
                                 "doc_id long, text string, id string").repartition(4)
    labels = [(k, int(k % 3 > 0), "w") for k in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, s string").repartition(3)
    seen = lambda l: {(r.id, r.s.n_words): r.score for r in rules.fit_and_score(docs, l, "quality").collect()}
    one = seen(frame(labels))
    assert len(one) == 62 and all((p > 0.5) == bool(k % 3) for (k, n), p in one.items() if k is not None and n > 1)
    assert one == seen(frame(labels * 2 + [(None, 1, "w"), (3, None, "w"), (4, 7, "w"), (10 ** 6, 0, "w")]))
    assert set(seen(frame([(1, 1, "w"), (2, 1, "w")])).values()) == {0.75}
    assert set(seen(frame([])).values()) == {0.5}
    assert rules.fit_and_score(docs.limit(0), frame(labels), "quality").count() == 0
    model = rules.Ensemble(0.0, [((rules.Condition("bangs", False, 0.5),), 5.0)])
    kept = rules.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 42
