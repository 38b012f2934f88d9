"""Prompt assembly, generator scoring and evaluation metrics."""

from pyspark.sql import functions as F

from issuelens import constants as K
from issuelens.functions.prompt import class_list_text, rag_prompts
from issuelens.functions.text import chat_messages, completion_after_prompt
from issuelens.operators import evaluate as ev
from issuelens.operators import generate as gn


def expected_prompt(summary, similar):
    """Plain restatement of the prompt format."""
    s = (K.PROMPT_HEAD + f"Summary: '{summary}'\n\n" + K.PROMPT_CONTEXT)
    if similar:
        s += K.PROMPT_SIMILAR_INTRO
        for i, (key, sim, text, it) in enumerate(similar, 1):
            s += f"--- Similar Ticket {i} (Key: {key}, Similarity: {sim:.4f}) ---\n"
            s += f"Text: {text}\n"
            if it:
                s += f"Original Issue Type: {it}\n"
        s += K.PROMPT_SIMILAR_END
    else:
        s += K.PROMPT_NO_SIMILAR
    s += K.PROMPT_CLASSES_HEAD + class_list_text() + K.PROMPT_TAIL
    return s


def test_class_list():
    text = class_list_text()
    assert text.count("\n") == 47
    assert "- New TLP \n" in text and "- Bug: A problem which impairs" in text


def test_prompts(spark):
    neigh = spark.createDataFrame(
        [("q1", 2, "K-2", 0.5, "second", ""), ("q1", 1, "K-1", 0.91234, "first", "Bug")],
        "query_id string, rank int, key string, similarity double, text string, issuetype string")
    queries = spark.createDataFrame([("q1", "it's broken"), ("q2", "lonely")], "query_id string, summary string")
    got = {r["query_id"]: r["prompt"] for r in rag_prompts(neigh, queries).collect()}
    assert got["q1"] == expected_prompt("it's broken", [("K-1", 0.91234, "first", "Bug"), ("K-2", 0.5, "second", "")])
    assert got["q2"] == expected_prompt("lonely", [])


def test_score_predict_evaluate(spark):
    prompts = spark.createDataFrame(
        [("a", "Original Issue Type: Bug\n"), ("b", "nothing"), ("c", "Original Issue Type: task\n"), ("d", "x")],
        "query_id string, prompt string")

    def fn(p):
        if p == "x":
            raise RuntimeError("down")
        return gn.NearestLabelGenerator().generate(p)

    scored = gn.score(prompts, gn.make_generator("callable", fn=fn))
    rows = {r["query_id"]: r for r in scored.collect()}
    assert rows["d"]["llm_output"] is None and "down" in rows["d"]["error"]
    pred = gn.predict(scored)
    testset = spark.createDataFrame([("a", "s", None, "Bug"), ("b", "s", "d", "Bug"), ("c", "s", "d", "Task"),
                                     ("d", "s", "d", "Task"), ("e", "s", "d", "Bug")],
                                    "query_id string, summary string, description string, expected string")
    res = ev.results(pred, testset)
    r = {x["query_id"]: x for x in res.collect()}
    assert r["a"]["is_correct"] and r["c"]["is_correct"]            # case-insensitive
    assert r["b"]["predicted"] == "Unknown" and not r["b"]["is_correct"]
    assert r["d"]["predicted"] == K.PREDICTED_ON_FAILURE and r["d"]["llm_output"] == K.OUTPUT_ON_FAILURE
    assert r["e"]["predicted"] == K.PREDICTED_ON_FAILURE             # no prediction row
    assert r["a"]["description"] == ""
    acc = ev.accuracy(res).collect()[0]
    assert (acc["correct"], acc["total"], acc["accuracy"]) == (2, 5, 0.4)
    wide = ev.confusion_wide(res)
    assert wide.columns == ["expected", "Bug", K.PREDICTED_ON_FAILURE, "Task", "Unknown", "task"]
    bug = [x for x in wide.collect() if x["expected"] == "Bug"][0]
    assert (bug["Bug"], bug["Unknown"], bug["Task"], bug[K.PREDICTED_ON_FAILURE]) == (1, 1, 0, 1)


def test_empty_accuracy(spark):
    empty = spark.createDataFrame([], "is_correct boolean")
    assert ev.accuracy(empty).collect()[0]["accuracy"] == 0.0


def test_unknown_backend_raises_on_driver():
    import pytest
    with pytest.raises(ValueError):
        gn.make_generator("nope")


def test_chat_and_completion(spark):
    df = spark.createDataFrame([("p", "p  answer \n"), ("q", "q")], "prompt string, gen string")
    out = df.select(F.size(chat_messages("prompt")).alias("n"),
                    F.size(chat_messages("prompt", "sys")).alias("m"),
                    completion_after_prompt("gen", "prompt").alias("c")).collect()
    assert [(r["n"], r["m"], r["c"]) for r in out] == [(1, 2, "answer"), (1, 2, "")]
