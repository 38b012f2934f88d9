"""SCL-01: label extraction: inputs with their labels, and properties of any label."""

from hypothesis import given, settings
from hypothesis import strategies as st
from issuelens.functions.text import extract_issuetype


CASES = {
    None: "Unknown", "": "Unknown", "   ": "Unknown", "\n\n": "Unknown", "no label here": "Unknown", "Issuetype": "Unknown",
    "Issuetype: :": "Unknown", "Issuetype: -": "Unknown",
    "Issuetype: Bug": "Bug", "ISSUETYPE:  Improvement -:.": "Improvement", "**Issuetype:** Bug": "** Bug",
    "issuetype: issuetype\nIssuetype: Task": "Task", "Issuetype:\r\nIssuetype: Story.": "Story",
    "Issuetype: Bug\nIssuetype: Task": "Bug", "x: Issuetype: Bug": "Issuetype: Bug", "Issuetype: Bug ": "Bug",
    "Issuetype: New Feature rest": "New Feature rest", "Reasoning\u0085Issuetype: Epic": "Epic", "Issuetype: Sub-task": "Sub-task",
    "Issuetype:\xa0Bug\xa0": "Bug", "\u2003Issuetype:\u2003Story\u3000.": "Story\u3000", "Issuetype: Bug\u2028Issuetype: Task": "Bug",
    "issuetype:\nIssuetype: issuetype.\nIssuetype: **Bug**": "**Bug**",
}

ALPHABET = st.sampled_from(list("abI ssuetypeTYPE:.-*\n\r\t  \u0085\x0b\x0cxyz") + [
    "Issuetype:", "issuetype:", "ISSUETYPE:", "\r\n", "Bug", "Task"])


def _labels(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, o string")
    got = {r["i"]: r["p"] for r in df.select("i", extract_issuetype("o").alias("p")).collect()}
    return [got[i] for i in range(len(values))]


def test_cases(spark):
    assert dict(zip(CASES, _labels(spark, list(CASES)))) == CASES


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=40))
def test_properties(spark, values):
    """A label is never empty, ends in none of " .:-", is the word itself never, and stands in the text; prefixed lines win."""
    for text, label in zip(values, _labels(spark, values)):
        assert label and label[-1] not in " .:-"
        assert label == "Unknown" or (label.lower() != "issuetype" and label in text and "issuetype:" in text.lower())
    first = _labels(spark, [f"Issuetype: Chosen one.\n{v}" for v in values])
    assert set(first) == {"Chosen one"}
