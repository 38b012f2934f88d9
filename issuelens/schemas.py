"""Explicit schemas of the issue document and the evaluation records."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

NAME = T.StructType([T.StructField("name", S)])

LINK = T.StructType([
    T.StructField("id", S),
    T.StructField("type", NAME),
])

SUBTASK = T.StructType([T.StructField("id", S), T.StructField("key", S)])

COMMENT = T.StructType([
    T.StructField("id", S),
    T.StructField("created", S),
    T.StructField("body", S),
])

CHANGE_ITEM = T.StructType([
    T.StructField("field", S),
    T.StructField("fromString", S),
    T.StructField("toString", S),
])

HISTORY = T.StructType([
    T.StructField("created", S),
    T.StructField("items", T.ArrayType(CHANGE_ITEM)),
])

FIELDS = T.StructType([
    T.StructField("summary", S),
    T.StructField("description", S),
    T.StructField("created", S),
    T.StructField("issuetype", NAME),
    T.StructField("project", NAME),
    T.StructField("issuelinks", T.ArrayType(LINK)),
    T.StructField("subtasks", T.ArrayType(SUBTASK)),
    T.StructField("comments", T.ArrayType(COMMENT)),
    T.StructField("custom_fields", T.MapType(S, S)),
])

CHANGELOG = T.StructType([T.StructField("histories", T.ArrayType(HISTORY))])

# One issue document, as landed (repo is the partition column).
ISSUE = T.StructType([
    T.StructField("repo", S),
    T.StructField("_id", S),
    T.StructField("key", S),
    T.StructField("fields", FIELDS),
    T.StructField("changelog", CHANGELOG),
])

# Evaluation item (input of the benchmark) and evaluation result.
EVAL_ITEM = T.StructType([
    T.StructField("summary", S),
    T.StructField("description", S),
    T.StructField("expected_issuetype", S),
])

EVAL_RESULT = T.StructType([
    T.StructField("summary", S),
    T.StructField("description", S),
    T.StructField("expected", S),
    T.StructField("predicted", S),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("llm_output", S),
])

# Index rows: metadata and vector in the same row (no positional join).
INDEX_ROW = T.StructType([
    T.StructField("issue_key", S),
    T.StructField("text", S),
    T.StructField("issuetype", S),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def narrow(schema: T.StructType, paths: list[str]) -> T.StructType:
    """Keep only the leaves named by dotted ``paths`` (arrays are walked through).

    Nested-column pruning stops at the first array level, so a narrow *read*
    schema is how a scan of ``changelog.histories.items.field`` avoids reading
    every other leaf of ``items``.
    """
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def cut(dt, sub):
        if not sub:
            return dt
        if isinstance(dt, T.ArrayType):
            return T.ArrayType(cut(dt.elementType, sub), dt.containsNull)
        if isinstance(dt, T.StructType):
            fields = [T.StructField(f.name, cut(f.dataType, sub[f.name]), f.nullable)
                      for f in dt.fields if f.name in sub]
            missing = set(sub) - {f.name for f in dt.fields}
            if missing:
                raise ValueError(f"unknown path parts {sorted(missing)}")
            return T.StructType(fields)
        raise ValueError(f"cannot descend into {dt.simpleString()}")

    return cut(schema, tree)
