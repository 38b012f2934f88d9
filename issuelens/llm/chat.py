"""Chat formatting of reply trees.

``reply_paths`` enumerates root-to-leaf paths by iterative self-joins: round k adds, to
what is known of each leaf's path, the ancestors 2**k replies further up, so a path of n
messages takes log2(n) rounds. ``best_paths`` ranks a tree's paths by the sum of their
messages' scores. ``format_paths`` writes each chosen path as one conversation with a
loss mask; ``read_back`` parses a formatted conversation.

Template, one line end after each turn: ``### role: text</turn>``. Inside texts (and
roles) a backslash is written as \\b, the first # of ### as \\h, the < of </turn> as
\\l, and in roles a colon as \\c, so neither control string occurs in them and reading
back restores every character.

Defined results: a null text or role is empty, a null score counts 0, a null
conversation id is one conversation; a parent that does not exist makes its reply a root;
replies in a loop raise ValueError; of paths of equal score the one with the smaller last
message comes first; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land

END = "</turn>\n"
LEARNED = "assistant"  # the role whose texts are under the loss mask

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_CODES = {"\\": "\\b", "#": "\\h", "<": "\\l", ":": "\\c"}
_PLAIN = {code[1]: char for char, code in _CODES.items()}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _CODES[m.group()], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([bhlc])", lambda m: _PLAIN[m.group(1)], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the stretches (code points, end exclusive) that loss counts on."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', _CODES[':'])}: ", escape(text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix("### ").partition(": ")
        turns.append((unescape(role), unescape(text)))
    return turns


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """(tree, node, above) for each power of two: ``above`` is that many replies before ``node``.

    ``messages`` has tree (string), node and parent (long, null for a root). A tree of n
    messages makes at most n rows for each of its log n levels.
    """
    nodes = land(messages.select("tree", "node", "parent"), "nodes")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = land(nodes.filter("parent is not null").join(known, ["tree", "parent"], "left_semi")
                .select("tree", "node", F.col("parent").alias("above")).distinct(), "jump")
    levels, total = [], nodes.count()
    while not jump.isEmpty():
        if 1 << len(levels) > total:
            raise ValueError("replies form a loop")
        levels.append(jump)
        further = jump.alias("a").join(jump.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.above") == F.col("b.node")))
        jump = land(further.select("a.tree", "a.node", "b.above"), "jump")
    return levels


def best_paths(messages: DataFrame, levels: list[DataFrame], branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score) of each tree's best ``branches`` paths (None: all), ranked by the sum of scores.

    A tree of a single leaf is one path, its score the sum of the tree. In the others sums are
    doubled along with the levels, one row for each message; no path is written out.
    """
    own = messages.groupBy("tree", "node").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    leaves = own.select("tree", F.col("node").alias("leaf"))
    if levels:
        leaves = leaves.join(levels[0].select("tree", F.col("above").alias("leaf")), ["tree", "leaf"], "left_anti")
    leaves = land(leaves, "leaves")
    branching = land(leaves.groupBy("tree").agg(F.count("*").alias("n")).filter("n > 1").select("tree"), "branching")
    single = leaves.join(branching, "tree", "left_anti").join(own.groupBy("tree").agg(F.sum("score").alias("score")), "tree")
    ranked = single.withColumn("rank", F.lit(1))
    if not branching.isEmpty():
        sums = land(own.join(branching, "tree", "left_semi"), "scores")
        for jump in levels:
            above = (jump.join(branching, "tree", "left_semi")
                     .join(sums.select("tree", F.col("node").alias("above"), F.col("score").alias("more")), ["tree", "above"]))
            sums = land(sums.join(above.select("tree", "node", "more"), ["tree", "node"], "left")
                        .select("tree", "node", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")), "scores")
        several = leaves.join(sums.withColumnRenamed("node", "leaf"), ["tree", "leaf"])
        ranked = ranked.unionByName(several.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def reply_paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up) for every message on the path of these leaves (tree, leaf); up: replies from it to the leaf."""
    paths = land(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "paths")
    for k, jump in enumerate(levels):
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = land(paths.unionByName(more), "paths")
    return paths


def format_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, id, leaf, rank, formatted and mask (array of start, end) of every chosen path.

    ``messages``: tree, id (of the tree, to carry along), node, parent, role, text, score.
    """
    levels = ancestors(messages)
    chosen = land(best_paths(messages, levels, branches), "chosen")
    paths = reply_paths(chosen, levels)
    said = messages.select("tree", "id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (paths.join(chosen.select("tree", "leaf", "rank"), ["tree", "leaf"]).join(said, ["tree", "node"])
             .groupBy("tree", "id", "leaf", "rank")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")))

    @F.pandas_udf("formatted string, mask array<struct<start:bigint,end:bigint>>")
    def written(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        done = [format_turns(list(zip(r, t, strict=True))) for r, t in zip(roles, texts, strict=True)]
        return pd.DataFrame({"formatted": [f for f, _ in done], "mask": [[{"start": a, "end": b} for a, b in m] for _, m in done]})

    return turns.withColumn("w", written(F.col("turns.role"), F.col("turns.text"))).select(
        "tree", "id", "leaf", "rank", "w.formatted", "w.mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """id and the digests of what the formatted text and its mask say."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digests(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            turns = parse_turns(text)
            loss = "".join(unescape(text[int(x):int(y)]) for x, y in zip(a, b, strict=True))
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((len(turns), sha(said), len(loss), sha(loss), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("d", digests("formatted", F.col("mask.start"), F.col("mask.end"))).select("id", "d.*")


def linear(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations whose rows follow each other by turn, as the messages of reply trees without branches.

    Rows of equal turn follow by role, then text.
    """
    row = F.col("row")
    rows = keep_row(conversations).select(row[id].alias("id"), row[turn].alias("turn"), row[role].alias("role"), row[text].alias("text"))
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("c"), F.col("id").cast("string")), F.lit("none")))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("node", node).select(
        "tree", "id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))
