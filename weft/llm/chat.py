r"""Chat formatting from reply trees.

A reply tree's root-to-leaf paths come from iterative self-joins that double the reach in each round: every
node learns its 2^k-th ancestor, its depth and its path's score in a number of joins that grows with the
logarithm of the depth. Leaves are ranked by their path's mean score (ties: smallest node) and the paths of
the `best` first ones are gathered by the same jumps and formatted as one conversation each.

Template, one turn a line group: `### ROLE: TEXT </turn>\n` without the spaces around TEXT. In texts and roles a
backslash stands before each backslash and each `#` and inside `</turn>` before its slash, in roles before `:` too; so
neither `###` nor `</turn>` occurs inside a formatted text, and reading back removes exactly these backslashes.

Defined cases: a null role or text is empty; a node whose parent is null or missing is a root; repeated
(tree, node) rows keep the one of smallest (parent, role, text); a cycle raises an error; equal turns of a
conversation stand in order of role, then text; a null conversation id is a conversation of its own; an
empty table gives an empty result; a very long text is formatted whole, in its path's row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.llm.common import materialize

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
MAX_ROUNDS = 40
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in the formatted string."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"not a turn at {at}")
        out.append((_BACK.sub(r"\1", turn[1]), _BACK.sub(r"\1", turn[2]), turn.start(2), turn.end(2)))
        at = turn.end()
    return out


def loss_spans(formatted: str, role: str = ASSISTANT) -> list[tuple[int, int]]:
    return [(s, e) for r, _, s, e in read_back(formatted) if r == role]


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """nodes: tree string, node long, parent long, role, text, score double.
    Rows of the chosen paths: tree, leaf, place (rank of the path), depth, role, text."""
    one = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("tree", "node", "x.*")
    one = materialize(one, "nodes")
    there = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    linked = one.select("tree", "node", "parent", "score").join(there, ["tree", "parent"], "left")
    state = linked.select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    jumps = []
    for _ in range(MAX_ROUNDS):
        state = materialize(state, "jumps")
        if state.where("up is not null").isEmpty():
            break
        jumps.append(state.where("up is not null").select("tree", "node", "up"))
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("gain"))
        joined = state.where("up is not null").join(far, ["tree", "up"])
        moved = joined.select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("gain")).alias("total"))
        state = state.where("up is null").unionByName(moved)  # nodes that have reached their root don't join again
    else:
        raise ValueError("a reply tree has a cycle")
    parents = linked.where("found").select("tree", F.col("parent").alias("node")).distinct()
    leaves = state.join(parents, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), "node"))).where(F.col("place") <= best)
    held = materialize(ranked.select("tree", F.col("node").alias("leaf"), "place", "node"), "held")
    for jump in jumps:
        above = held.join(jump, ["tree", "node"]).select("tree", "leaf", "place", F.col("up").alias("node"))
        held = materialize(held.unionByName(above), "held")  # each round reads the last one twice
    depths = state.select("tree", "node", "depth")
    return held.join(depths, ["tree", "node"]).join(one.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "place", "depth", "role", "text")


def format_paths(chosen: DataFrame) -> DataFrame:
    """tree, leaf, place and the formatted conversation of each chosen path."""
    turn = F.concat(F.lit(HEAD), escape(F.coalesce("role", F.lit("")), True), F.lit(MIDDLE), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    turns = chosen.select("tree", "leaf", "place", F.struct("depth", turn.alias("turn")).alias("x")).groupBy("tree", "leaf", "place").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return turns.select("tree", "leaf", "place", F.array_join(F.col("xs.turn"), "").alias("formatted"))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A conversation as a tree: each turn replies to the one before."""
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), F.col("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


DIGEST = "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tree, formatted in zip(batch["tree"].to_pylist(), batch["formatted"].to_pylist(), strict=True):
            turns = read_back(formatted)
            lost = "".join(_BACK.sub(r"\1", formatted[s:e]) for s, e in loss_spans(formatted))
            every = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            rows.append((tree, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(formatted)))
        if rows:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    return formatted.select("tree", "formatted").mapInArrow(_digest, DIGEST)
