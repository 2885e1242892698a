"""Chat formatting: the best branches of reply trees as training conversations.

Iterative self-joins double the reach of every message's pointer towards its root, so a tree of depth n
takes about log2(n) joins, and so does the way back from a chosen leaf to its path. Branches are ranked
by the mean score of their messages. Joins are on the tree and the message, never on the tree alone.
A path becomes one row, the conversation, and has to fit into one; a tree need not.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import stored
from quire.session import ship_with_tasks

#: Marks of a turn. Inside texts, a backslash goes between the first two characters of anything like them.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROWS = 64


def escaped(text: str) -> str:
    """No ``<|`` is left: every run of backslashes between the two characters gets one more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    """As ``escaped``, and without line breaks."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """A conversation as text, and where in it (code points) the loss counts: in assistants' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped_role(role)}\n", escaped(text)
        if role == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    found = re.findall(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", formatted, re.S)
    return [(unescaped_role(role), unescaped(text)) for role, text in found]


def same(left: str, right: str, *names: tuple[str, str]):
    """Join condition, null equal to null."""
    condition = None
    for a, b in names:
        one = F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{b}"))
        condition = one if condition is None else condition & one
    return condition


def branches(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """``messages(tree_id, node_id, parent_id, score)`` to ``(tree_id, branch, node_id, from_leaf)``.

    The ``top_k`` best branches of each tree, numbered from 1, with the distance of each message from
    the leaf. A branch's score is the mean of its messages' scores (null: 0); ties go to the smaller
    leaf. A parent that is missing makes its child a root, and all roots of a tree are ranked
    together. Of rows with one ``node_id`` the smallest counts, nulls first. Messages on or below a cycle have no
    root and lie on no branch. Null ids are ids like others, but a null parent is none.
    """
    node = ("tree_id", "tree_id"), ("node_id", "node_id")
    up = ("tree_id", "tree_id"), ("up", "node_id")
    own = messages.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "score")).alias("m"))
    own = own.select("tree_id", "node_id", F.col("m.parent_id").alias("up"), F.coalesce(F.col("m.score").cast("double"), F.lit(0.0)).alias("total"))
    known = own.select("tree_id", "node_id").withColumn("there", F.lit(True))
    state = stored(
        own.alias("a").join(known.alias("b"), same("a", "b", *up) & F.col("a.up").isNotNull(), "left").select(
            "a.tree_id", "a.node_id", F.when(F.col("b.there"), F.col("a.up")).alias("up"), F.lit(1).cast("long").alias("reach"), "a.total"
        ),
        "tree",
    )
    tree = state
    jumps, waiting = [], state.filter("up IS NOT NULL").count()
    while waiting:
        open_ = state.filter("up IS NOT NULL")
        jumps.append(open_.select("tree_id", "node_id", "up"))
        further = open_.alias("a").join(state.alias("b"), same("a", "b", *up)).select(
            "a.tree_id", "a.node_id", "b.up", (F.col("a.reach") + F.col("b.reach")).alias("reach"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        state = stored(state.filter("up IS NULL").unionByName(further), "tree")
        left = state.filter("up IS NOT NULL").count()
        if left == waiting:  # only cycles are left
            break
        waiting = left
    parents = tree.select("tree_id", F.col("up").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    leaves = state.filter("up IS NULL").alias("a").join(parents.alias("b"), same("a", "b", *node), "left_anti")
    best = Window.partitionBy("tree_id").orderBy((F.col("total") / F.col("reach")).desc(), "node_id")
    paths = stored(
        leaves.withColumn("branch", F.row_number().over(best))
        .filter(F.col("branch") <= top_k)
        .select("tree_id", "branch", "node_id", F.lit(0).cast("long").alias("from_leaf")),
        "paths",
    )
    for k, jump in reversed(list(enumerate(jumps))):
        more = paths.alias("a").join(jump.alias("b"), same("a", "b", *node)).select(
            "a.tree_id", "a.branch", F.col("b.up").alias("node_id"), (F.col("a.from_leaf") + (1 << k)).alias("from_leaf")
        )
        paths = stored(paths.unionByName(more), "paths")
    return paths


def _format(batches):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            turns = [[(t["role"] or "", t["text"] or "") for t in x] for x in part.column("turns").to_pylist()]
            texts, spans = zip(*map(render, turns), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("tree_id"),
                    part.column("branch"),
                    pa.array(texts, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["tree_id", "branch", "formatted", "loss"],
            )


def conversations(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """``messages(tree_id, node_id, parent_id, score, role, text)`` to ``(tree_id, branch, formatted, loss)``.

    One row per chosen branch; ``loss`` has the spans of ``formatted`` (code points) that a model
    learns from. Null roles and texts are empty. An empty table gives an empty one.
    """
    chosen = branches(messages.select("tree_id", "node_id", "parent_id", "score"), top_k)
    said = messages.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "score", "role", "text")).alias("m"))
    said = said.select("tree_id", "node_id", "m.role", "m.text")
    turns = (
        chosen.alias("a")
        .join(said.alias("b"), same("a", "b", ("tree_id", "tree_id"), ("node_id", "node_id")))
        .select("a.tree_id", "a.branch", F.struct((-F.col("a.from_leaf")).alias("at"), "b.role", "b.text").alias("turn"))
        .groupBy("tree_id", "branch")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )
    kind = messages.schema["tree_id"].dataType.simpleString()
    return turns.mapInArrow(_format, f"tree_id {kind}, branch int, formatted string, loss array<struct<start:bigint,end:bigint>>")


def threads(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as reply trees without branches: each row answers the one before.

    Rows stand in the order of turn, role and text, nulls first; repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("node_id", F.row_number().over(order).cast("long"))
    return placed.select(
        F.col("conv_id").alias("tree_id"),
        "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _read_back(batches):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            texts, loss = part.column("formatted").to_pylist(), part.column("loss").to_pylist()
            turns = [parse(t) for t in texts]
            learnt = ["".join(unescaped(t[s["start"] : s["end"]]) for s in spans) for t, spans in zip(texts, loss, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("tree_id"),
                    pa.array([len(t) for t in turns], pa.int64()),
                    pa.array([_hex("".join(f"{role}\n{text}\n" for role, text in t)) for t in turns]),
                    pa.array([len(x) for x in learnt], pa.int64()),
                    pa.array([_hex(x) for x in learnt]),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask."""
    kind = formatted.schema["tree_id"].dataType.simpleString()
    columns = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree_id", "formatted", "loss").mapInArrow(_read_back, columns)


def twin(extra: str) -> str:
    """The digests in SQL, for ``conversations`` and the rows ``extra`` (a list of VALUES)."""
    marks = len(OPEN) + len(CLOSE) + 2
    role = r"replace(replace(who, '\', '\\'), chr(10), '\n')"
    more = r"len(regexp_extract_all({0}, '<\\*\|'))"
    order = "'' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    learnt = f"coalesce(string_agg(said, {order}) FILTER (role = 'assistant'), '')"
    return f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {extra}),
s AS (SELECT conv_id, turn, text, role, coalesce(text, '') AS said, coalesce(role, '') AS who FROM t),
l AS (SELECT *, {marks} + length({role}) + {more.format("who")} + length(said) + {more.format("said")} AS chars FROM s)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(who || chr(10) || said || chr(10), {order})) AS turns_sha256,
  length({learnt})::bigint AS loss_chars, sha256({learnt}) AS loss_sha256, sum(chars)::bigint AS formatted_chars
FROM l GROUP BY conv_id"""


ship_with_tasks(__name__)
