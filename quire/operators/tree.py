"""Trees stored as (node_id, parent_id): intervals, paths, closures, moves and filters.

A walk through the tree, siblings in order, numbers its nodes; the subtree of a node is then an interval of
numbers, from its own to that of its last descendant. Closures, deletions, moves and filters compare numbers
and never hold the way to a node. Numbers come from pointer jumping: after round ``r`` every node knows its
ancestor ``4^r`` steps up and how many descendants it has within that distance, so a tree of depth 100,000
needs nine rounds of joins on a unique key. Rounds go on until no further node reaches a root; what is
left then lies on or below a cycle. The lineage is cut in every round by a checkpoint or a written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranking import global_running_sum, row_number_within
from quire.session import checkpointed, written


def _with_known_parents(nodes: DataFrame, **values: Column) -> DataFrame:
    """``(node_id, up, ...)``; a node whose parent is unknown counts as a root."""
    ids = nodes.select(F.col("node_id").alias("known"))
    joined = nodes.join(ids, nodes["parent_id"] == ids["known"], "left")
    return checkpointed(joined.select("node_id", F.col("known").alias("up"), *[v.alias(name) for name, v in values.items()]))


def _climb(state: DataFrame, added: Callable[[str], Column]) -> DataFrame:
    """Follow all pointers to the roots. ``added(name)`` puts the value ``upper_name`` before ``name``."""
    names = [c for c in state.columns if c not in ("node_id", "up")]
    open_before, still_open = None, state.filter("up is not null").count()
    while still_open and still_open != open_before:
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), *[F.col(n).alias(f"upper_{n}") for n in names])
        values = [F.when(F.col(f"upper_{n}").isNotNull(), added(n)).otherwise(F.col(n)).alias(n) for n in names]
        state = checkpointed(state.join(above, "up", "left").select("node_id", F.col("next").alias("up"), *values))
        open_before, still_open = still_open, state.filter("up is not null").count()
    return state


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``(node_id, path, depth)`` with the path from the root to the node, both included.

    Nodes on or below a cycle have no path to a root and come out with NULL path and depth.
    """
    state = _climb(_with_known_parents(nodes, path=F.array("node_id")), lambda n: F.concat(f"upper_{n}", n))
    rooted = F.col("up").isNull()
    return state.select(
        "node_id",
        F.when(rooted, F.col("path")).alias("path"),
        F.when(rooted, F.size("path") - 1).cast("bigint").alias("depth"),
    )


def intervals(nodes: DataFrame) -> DataFrame:
    """``(node_id, enter, leave, depth)``: the number of each node in a walk through the trees, from 0, and
    the largest number in its subtree. Siblings follow each other by ``order_index``, if there is one, and
    ``node_id``. Nodes on or below a cycle have NULL numbers.
    """
    order = ["order_index"] if "order_index" in nodes.columns else []
    # Written tables come back without what the planner has inferred about them, which grows with each join.
    state = _with_known_parents(nodes, size=F.lit(1).cast("bigint"), **{c: F.col(c) for c in order})
    parents = state.select("node_id", F.col("up").alias("parent"), *order)
    pointers, sized, jumps = state.select("node_id", "up"), state.select("node_id", "size"), []
    open_before, still_open = None, pointers.filter("up is not null").count()
    while still_open and still_open != open_before:
        hops = pointers.withColumnRenamed("up", "j1").join(sized, "node_id")
        for k in (2, 3, 4):
            further = pointers.select(F.col("node_id").alias(f"j{k - 1}"), F.col("up").alias(f"j{k}"))
            hops = hops.join(further, f"j{k - 1}", "left")
        hops = written(hops.select("node_id", "j1", "j2", "j3", "j4", "size"), "hops")
        # Descendants at four times the distance are those of the nodes one, two and three jumps below.
        below = hops.select(F.explode(F.array("j1", "j2", "j3")).alias("node_id"), F.col("size").alias("more")).filter("node_id is not null")
        more = below.groupBy("node_id").agg(F.sum("more").alias("more"))
        sized = hops.join(more, "node_id", "left").select("node_id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        pointers = hops.select("node_id", F.col("j4").alias("up"))
        jumps.append(hops.select("node_id", "j1", "j2", "j3"))
        open_before, still_open = still_open, pointers.filter("up is not null").count()
    rooted = parents.join(sized, "node_id").join(pointers.filter("up is null").select("node_id"), "node_id")
    summed = global_running_sum(rooted, ["parent", *order, "node_id"], "size", "before")
    first = summed.groupBy(F.col("parent").alias("of")).agg(F.min("before").alias("first"))
    placed = summed.join(first, F.col("parent").eqNullSafe(F.col("of")))
    child = F.col("parent").isNotNull().cast("bigint")
    walk = written(placed.select("node_id", "size", (F.col("before") - F.col("first") + child).alias("enter"), child.alias("depth")), "walk")
    for jump in jumps:
        # What the way up adds, at four times the distance.
        longer = walk.join(jump, "node_id")
        for k in (1, 2, 3):
            above = walk.select(F.col("node_id").alias(f"j{k}"), F.col("enter").alias(f"enter{k}"), F.col("depth").alias(f"depth{k}"))
            longer = longer.join(above, f"j{k}", "left")
        plus = [sum((F.coalesce(f"{n}{k}", F.lit(0)) for k in (1, 2, 3)), F.col(n)).alias(n) for n in ("enter", "depth")]
        walk = written(longer.select("node_id", "size", *plus), "walk")
    walk = walk.select("node_id", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), "depth")
    return written(nodes.select("node_id").join(walk, "node_id", "left"), "intervals")


def _cells(low: str, high: str, levels: int) -> Column:
    """The fewest aligned ranges of ``2^level`` numbers that make up ``low`` to ``high``."""
    return F.expr(f"""explode(flatten(transform(sequence(0, {levels}), l -> filter(array(
        if(shiftright({low} + shiftleft(1L, l) - 1, l) < shiftright({high} + 1, l) and shiftright({low} + shiftleft(1L, l) - 1, l) & 1 = 1,
          struct(l as level, shiftright({low} + shiftleft(1L, l) - 1, l) as cell), null),
        if(shiftright({low} + shiftleft(1L, l) - 1, l) < shiftright({high} + 1, l) and shiftright({high} + 1, l) & 1 = 1,
          struct(l as level, shiftright({high} + 1, l) - 1 as cell), null)), c -> c is not null))))""")


def within(points: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``points(enter)`` with ``ranges(low, high)`` that hold them, each pair once.

    A range is cut into a few aligned pieces, and a point looks up the piece that it lies in at each size
    that occurs: an equi join, without comparing all pairs.
    """
    largest = points.agg(F.max("enter")).first()[0]
    cut = ranges.withColumn("at", _cells("low", "high", int(largest or 0).bit_length() + 1)).select("*", "at.level", "at.cell").drop("at", "low", "high")
    cut = written(cut, "ranges")
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # no more than bits of a number
    each = points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    each = each.withColumn("cell", F.expr("shiftright(enter, level)"))
    return each.join(cut, ["level", "cell"], how).drop("level", "cell")


def read_tree(nodes: DataFrame) -> DataFrame:
    """Every node with its depth, child count and the sibling positions along its path.

    Ordering by ``sort_path`` walks the tree depth first, siblings by (order_index, node_id). Nodes on
    or below a cycle have NULL depth and ``sort_path``.
    """
    own = F.concat(F.col("order_index").cast("string"), F.lit(":"), F.col("node_id").cast("string"))
    state = _with_known_parents(nodes, label=own, depth=F.lit(0).cast("bigint"))
    ways = {"label": lambda n: F.concat(f"upper_{n}", F.lit("/"), n), "depth": lambda n: F.col(f"upper_{n}") + F.col(n) + 1}
    state = _climb(state, lambda n: ways[n](n))
    rooted = F.col("up").isNull()
    keyed = state.select("node_id", F.when(rooted, F.col("depth")).alias("depth"), F.when(rooted, F.col("label")).alias("sort_path"))
    children = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("n_children")
    )
    return (
        nodes.select("node_id", "parent_id", "title")
        .join(keyed, "node_id", "left")
        .join(children, "node_id", "left")
        .select("node_id", "parent_id", "title", "depth", "sort_path", F.coalesce("n_children", F.lit(0)).alias("n_children"))
    )


def _subtrees(nodes: DataFrame, roots: DataFrame, walk: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    walk = (walk or intervals(nodes)).filter("enter is not null")
    wanted = walk.join(roots.select(F.col("root_id").alias("node_id")).distinct(), "node_id")
    return walk.select("node_id", "enter"), wanted.select(F.col("node_id").alias("root_id"), F.col("enter").alias("low"), F.col("leave").alias("high"))


def subtree_closure(nodes: DataFrame, roots: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """``(root_id, node_id)`` for every node of each root's subtree, the root included. ``walk``: the
    ``intervals`` of the nodes, if they are known; so in the functions below."""
    return within(*_subtrees(nodes, roots, walk)).select("root_id", "node_id")


def delete_subtrees(nodes: DataFrame, roots: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """The nodes outside the subtrees of ``roots``."""
    gone = within(*_subtrees(nodes, roots, walk), "left_semi").select("node_id").distinct()
    return nodes.join(gone, "node_id", "left_anti")


def validate_moves(nodes: DataFrame, moves: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """``moves(node_id, target_id)`` with a verdict: a node may not move below itself.

    A NULL target makes the node a root.
    """
    walk = walk or intervals(nodes)
    own = walk.select("node_id", "enter", "leave", F.lit(True).alias("exists"))
    targets = walk.select(F.col("node_id").alias("target_id"), F.col("enter").alias("at"), F.lit(True).alias("known_target"))
    joined = moves.join(own, "node_id", "left").join(targets, "target_id", "left")
    verdict = (
        F.when(F.col("exists").isNull(), "unknown node")
        .when(F.col("target_id").isNull(), "ok")
        .when(F.col("target_id") == F.col("node_id"), "onto itself")
        .when(F.col("known_target").isNull(), "unknown target")
        .when(F.col("at").isNull(), "target on a cycle")
        .when(F.col("at").between(F.col("enter"), F.col("leave")), "into own subtree")
        .otherwise("ok")
    )
    return joined.select("node_id", "target_id", verdict.alias("verdict"))


def append_order(nodes: DataFrame, added: DataFrame) -> DataFrame:
    """Sibling positions for ``added(node_id, parent_id)`` behind the existing children."""
    last = nodes.groupBy(F.col("parent_id").alias("above")).agg(F.max("order_index").alias("last"))
    turned = row_number_within(added.select("node_id", "parent_id"), ["parent_id"], ["node_id"], "turn")
    return turned.join(last, F.col("parent_id").eqNullSafe(F.col("above")), "left").select(
        "node_id", "parent_id", (F.coalesce("last", F.lit(-1)) + F.col("turn")).cast("bigint").alias("order_index")
    )


def filter_with_ancestors(nodes: DataFrame, term: str, walk: DataFrame | None = None) -> DataFrame:
    """Nodes whose title or note contains ``term``, with all their ancestors.

    A node stays if there are more hits up to the end of its subtree than before its begin.
    """
    text = F.lower(F.concat("title", F.coalesce("note", F.lit(""))))
    hit = F.coalesce(F.contains(text, F.lit(term.strip().lower())), F.lit(False)).cast("bigint")
    walk = (walk or intervals(nodes)).join(nodes.select("node_id", hit.alias("hit")), "node_id").filter("enter is not null")
    counted = written(global_running_sum(walk.select("node_id", "enter", "leave", "hit"), ["enter"], "hit", "before"), "counted")
    ends = counted.select(F.col("enter").alias("leave"), (F.col("before") + F.col("hit")).alias("after"))
    kept = counted.join(ends, "leave").filter("after > before").select("node_id")
    return nodes.join(kept, "node_id", "left_semi")
