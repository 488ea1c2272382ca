"""Numbers of paths of a layered graph, by tables of transfer counts that are multiplied in a tree.

A step leads from a node of a layer to one of the next.  How many paths lead from each node at the begin of a block of
layers to each node at its end is a small table; two blocks side by side make one by a join on the node between them and
a sum.  Blocks double in each round, so n layers take log2(n) rounds, however many paths there are: no path is ever listed.
From the tree of blocks come

 * ``reached``: the number of paths to every node, by going down the tree with the counts at each block's begin;
 * ``leading``: the same from every node to the last layer, on the mirrored graph;
 * ``interval_paths``: the number of paths over any interval of layers, a product of at most two blocks a round.

Every second round is written before the next.  Counts are decimals of 38 digits; ``FULL`` stands for itself or more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import staged

COUNT, FULL = "decimal(38,0)", 10**38 - 1
#: Rounds of joins between two that are written.
WRITTEN = 2
#: A node of every layer from which paths begin further on; never a node of a graph, as those are bases.
SOURCE = "*"


def _one() -> Column:
    return F.lit(1).cast(COUNT)


def _full() -> Column:
    return F.lit(str(FULL)).cast(COUNT)


def _products(left: str, right: str) -> Column:
    """The sum of products, in an aggregation."""
    return F.coalesce(F.try_sum(F.coalesce(F.try_multiply(F.col(left), F.col(right)), _full())), _full())


def _sum(n: str) -> Column:
    return F.coalesce(F.try_sum(n), _full())


@dataclass
class Tree:
    """``levels[l]``: (block, src, dst, n), where block b covers the layers from b 2^l on, 2^l of them or what is left."""

    levels: list[DataFrame]
    sizes: list[int]


def tree(steps: DataFrame, n: int) -> Tree:
    """The tree of ``n`` layers of steps (block, src, dst), numbered from 0; a layer without steps lets no path through."""
    level = staged(steps.select(F.col("block").cast("long").alias("block"), "src", "dst", _one().alias("n")), "transfers")
    out, size = Tree([level], [n]), n
    while size > 1:
        half = F.shiftright("block", 1).alias("block")
        left = level.where("block % 2 = 0").select(half, "src", F.col("dst").alias("mid"), F.col("n").alias("x"))
        right = level.where("block % 2 = 1").select(half, F.col("src").alias("mid"), "dst", F.col("n").alias("y"))
        both = left.join(right, ["block", "mid"]).groupBy("block", "src", "dst").agg(_products("x", "y").alias("n"))
        if size % 2:
            both = both.unionByName(level.where(F.col("block") == size - 1).select(half, "src", "dst", "n"))
        size = (size + 1) // 2
        level = staged(both, "transfers") if len(out.levels) % WRITTEN == 0 or size == 1 else both
        out.levels.append(level)
        out.sizes.append(size)
    return out


def _moved(at: DataFrame, level: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, n): counts at the begin of blocks (keys, node, v, block) taken to their ends."""
    step = level.select("block", F.col("src").alias("node"), "dst", "n")
    return at.join(step, ["block", "node"]).groupBy(*keys, F.col("dst").alias("node")).agg(_products("v", "n").alias("n"))


def along(t: Tree, start: DataFrame) -> DataFrame:
    """(layer, node, n): the number of paths from ``start`` (node, n at layer 0) to every node of every layer."""
    now, turn = start.select(F.lit(0).cast("long").alias("block"), "node", "n"), 0
    for level, size in reversed(list(zip(t.levels[:-1], t.sizes[:-1], strict=True))):
        first = now.select((F.col("block") * 2).alias("block"), "node", "n")
        second = _moved(first.withColumnRenamed("n", "v"), level, ["block"]).select((F.col("block") + 1).alias("block"), "node", "n")
        now = first.unionByName(second).where(F.col("block") < size)
        turn += 1
        now = staged(now, "path-counts") if turn % WRITTEN == 0 or size == t.sizes[0] else now
    last = now.where(F.col("block") == t.sizes[0] - 1).withColumnRenamed("n", "v")
    end = _moved(last, t.levels[0], ["block"]).select((F.col("block") + 1).alias("block"), "node", "n")
    return now.unionByName(end).withColumnRenamed("block", "layer")


def reached(edges: DataFrame, begin: DataFrame, last: int | None = None) -> DataFrame:
    """(vi, node, n_paths): nodes that paths from ``begin`` (vi, node) reach, with the number of paths to them.

    ``edges``: (vi, src, dst) from site vi to vi + 1; those beyond site ``last`` aren't followed.  Empty inputs give what
    ``begin`` has."""
    edges = edges.select("vi", "src", "dst") if last is None else edges.select("vi", "src", "dst").where(F.col("vi") <= last)
    begin = begin.select("vi", "node").distinct()
    bounds = edges.select("vi").union(begin.select(F.col("vi") - 1)).agg(F.min("vi").alias("a"), F.max("vi").alias("b")).first()
    first = begin.agg(F.min("vi").alias("a")).first().a
    if first is None:
        return begin.select("vi", "node", _one().alias("n_paths"))
    edges, n = edges.where(F.col("vi") >= first), bounds.b - first + 1
    if n <= 0:
        return begin.select("vi", "node", _one().alias("n_paths"))
    block = (F.col("vi") - first).alias("block")
    waiting = edges.sparkSession.range(n).select(F.col("id").alias("block"), F.lit(SOURCE).alias("src"), F.lit(SOURCE).alias("dst"))
    entering = begin.where(F.col("vi") > first).select((F.col("vi") - first - 1).alias("block"), F.lit(SOURCE).alias("src"), F.col("node").alias("dst"))
    steps = edges.select(block, "src", "dst").union(waiting).union(entering)
    start = begin.where(F.col("vi") == first).select("node").union(edges.sparkSession.range(1).select(F.lit(SOURCE).alias("node"))).select("node", _one().alias("n"))
    counted = along(tree(steps, n), start).where(F.col("node") != SOURCE)
    return counted.select((F.col("layer") + first).cast("int").alias("vi"), "node", F.col("n").alias("n_paths"))


def leading(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(vi, node, n_paths): nodes from which paths lead to ``ends`` (vi, node), with their number."""
    mirrored = edges.select((-F.col("vi") - 1).alias("vi"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached(mirrored, ends.select((-F.col("vi")).alias("vi"), "node")).withColumn("vi", -F.col("vi"))


def pieces(intervals: DataFrame, n_levels: int) -> DataFrame:
    """(id, level, block, turn): the blocks that make up layers [lo, hi) of each interval (id, lo, hi), in order.

    At each level an odd begin takes its block, and an odd end the one before it."""
    taken = []
    for l in range(n_levels):  # noqa: E741
        a, b = F.expr(f"(lo + {(1 << l) - 1}) div {1 << l}"), F.expr(f"hi div {1 << l}")
        taken.append(F.when((a < b) & (a % 2 == 1), F.struct(F.lit(l).alias("level"), a.alias("block"), F.lit(l).alias("order"))))
        taken.append(F.when((a < b) & (b % 2 == 1), F.struct(F.lit(l).alias("level"), (b - 1).alias("block"), F.lit(2 * n_levels - l).alias("order"))))
    listed = F.array_sort(F.transform(F.filter(F.array(*taken), lambda x: x.isNotNull()), lambda x: F.struct(x["order"].alias("order"), x["level"].alias("level"), x["block"].alias("block"))))
    return intervals.select("id", F.posexplode(listed).alias("turn", "x")).select("id", "turn", "x.level", "x.block")


def interval_paths(t: Tree, intervals: DataFrame, start: DataFrame) -> DataFrame:
    """(id, n): the number of paths over layers [lo, hi) of each interval (id, lo, hi) from its ``start`` (id, node).

    All intervals are multiplied at once, a block of each a turn; those without a path are left out."""
    every = t.levels[0].select(F.lit(0).alias("level"), "*")
    for l in range(1, len(t.levels)):  # noqa: E741
        every = every.unionByName(t.levels[l].select(F.lit(l).alias("level"), "*"))
    plan = staged(pieces(intervals, len(t.levels)), "interval-blocks")
    turns = plan.agg(F.max("turn").alias("x")).first().x
    now = start.select("id", "node", _one().alias("n"))
    for turn in range(0 if turns is None else turns + 1):
        here = plan.where(F.col("turn") == turn).select("id", "level", "block")
        going = now.withColumnRenamed("n", "v").join(here, "id")
        step = every.select("level", "block", F.col("src").alias("node"), "dst", "n")
        moved = going.join(step, ["level", "block", "node"]).groupBy("id", F.col("dst").alias("node")).agg(_products("v", "n").alias("n"))
        now = staged(now.join(here, "id", "left_anti").unionByName(moved), "interval-counts")
    return now.groupBy("id").agg(_sum("n").alias("n"))
