"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

The weighted sources share ``budget_percent`` of all sizes.  A target stops at ``most`` times its source's size and
the excess goes to the others by weight until none is above: with sources ordered by cap / weight, the level of the
open ones is the largest (budget - caps before) / (weights from here on).

Within a source every document has the same expected number of copies, target / size of the source.  Documents are put
in order of size and the expected copies summed up to each; with one random offset per source a document is emitted
once for each integer that the running sum crosses.  So a document gets the rounded-down or rounded-up number of
copies, and, since neighbours are of like size, the size taken stays within about one document of the target.

The order is size, then a hash of the id, then a hash of the text, whatever the number of rows.  Running sums are in three
levels: rows of each size of a source, of each range of hashes in a size, and of each row in a range.  A range is a prefix
of the two hashes: a few digits, and where that holds more than ``range_rows`` rows, the whole id's hash and digits of the
text's.  So a source, a size, or an id (or none) that holds most rows is still spread over many tasks, and no window sees
more than the sizes of a source, the ranges of a size or the rows of a range.  Longer prefixes don't change the order.
Everything depends on the rows alone: reruns agree.

Defined results: a null or empty document has size 0; a null source is a source of its own, last in order; a source of
size 0 has target 0; equal rows are numbered in any order among themselves, so their copies may be swapped; an empty
table gives an empty result.  Other columns pass through; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, others, staged

#: Hexadecimal digits of a hash that make a range: 16 to this power ranges for each size of a source.
RANGE_DIGITS = 3
#: Digits of the id's hash.
ID_DIGITS = 32


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget_percent: int, most: int) -> DataFrame:
    """(absent, name, size, target) of each source from (absent, name, size), one row per source."""
    in_order = Window.orderBy("absent", "name")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighted = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("size") / F.col("weight"), "absent", "name")
    everything = Window.partitionBy()
    left = F.sum("size").over(everything) * (budget_percent / 100) - F.coalesce(F.sum(F.col("size") * most).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = weighted.withColumn("level", left / open_weight).withColumn("level", F.max("level").over(everything))
    return level.select("absent", "name", "size", F.least(F.col("size").cast("double") * most, F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def offset(absent: Column, name: Column, seed: str) -> Column:
    """The random offset of a source, in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), absent.cast("string"), F.lit("|"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, *, size: Column | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), budget_percent: int = 150, most: int = 2, seed: str = "mix", keep: list[str] | None = None, range_rows: int = 20_000) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``: how often the mix emits each row (see ``emitted``).

    ``size`` is a document's size, by default its words; ``keep`` names the input columns to pass through (default: all).  Sources in code-point order get the weights in turn."""
    passed = others(docs.columns if keep is None else keep, ["size", "source_size", "target", "copies"])
    tie = F.lpad(F.hex(F.xxhash64(text)), 16, "0") if text in docs.columns else F.lit("")
    sized = docs.select(
        *passed,
        (n_words(text) if size is None else size).alias("__size"),
        F.col(source).isNull().cast("int").alias("__absent"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__name"),
        F.col(id_col).alias("__id"),
        F.concat(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), tie).alias("__hash"),
    )
    named, sizes = ["__absent", "__name"], ["__absent", "__name", "__size"]
    ranges = [*sizes, "__range"]
    dealt = sized.withColumn("__range", F.substring("__hash", 1, RANGE_DIGITS))
    counted = staged(dealt.groupBy(*ranges).agg(F.count(F.lit(1)).alias("__n")), "mix-ranges")
    full = counted.where(F.col("__n") > range_rows).select(*ranges, F.lit(True).alias("__full"))
    if not full.isEmpty():
        longer = F.when(F.col("__full"), F.substring("__hash", 1, ID_DIGITS + RANGE_DIGITS)).otherwise(F.col("__range"))
        dealt = dealt.join(full, ranges, "left").withColumn("__range", longer).drop("__full")
        counted = staged(dealt.groupBy(*ranges).agg(F.count(F.lit(1)).alias("__n")), "mix-ranges")
    by_size = staged(counted.groupBy(*sizes).agg(F.sum("__n").alias("__n")), "mix-sizes")
    plan = targets(by_size.groupBy(F.col("__absent").alias("absent"), F.col("__name").alias("name")).agg(F.sum(F.col("__n") * F.col("__size")).alias("size")), weights, budget_percent, most)
    smaller = F.sum("__n").over(Window.partitionBy(*named).orderBy("__size")) - F.col("__n")
    of_size = by_size.withColumn("__smaller", smaller).drop("__n").join(plan, (F.col("__absent") == F.col("absent")) & (F.col("__name") == F.col("name")))
    inside = F.sum("__n").over(Window.partitionBy(*sizes).orderBy("__range")) - F.col("__n")
    placed = counted.withColumn("__inside", inside).drop("__n").join(of_size, sizes)
    placed = placed.select(*ranges, (F.col("__smaller") + F.col("__inside")).alias("__before"), F.col("size").alias("source_size"), "target", offset(F.col("absent"), F.col("name"), seed).alias("__offset"))
    number = F.col("__before") + F.row_number().over(Window.partitionBy(*ranges).orderBy("__hash", "__id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("__offset") + number * rate) - F.floor(F.col("__offset") + (number - 1) * rate)
    rows = dealt.join(placed.hint("merge"), ranges)
    return rows.select(*passed, F.col("__size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` once per copy, without the columns that ``mix`` added."""
    often = mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return often.drop("__copy", "size", "source_size", "target", "copies")
