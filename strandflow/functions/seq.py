"""Column helpers for base strings: A C G T and ``-`` are bases, ``.`` is the unknown gap between mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged

GAP = "."
#: Rank of symbols where counts tie, for entropy correction and for clustering.
ENTROPY_ORDER = "ACGT-"
CLUSTER_ORDER = "ACTG-"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(seq: Column | str) -> Column:
    """The characters of a string as an array; empty for the empty string."""
    return F.filter(F.split(c(seq), ""), lambda x: x != "")


def order_rank(base: str, order: str) -> Column:
    """Place of the base in ``order``, 1 first; unknown symbols come last."""
    out = F.lit(len(order) + 1)
    for i, x in enumerate(order):
        out = F.when(F.col(base) == x, i + 1).otherwise(out)
    return out


def explode_bases(reads: DataFrame, seq: str = "seq", start: str = "start_pos") -> DataFrame:
    """One row per base: ``off`` in the read, 0-based ``pos`` in the genome (starts are 1-based) and ``base``."""
    return reads.select("*", F.posexplode(chars(seq)).alias("off", "base")).withColumn("pos", F.col(start) + F.col("off") - 1)


def joined(off: str, base: str) -> Column:
    """The string of a group's bases in the order of ``off``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(off).alias("o"), F.col(base).alias("b")))), lambda x: x["b"]), "")


def assembled(df: DataFrame, keys: list[str], off: str, base: str, name: str) -> DataFrame:
    """Strings put together from their bases in order; the rows of a key are at most a read's length."""
    return df.groupBy(*keys).agg(joined(off, base).alias(name))


def dense_ids(df: DataFrame, coarse: str, fine: list[str], name: str) -> DataFrame:
    """0-based ids in the order of (coarse, *fine), nulls first; rows equal in all of these in any order.

    Rows are sorted in ranges of the whole key and written with their place, so that one ``coarse`` value that holds many
    rows lies in several tasks; ranges are numbered on from the rows before them, and the window has one row a range."""
    keys = [coarse, *fine]
    at = F.monotonically_increasing_id()  # number of the task above 33 bits of the place in it
    ranged = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at), "ranges").withColumn("__range", F.shiftright("__at", 33))
    before = ranged.groupBy("__range").count().select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    inner = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + inner).cast("long")).drop("__at", "__range", "__before")


def r9(x: Column) -> Column:
    """Nine digits, and no negative zero."""
    return F.round(x, 9) + F.lit(0.0)
