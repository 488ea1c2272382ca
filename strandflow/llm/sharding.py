"""A uniform shuffle of all rows into shards of exact size, in DataFrame operations only.

Rows are dealt to logical partitions by a hash.  How many rows of each partition go to each shard is drawn on the
driver, exactly as a uniform permutation would have it: partition by partition, a multivariate hypergeometric draw
from the room left in the shards.  Rows are permuted within their partition (an order by one hash), the first go to
the first shard and so on by the drawn counts, and in its shard each row gets a place by a second permutation (an
order by another hash).  Both orders are in two levels, a range of the hash and a number within it, so neither a
partition nor a shard need fit one task.

The counts are partitions x shards numbers with a most of partitions, whatever the table's size.  Whole rows travel
twice, dealt by ranges of about ``RANGE_ROWS`` rows to so many tasks that each gets about ``TASK_BYTES`` of text.  All
depends on id and text alone: reruns and retried tasks agree.

Defined results: shard sizes differ by one at most, slots of a shard are 0 to its size - 1; null ids and texts are
values like others; rows equal in id and text are exchangeable; fewer rows than shards leave the last shards empty; an
empty table gives an empty result.  Other columns pass through; ``shard`` and ``slot`` replace columns of that name.
"""

from __future__ import annotations

import json
import random
from math import ceil, exp, lgamma, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, staged, unit

#: Rows for each logical partition, as far as the most partitions allow; rows for each range of a hash; text of a task.
BLOCK_ROWS, MOST_PARTITIONS = 10_000, 4096
RANGE_ROWS, TASK_BYTES = 500, 32 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement from good + bad are good; any size, by inversion from the mode outward."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    of = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    at = exp(of(good, mode) + of(bad, n - mode) - of(total, n))
    u = rng.random() - at
    down = up = at
    i = j = mode
    far = 40 + 12 * sqrt(n * (good / total) * (bad / total))  # beyond it lies nothing that a double can tell from 0
    while u > 0 and (i > low or j < high) and max(mode - i, j - mode) < far:
        if j < high:
            up *= (good - j) * (n - j) / ((j + 1) * (bad - n + j + 1))
            j += 1
            u -= up
            if u <= 0:
                return j
        if i > low:
            down *= i * (bad - n + i) / ((good - i + 1) * (n - i + 1))
            i -= 1
            u -= down
            if u <= 0:
                return i
    return mode


def matrix(rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition (``rows``) that go to each shard; columns sum to sizes that differ by one at most."""
    total, rng = sum(rows), random.Random(seed)
    room = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    out = []
    for n in rows:
        line, left = [], sum(room)
        for j in range(n_shards):
            left -= room[j]
            line.append(hypergeometric(rng, room[j], left, n))
            n -= line[-1]
        room = [r - x for r, x in zip(room, line, strict=True)]
        out.append(line)
    return out


def numbered(rows: DataFrame, by: str, spread: str, ranges: int, tasks: int, name: str) -> DataFrame:
    """``rows`` with ``__number``, 1 and on within each ``by`` in order of the hash ``spread``."""
    keys = [by, "__range"]
    ranged = rows.withColumn("__range", F.floor(unit(spread) * ranges).cast("int"))
    counts = staged(ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), name)
    before = counts.select(*keys, (F.sum("__n").over(Window.partitionBy(by).orderBy("__range")) - F.col("__n")).alias("__before"))
    dealt = ranged.repartition(tasks, *keys).join(before.repartition(tasks, *keys).hint("merge"), keys)
    number = F.col("__before") + F.row_number().over(Window.partitionBy(*keys).orderBy(spread))
    return dealt.withColumn("__number", number).drop("__range", "__before")


def shard(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, a uniform shuffle given by ``seed``."""
    spark = docs.sparkSession
    passed = others(docs.columns, ["shard", "slot"])
    total, n_bytes = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    n_parts = min(MOST_PARTITIONS, max(n_shards, ceil(total / BLOCK_ROWS)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((n_bytes or 0) / TASK_BYTES))

    def drawn(*salt: int) -> Column:
        return F.xxhash64(F.col(id_col), F.xxhash64(text), *(F.lit(seed * 8 + s) for s in salt))

    dealt = docs.select(*passed, F.pmod(drawn(0), F.lit(n_parts)).cast("int").alias("__part"), drawn(1).alias("__first"), drawn(2).alias("__second"))
    counts = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}  # n_parts rows at most
    ends = []
    for p, line in enumerate(matrix([counts.get(p, 0) for p in range(n_parts)], n_shards, seed)):
        ends.append({"__part": p, "__ends": [sum(line[: j + 1]) for j in range(n_shards - 1)]})
    made = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<__part: int, __ends: array<bigint>>>")).alias("x")).select("x.*")
    sent = numbered(dealt, "__part", "__first", max(1, ceil(total / n_parts / RANGE_ROWS)), tasks, "shard-parts").join(F.broadcast(made), "__part")  # n_parts x n_shards numbers
    sent = sent.withColumn("__shard", F.size(F.filter("__ends", lambda e: e < F.col("__number"))).cast("int")).drop("__ends", "__number", "__part", "__first")
    out = numbered(sent, "__shard", "__second", max(1, ceil(total / n_shards / RANGE_ROWS)), tasks, "shard-slots")
    return out.select(*passed, F.col("__shard").alias("shard"), (F.col("__number") - 1).cast("long").alias("slot"))
