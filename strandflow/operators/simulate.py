"""Simulated variants of a genome at a level of diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simulate_variants(haps: DataFrame, *, n: int = 2, diversity: float = 0.01, spacing: int = 3, seed: int = 1) -> DataFrame:
    """(variant_id, seq): variants of the first genome (hap_id 0), ``diversity`` of whose bases are changed.

    Places come in the order of a seeded hash; a place within ``spacing`` of one already taken is left out, so no retry
    is needed.  Half of the changes are shared by all variants."""
    genome = haps.where("hap_id = 0").select("seq", F.length("seq").alias("size"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda p: F.struct(F.xxhash64(p, F.lit(seed)).alias("r"), p.alias("p"))))
    apart = F.aggregate(order, F.array().cast("array<int>"), lambda acc, x: F.when(F.exists(acc, lambda q: F.abs(q - x["p"]) < spacing), acc).otherwise(F.concat(acc, F.array(x["p"]))))
    k = F.greatest(F.lit(1), F.round(F.col("size") * diversity).cast("int"))
    placed = genome.withColumns({"places": apart, "k": k}).select("seq", "places", "k", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("variant_id"))
    half = F.floor(F.col("k") / 2).cast("int")
    own = F.concat(F.slice("places", 1, half), F.slice("places", half + 1 + (F.col("variant_id") - 1) * (F.col("k") - half), F.col("k") - half))
    letters = F.array(*map(F.lit, "ACGT"))

    def base(x, p):
        shared = F.array_contains(F.slice("places", 1, half), p)
        turn = F.pmod(F.xxhash64(p, F.when(shared, 0).otherwise(F.col("variant_id")), F.lit(seed + 1)), F.lit(3)) + 1
        return F.when(F.array_contains(own, p), F.element_at(letters, ((F.array_position(letters, x) - 1 + turn) % 4 + 1).cast("int"))).otherwise(x)

    return placed.select("variant_id", F.array_join(F.transform(F.split("seq", ""), base), "").alias("seq"))
