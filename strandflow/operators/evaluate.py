"""Comparison of reads with known haplotypes (hap_id, seq); known haplotypes are few: broadcast up to a
measured size, met in parts or by a shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import chars, explode_bases, r9
from ..functions.tables import paired, sized


def read_hap_distance(reads: DataFrame, haps: DataFrame) -> DataFrame:
    """(start_pos, seq, cnt, hap_id, dist): different bases of each read and haplotype where both are, gaps left out."""
    own = F.expr("substring(hseq, start_pos, length(seq))")
    both = paired(reads.select("start_pos", "seq", "cnt"), haps.select("hap_id", F.col("seq").alias("hseq")))
    pairs = F.arrays_zip(chars("seq").alias("r"), chars(own).alias("h"))
    dist = F.size(F.filter(pairs, lambda x: (x["r"] != x["h"]) & (x["r"] != ".")))
    return both.select("start_pos", "seq", "cnt", "hap_id", dist.alias("dist"))


def nearest_haplotype(distances: DataFrame) -> DataFrame:
    """(start_pos, seq, cnt, hap_id, dist) of the nearest haplotype, the least id on a tie."""
    best = F.min(F.struct("dist", "hap_id"))
    return distances.groupBy("start_pos", "seq", "cnt").agg(best.alias("b")).select("start_pos", "seq", "cnt", F.col("b.hap_id").alias("hap_id"), F.col("b.dist").alias("dist"))


def within(nearest: DataFrame, region: tuple[int, int] | None) -> DataFrame:
    """Reads that begin at ``region[0]`` or later and end so that start and length don't pass ``region[1]``; all without one."""
    if region is None:
        return nearest
    return nearest.where((F.col("start_pos") >= region[0]) & (F.col("start_pos") + F.length("seq") <= region[1]))


def distance_histogram(nearest: DataFrame, region: tuple[int, int] | None = None, below: int | None = None) -> DataFrame:
    """(dist, hap_id, cnt) of reads ``within`` the region, with a distance under ``below`` if one is given."""
    inside = within(nearest, region)
    inside = inside if below is None else inside.where(F.col("dist") < below)
    return inside.groupBy("dist", "hap_id").agg(F.sum("cnt").alias("cnt"))


def nearest_confusion(before: DataFrame, after: DataFrame) -> DataFrame:
    """(hap_before, hap_after, cnt, n_changed) over reads; ``after`` bears the raw sequence as ``seq``."""
    b = before.select("start_pos", "seq", "cnt", F.col("hap_id").alias("hap_before"))
    a = after.select("start_pos", "seq", F.col("hap_id").alias("hap_after"))
    return b.join(a, ["start_pos", "seq"]).groupBy("hap_before", "hap_after").agg(F.sum("cnt").alias("cnt"), F.sum(F.when(F.col("hap_before") != F.col("hap_after"), F.col("cnt")).otherwise(0)).alias("n_changed"))


def mismatch_profile(nearest: DataFrame, haps: DataFrame, exact_only: bool = False) -> DataFrame:
    """(pos, hap_id, n_match, n_mismatch) of distinct reads against their nearest haplotype, unweighted.

    With ``exact_only`` matches count only for reads that differ nowhere from it."""
    equal = F.col("base") == F.col("h")
    match = equal & (F.col("dist") == 0) if exact_only else equal
    h = explode_bases(haps.select("hap_id", "seq", F.lit(1).alias("start_pos"))).select("hap_id", "pos", F.col("base").alias("h"))
    b = explode_bases(nearest).where("base <> '.'").join(sized(h), ["hap_id", "pos"])
    return b.groupBy("pos", "hap_id").agg(F.sum(F.when(match, 1).otherwise(0)).alias("n_match"), F.sum(F.when(~equal, 1).otherwise(0)).alias("n_mismatch"))


def odd_sites(profile: DataFrame, region: tuple[int, int] | None = None, most: int = 200, all_mismatches: bool = False) -> DataFrame:
    """The rows of a ``mismatch_profile`` at places in [region[0], region[1]) where some haplotype has more mismatches than
    matches, or more than ``most``; with ``all_mismatches`` where any has a mismatch."""
    odd = F.col("n_mismatch") > 0 if all_mismatches else (F.col("n_mismatch") > F.col("n_match")) | (F.col("n_mismatch") > most)
    inside = profile if region is None else profile.where((F.col("pos") >= region[0]) & (F.col("pos") < region[1]))
    return inside.join(inside.where(odd).select("pos").distinct(), "pos", "left_semi")


def length_buckets(nearest: DataFrame, bounds: tuple[int, ...], region: tuple[int, int] | None = None, known_only: bool = False) -> DataFrame:
    """(bucket, cnt, n_exact): reads ``within`` the region by their length - the bucket is the first bound above it, the
    last one beyond - and those without a difference.  Gaps count, unless only known bases are asked for."""
    length = F.length(F.translate("seq", ".", "") if known_only else "seq")
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(length < b, b).otherwise(bucket)
    return within(nearest, region).groupBy(bucket.alias("bucket")).agg(F.sum("cnt").alias("cnt"), F.sum(F.when(F.col("dist") == 0, F.col("cnt")).otherwise(0)).alias("n_exact"))


def diversity(haps: DataFrame) -> DataFrame:
    """One row: mean pairwise distance of genomes, and per base."""
    b = explode_bases(haps.select("hap_id", "seq", F.lit(1).alias("start_pos"))).select("hap_id", "pos", "base")
    x, y = b.select(F.col("hap_id").alias("i"), "pos", F.col("base").alias("bi")), b.select(F.col("hap_id").alias("j"), "pos", F.col("base").alias("bj"))
    d = x.join(y, "pos").where("i < j").groupBy("i", "j").agg(F.sum(F.when(F.col("bi") != F.col("bj"), 1).otherwise(0)).alias("d"), F.count(F.lit(1)).alias("n"))
    return d.agg(r9(F.avg("d")).alias("mean_dist"), r9(F.avg(F.col("d") / F.col("n"))).alias("per_base"))


def site_report(entropies: DataFrame, nearest: DataFrame, far: int, n_haps: int) -> DataFrame:
    """(pos, entropy, n_dot, n_h0 …, n_far): each place with its reads by nearest haplotype, and reads of distance above ``far``."""
    b = explode_bases(nearest)
    counts = [F.sum(F.when(F.col("hap_id") == h, F.col("cnt")).otherwise(0)).alias(f"n_h{h}") for h in range(n_haps)]
    by = b.groupBy("pos").agg(*counts, F.sum(F.when(F.col("dist") > far, F.col("cnt")).otherwise(0)).alias("n_far"))
    return entropies.select("pos", "entropy", "n_dot").join(by, "pos")
