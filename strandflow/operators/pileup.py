"""Reads by place: deduplication, pileup, entropy, variant sites and correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import ENTROPY_ORDER, assembled, chars, dense_ids, explode_bases, joined, order_rank, r9

#: The least entropy of a variant site, and log2 of five symbols.
LEAST_ENTROPY, LOG2_FIVE = 0.03445, 2.32192809
_COUNTS = {"A": "n_a", "C": "n_c", "G": "n_g", "T": "n_t", "-": "n_gap"}


def read_dedup(reads: DataFrame) -> DataFrame:
    """Reads of equal start and sequence become one with their number; input (start_pos, seq)."""
    return reads.groupBy("start_pos", "seq").agg(F.count(F.lit(1)).alias("cnt"))


def read_ids(reads: DataFrame) -> DataFrame:
    """0-based ids in the order of start and sequence."""
    return dense_ids(reads, "start_pos", ["seq"], "read_id")


def pileup(reads: DataFrame) -> DataFrame:
    """Counted bases of each place; ``depth`` without gaps, ``n_dot`` all other symbols."""
    counts = [F.sum(F.when(F.col("base") == b, F.col("cnt")).otherwise(0)).alias(name) for b, name in _COUNTS.items()]
    known = F.col("base").isin(*_COUNTS)
    return explode_bases(reads).groupBy("pos").agg(*counts, F.sum(F.when(known, F.col("cnt")).otherwise(0)).alias("depth"), F.sum(F.when(known, 0).otherwise(F.col("cnt"))).alias("n_dot"))


def site_entropy(piled: DataFrame) -> DataFrame:
    """Entropy of each place over five symbols, 0 to 1; 0 where nothing is known."""
    p = [F.when(F.col("depth") > 0, F.col(n) / F.col("depth")).otherwise(F.lit(0.0)) for n in _COUNTS.values()]
    total = sum((F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0))
    return piled.withColumn("entropy", r9(-total / LOG2_FIVE))


def site_mode(piled: DataFrame) -> DataFrame:
    """The most frequent base of each place; ties go to the first of A, C, G, T, -."""
    best = F.greatest(*_COUNTS.values())
    mode = F.lit(None).cast("string")
    for b, n in reversed(list(_COUNTS.items())):
        mode = F.when(F.col(n) == best, b).otherwise(mode)
    return piled.withColumn("mode", mode)


def variant_sites(entropies: DataFrame, least: float = LEAST_ENTROPY) -> DataFrame:
    """(vi, pos, entropy, mode) of places of at least this entropy, numbered from 0."""
    ids = F.row_number().over(Window.orderBy("pos")) - 1  # one row per variant place of a genome
    return site_mode(entropies.where(F.col("entropy") >= least)).select(ids.alias("vi"), "pos", "entropy", "mode")


def corrected_reads(reads: DataFrame, piled: DataFrame, least: float = LEAST_ENTROPY, most_places: int = 1 << 20) -> DataFrame:
    """(start_pos, seq, cnt, corrected_seq, changed): at places of low entropy each symbol but a gap becomes the mode.

    The modes of a genome of up to ``most_places`` places are one string, a symbol a place, which is broadcast: reads are
    corrected where they are, without a shuffle.  For longer genomes reads are exploded and meet the modes by place."""
    fix = site_mode(site_entropy(piled)).where((F.col("entropy") < least) & F.col("mode").isNotNull()).select("pos", "mode")
    first, last = piled.agg(F.min("pos"), F.max("pos")).first()
    if last is not None and first >= 0 and last < most_places:
        places = piled.sparkSession.range(last + 1, numPartitions=1).select(F.col("id").cast("int").alias("pos")).join(fix, "pos", "left")
        mask = places.withColumn("fixed", F.coalesce("mode", F.lit(" "))).agg(joined("pos", "fixed").alias("mask"))
        own = chars(F.expr("substring(mask, start_pos, length(seq))"))
        new = F.zip_with(chars("seq"), own, lambda b, m: F.when((b == ".") | (m == " "), b).otherwise(m))
        out = reads.crossJoin(F.broadcast(mask)).select("start_pos", "seq", "cnt", F.array_join(new, "").alias("corrected_seq"))
    else:
        b = explode_bases(reads).join(fix, "pos", "left")
        new = F.when((F.col("base") == ".") | F.col("mode").isNull(), F.col("base")).otherwise(F.col("mode"))
        out = assembled(b.withColumn("new", new), ["start_pos", "seq", "cnt"], "off", "new", "corrected_seq")
    return out.withColumn("changed", F.col("corrected_seq") != F.col("seq"))


def after_correction(fixed: DataFrame) -> DataFrame:
    """(start_pos, seq, cnt) of corrected reads, counted anew."""
    return fixed.groupBy("start_pos", F.col("corrected_seq").alias("seq")).agg(F.sum("cnt").alias("cnt"))


def variant_sites_post(reads: DataFrame) -> DataFrame:
    """Places with more than one base; (vi, pos, n_bases)."""
    n = explode_bases(reads).where("base <> '.'").groupBy("pos").agg(F.countDistinct("base").alias("n_bases")).where("n_bases > 1")
    return n.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("vi"), "pos", "n_bases")


def shared_bases(reads: DataFrame, length: int) -> DataFrame:
    """(pos, base) of all places: the base if all reads agree, ``_`` if not, null where none is known."""
    seen = explode_bases(reads).where("base <> '.'").groupBy("pos").agg(F.countDistinct("base").alias("n"), F.max("base").alias("b"))
    every = reads.sparkSession.range(length).select(F.col("id").cast("int").alias("pos"))
    return every.join(seen, "pos", "left").select("pos", F.when(F.col("n") > 1, "_").otherwise(F.col("b")).alias("base"))


def position_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places of a that are not in b."""
    return a.select("pos").exceptAll(b.select("pos"))


def read_length_range(reads: DataFrame) -> DataFrame:
    return reads.agg(F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"))


def merged_mates(pairs: DataFrame) -> DataFrame:
    """(start_pos, seq) of mates (start_1, seq_1, start_2, seq_2, cnt), the first at or before the second: joined by gaps
    or trimmed by their overlap; N is read as ``-``."""
    overlap = F.col("start_1") + F.length("seq_1") - F.col("start_2")
    tail = F.expr("substring(seq_2, greatest(start_1 + length(seq_1) - start_2, 0) + 1)")
    gap = F.expr("repeat('.', greatest(start_2 - start_1 - length(seq_1), 0))")
    whole = F.translate(F.concat("seq_1", gap, F.when(overlap >= F.length("seq_2"), "").otherwise(tail)), "N", "-")
    return pairs.groupBy(F.col("start_1").alias("start_pos"), whole.alias("seq")).agg(F.sum("cnt").alias("cnt"))


def named_mates(reads: DataFrame) -> DataFrame:
    """(qname, n, start_1, seq_1, start_2, seq_2) of each read name of (qname, start_pos, seq): its mates in order of place,
    the second null for a single read.  A name holds two mates at most, however many rows bear it; ``n`` tells."""
    mate = F.struct("start_pos", "seq")
    both = reads.groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min(mate).alias("a"), F.max(mate).alias("b"))
    second = lambda c: F.when(F.col("n") > 1, F.col(f"b.{c}"))
    return both.select("qname", "n", F.col("a.start_pos").alias("start_1"), F.col("a.seq").alias("seq_1"), second("start_pos").alias("start_2"), second("seq").alias("seq_2"))


def fragments(reads: DataFrame, with_mates: bool = False) -> DataFrame:
    """(start_pos, seq, cnt) from aligned reads (qname, start_pos, seq): mates of a name merged, single reads as they are.

    A name of three reads or more is an error that names it.  ``with_mates`` counts the reads of pairs by themselves, too,
    as the original table does."""
    named = named_mates(reads)
    sure = F.when(F.col("n") > 2, F.raise_error(F.concat(F.lit("more than two reads named "), F.col("qname"))).cast("int")).otherwise(F.col("start_1"))
    named = named.withColumn("start_1", sure)
    merged = merged_mates(named.where(F.col("n") != 1).select("start_1", "seq_1", "start_2", "seq_2", F.lit(1).cast("long").alias("cnt")))
    single = named.where("n = 1").select(F.col("start_1").alias("start_pos"), F.translate("seq_1", "N", "-").alias("seq"), F.lit(1).cast("long").alias("cnt"))
    out = merged.unionByName(single)
    if with_mates:
        paired = named.where("n = 2")
        for side in "12":
            out = out.unionByName(paired.select(F.col(f"start_{side}").alias("start_pos"), F.translate(f"seq_{side}", "N", "-").alias("seq"), F.lit(1).cast("long").alias("cnt")))
    return out.groupBy("start_pos", "seq").agg(F.sum("cnt").alias("cnt"))


def gap_bounds(reads: DataFrame) -> DataFrame:
    """First and last gap of each read, 0-based; -1 without one."""
    first = F.instr("seq", ".") - 1
    last = F.when(first >= 0, F.length("seq") - F.instr(F.reverse("seq"), ".")).otherwise(-1)
    return reads.select("start_pos", "seq", first.alias("dot_start"), last.alias("dot_end"))


def raw_read_filter(reads: DataFrame, fixed_places: DataFrame) -> DataFrame:
    """Reads without a base that disagrees with ``fixed_places`` (pos, base)."""
    bad = explode_bases(reads).join(fixed_places.withColumnRenamed("base", "agreed"), "pos").where("base <> '.' and base <> agreed").select("start_pos", "seq").distinct()
    return reads.join(bad, ["start_pos", "seq"], "left_anti")


def majority(votes: DataFrame, keys: list[str], order: str = ENTROPY_ORDER) -> DataFrame:
    """Of (keys, base, n) the base with the most votes; ties go to the first in ``order``."""
    best = F.max_by("base", F.struct(F.col("n"), (-order_rank("base", order)).alias("r")))
    return votes.groupBy(*keys, "base").agg(F.sum("n").alias("n")).groupBy(*keys).agg(best.alias("base"))
