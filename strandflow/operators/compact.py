"""Compact coordinates: reads and haplotypes projected on the variant sites (``variants``: vi, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import assembled, explode_bases, joined


def compact_reads(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """(start_pos, seq, cnt, cstart, cend, cseq): each read's bases at variant sites, first to last site inclusive.

    A range join, done as an equi-join of the exploded places with the sites."""
    b = explode_bases(reads).join(variants.select("vi", "pos"), "pos")
    return b.groupBy("start_pos", "seq", "cnt").agg(F.min("vi").alias("cstart"), F.max("vi").alias("cend"), joined("vi", "base").alias("cseq"))


def compact_range(reads: DataFrame, variants: DataFrame, compat: bool = False) -> DataFrame:
    """(start_pos, seq, cstart, cend) of each read, null where it covers no site.

    ``compat`` leaves out a site on the last base and the first site of all, as the original range search does."""
    inside = explode_bases(reads).join(variants.select("vi", "pos"), "pos")
    if compat:
        inside = inside.where((F.col("off") < F.length("seq") - 1) & (F.col("vi") > 0))
    found = inside.groupBy("start_pos", "seq").agg(F.min("vi").alias("cstart"), F.max("vi").alias("cend"))
    return reads.select("start_pos", "seq").join(found, ["start_pos", "seq"], "left")


def compact_dedup(compacted: DataFrame) -> DataFrame:
    """Compact reads of equal start and sequence with the sum of their counts."""
    return compacted.groupBy("cstart", "cend", "cseq").agg(F.sum("cnt").alias("cnt"))


def split_reads(compacted: DataFrame) -> DataFrame:
    """Compact reads cut at their first gap into two parts at most, without gaps at their ends; equal parts are summed."""
    lead = F.length("cseq") - F.length(F.ltrim(F.translate("cseq", ".", " ")))
    own = compacted.withColumns({"s": F.col("cstart") + lead, "body": F.regexp_replace("cseq", r"^\.+|\.+$", "")}).where("body <> ''")
    left = F.regexp_extract("body", r"^[^.]+", 0)
    right = F.regexp_extract("body", r"^[^.]+\.+(.*)$", 1)
    right_at = F.col("s") + F.length("body") - F.length(right)
    parts = F.filter(F.array(F.struct(F.col("s").alias("cstart"), left.alias("cseq")), F.struct(right_at.alias("cstart"), right.alias("cseq"))), lambda x: x["cseq"] != "")
    out = own.select(F.explode(parts).alias("p"), "cnt").select(F.col("p.cstart").alias("cstart"), (F.col("p.cstart") + F.length("p.cseq") - 1).alias("cend"), F.col("p.cseq").alias("cseq"), "cnt")
    return compact_dedup(out)


def region_reads(compacted: DataFrame, b1: int, b2: int, least: int) -> DataFrame:
    """Compact reads that overlap [b1, b2) in ``least`` sites or more, with the overlap."""
    size = b2 - b1 - F.greatest(F.lit(0), F.col("cstart") - b1) - F.greatest(F.lit(0), b2 - (F.col("cstart") + F.length("cseq")))
    return compacted.withColumn("overlap", size).where(F.col("overlap") >= least)


def compact_haplotypes(haplotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """(hap_id, cseq): haplotypes (hap_id, seq from genome place 0) at the sites."""
    b = explode_bases(haplotypes.select("hap_id", "seq", F.lit(1).alias("start_pos")))
    return assembled(b.join(variants.select("vi", "pos"), "pos"), ["hap_id"], "vi", "base", "cseq")


def asof_variant(places: DataFrame, variants: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(x, vi) of each raw place: the first site at or after it, else the last site; null without sites.

    Distinct places and sites meet in ranges of ``width`` places, where each place takes the next site by a window; one that
    has none in its range takes the first of a later range.  Nothing but one row a range is seen as a whole."""
    known = places.select("x").distinct()
    both = known.select(F.col("x").alias("at"), F.lit(None).cast("int").alias("vi"), F.lit(True).alias("asked"))
    both = both.unionByName(variants.select(F.col("pos").alias("at"), F.col("vi").cast("int").alias("vi"), F.lit(False).alias("asked"))).withColumn("range", F.floor(F.col("at") / width))
    edge = both.groupBy("range").agg(F.min("vi").alias("first"), F.max("vi").alias("last"))  # sites are numbered by place
    later = F.min("first").over(Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing))
    end = F.max("last").over(Window.partitionBy())
    edge = edge.select("range", later.alias("later"), end.alias("end"))
    following = F.first("vi", ignorenulls=True).over(Window.partitionBy("range").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("next", following).where("asked").join(edge, "range").select(F.col("at").alias("x"), F.coalesce("next", "later", "end").alias("vi"))
    return places.select("x").join(found, "x", "left")


def raw_lineage(fixed: DataFrame, compacted: DataFrame) -> DataFrame:
    """(cstart, cseq, start_pos, seq): the raw reads behind each compact read, without those that correction changed.

    ``fixed``: corrected reads with their raw sequence; ``compacted``: compact reads of the corrected ones."""
    untouched = fixed.where(~F.col("changed")).select("start_pos", "seq")
    return compacted.select("start_pos", "seq", "cstart", "cseq").join(untouched, ["start_pos", "seq"]).select("cstart", "cseq", "start_pos", "seq")
