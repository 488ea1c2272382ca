"""Windows of the genome, clustering of their reads by a Dirichlet-process mixture, and majority votes across windows.

Class assignments: (window_id, read_id, class_id); the sampler runs in one task a window, or in several for one of many reads."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import CLUSTER_ORDER, assembled, chars, explode_bases, r9
from ..functions.tables import staged
from ..sources.stages import StageStore
from .parts import assigned_in_parts
from .pileup import majority
from .sampling import BURN_IN, SWEEPS, SYMBOLS, TINY, sample_window

#: Fixed value: inside share of a window's read.
INSIDE = 0.75
#: Reads of a window that one task samples; a window of more is sampled in parts, which meet after this many sweeps.
PART_READS, SYNC = 20_000, 10


def window_grid(spark: SparkSession, first: int, last: int, length: int, stride: int) -> DataFrame:
    """(window_id, w_start, w_end): windows of ``length`` places from ``first``, ``stride`` apart, that begin at or before ``last``."""
    starts = spark.range(1, numPartitions=1).select(F.posexplode(F.sequence(F.lit(first), F.lit(last), F.lit(stride))).alias("window_id", "w_start"))
    return starts.select("window_id", "w_start", (F.col("w_start") + length).alias("w_end"))


def windows_over(reads: DataFrame, length: int, stride: int) -> DataFrame:
    """``window_grid`` from the first place where a read begins to the last."""
    ends = reads.agg(F.min("start_pos").alias("first"), F.max("start_pos").alias("last")).where("first is not null")
    starts = ends.select(F.posexplode(F.sequence("first", "last", F.lit(stride))).alias("window_id", "w_start"))
    return starts.select("window_id", "w_start", (F.col("w_start") + length).alias("w_end"))


def window_membership(reads: DataFrame, windows: DataFrame, inside: float = INSIDE, width: int = 256) -> DataFrame:
    """(window_id, and the columns of ``reads``) of reads that lie in a window with more than this share of their length.

    Reads and windows meet by equal bins of ``width`` places, and by ``contig`` where both have it; a pair is judged in the
    first bin that both reach, so it comes once.  An empty read is in no window."""
    n = F.length("seq")
    part = n - F.greatest(F.lit(0), F.col("w_start") - F.col("start_pos")) - F.greatest(F.lit(0), F.col("start_pos") + n - F.col("w_end"))
    first, last = F.floor(F.col("start_pos") / width), F.floor((F.col("start_pos") + F.greatest(n, F.lit(1)) - 1) / width)
    own = reads.withColumns({"__first": first, "__bin": F.explode(F.sequence(first, last))})
    w_first, w_last = F.floor(F.col("w_start") / width), F.floor((F.col("w_end") - 1) / width)
    grid = windows.withColumns({"__w_first": w_first, "__bin": F.explode(F.sequence(w_first, F.greatest(w_first, w_last)))})
    keys = ["__bin", *(["contig"] if "contig" in reads.columns and "contig" in windows.columns else [])]
    joined = own.join(grid, keys).where(F.col("__bin") == F.greatest("__first", "__w_first"))
    return joined.where(part / F.nullif(n, F.lit(0)) > inside).select("window_id", *reads.columns)


def window_sites(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """(window_id, f_start, f_end): first and last variant site of each window; places from w_start to w_end - 1, 1-based."""
    inside = windows.join(variants, (F.col("pos") + 1 >= F.col("w_start")) & (F.col("pos") + 1 < F.col("w_end")))
    return inside.groupBy("window_id", "w_start", "w_end").agg(F.min("vi").alias("f_start"), F.max("vi").alias("f_end"))


def site_bases(members: DataFrame, variants: DataFrame, sites: DataFrame) -> DataFrame:
    """(window_id, read_id, cnt, vi, base): the members' known bases at their window's sites."""
    b = explode_bases(members).join(variants.select("vi", "pos"), "pos").where("base <> '.'")
    return b.join(sites, "window_id").where("vi between f_start and f_end").select("window_id", "read_id", "cnt", "vi", "base")


def class_consensus(bases: DataFrame, assigned: DataFrame) -> DataFrame:
    """(window_id, class_id, vi, base): the majority base of each class; ties go to the first of A, C, T, G, -."""
    votes = bases.join(assigned, ["window_id", "read_id"]).groupBy("window_id", "class_id", "vi", "base").agg(F.sum("cnt").alias("n"))
    return majority(votes, ["window_id", "class_id", "vi"], CLUSTER_ORDER)


def class_haplotypes(consensus: DataFrame, sites: DataFrame) -> DataFrame:
    """(window_id, class_id, haplotype): one symbol per site of the window, ``*`` where no read of the class is."""
    every = sites.select("window_id", F.explode(F.sequence("f_start", "f_end")).alias("vi")).join(consensus.select("window_id", "class_id").distinct(), "window_id")
    full = every.join(consensus, ["window_id", "class_id", "vi"], "left").select("window_id", "class_id", "vi", F.coalesce("base", F.lit("*")).alias("base"))
    return assembled(full, ["window_id", "class_id"], "vi", "base", "haplotype")


def class_merge(haplotypes: DataFrame, assigned: DataFrame, members: DataFrame) -> DataFrame:
    """(window_id, haplotype, class_id, cnt): classes of equal haplotype become the least of them."""
    sizes = assigned.join(members.select("window_id", "read_id", "cnt"), ["window_id", "read_id"]).groupBy("window_id", "class_id").agg(F.sum("cnt").alias("cnt"))
    return haplotypes.join(sizes, ["window_id", "class_id"]).groupBy("window_id", "haplotype").agg(F.min("class_id").alias("class_id"), F.sum("cnt").alias("cnt"))


def matches(bases: DataFrame, assigned: DataFrame, consensus: DataFrame) -> DataFrame:
    """(window_id, read_id, class_id, m, d): equal and different bases of each read and its class."""
    own = bases.join(assigned, ["window_id", "read_id"]).join(consensus.withColumnRenamed("base", "h"), ["window_id", "class_id", "vi"])
    return own.groupBy("window_id", "read_id", "class_id").agg(F.sum(F.when(F.col("base") == F.col("h"), 1).otherwise(0)).alias("m"), F.sum(F.when(F.col("base") != F.col("h"), 1).otherwise(0)).alias("d"))


def _share(match: Column, n: Column) -> Column:
    length, sites = F.col("w_end") - F.col("w_start"), F.col("f_end") - F.col("f_start") + 1
    return r9((match + (length - sites) * n) / (length * n))


def theta_update(matched: DataFrame, sites: DataFrame) -> DataFrame:
    """(window_id, theta): share of places of the window where reads equal their class, each read once; places that
    are no site count as equal."""
    return matched.join(sites, "window_id").groupBy("window_id", "w_start", "w_end", "f_start", "f_end").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n")).select("window_id", _share(F.col("m"), F.col("n")).alias("theta"))


def gamma_update(consensus: DataFrame, sites: DataFrame, reference: DataFrame) -> DataFrame:
    """(window_id, gamma): likewise share of places where classes equal the reference (vi, base)."""
    same = consensus.join(reference.withColumnRenamed("base", "r"), "vi").withColumn("same", F.when(F.col("base") == F.col("r"), 1).otherwise(0))
    n = same.groupBy("window_id").agg(F.sum("same").alias("m"), F.countDistinct("class_id").alias("n"))
    return n.join(sites, "window_id").select("window_id", _share(F.col("m"), F.col("n")).alias("gamma"))


def class_logweight(bases: DataFrame, members: DataFrame, assigned: DataFrame, consensus: DataFrame, theta: float) -> DataFrame:
    """(window_id, read_id, class_id, logweight) of every read and existing class, the read itself taken out of its own."""
    theta = min(max(theta, TINY), 1 - TINY)
    sizes = assigned.join(members.select("window_id", "read_id", "cnt"), ["window_id", "read_id"]).groupBy("window_id", "class_id").agg(F.sum("cnt").alias("size"))
    own = assigned.withColumnRenamed("class_id", "own")
    pairs = members.select("window_id", "read_id", "cnt").join(own, ["window_id", "read_id"]).join(sizes, "window_id")
    left = F.col("size") - F.when(F.col("own") == F.col("class_id"), F.col("cnt")).otherwise(0)
    seen = bases.join(consensus.withColumnRenamed("base", "h"), ["window_id", "vi"]).groupBy("window_id", "read_id", "class_id").agg(F.sum(F.when(F.col("base") == F.col("h"), 1).otherwise(0)).alias("m"), F.sum(F.when(F.col("base") != F.col("h"), 1).otherwise(0)).alias("d"))
    w = F.log(left) + F.coalesce("m", F.lit(0)) * log(theta) + F.coalesce("d", F.lit(0)) * log((1 - theta) / (SYMBOLS - 1))
    return pairs.withColumn("left", left).where("left > 0").drop("left").join(seen, ["window_id", "read_id", "class_id"], "left").select("window_id", "read_id", "class_id", r9(w).alias("logweight"))


def class_mode(history: DataFrame) -> DataFrame:
    """(window_id, read_id, class_id): each read's most frequent class of a history (…, sweep, class_id); ties go to the
    class met first."""
    n = history.groupBy("window_id", "read_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.min("sweep").alias("first"))
    best = F.row_number().over(Window.partitionBy("window_id", "read_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("r", best).where("r = 1").select("window_id", "read_id", "class_id")


def window_votes(members: DataFrame, variants: DataFrame, assigned: DataFrame, consensus: DataFrame) -> DataFrame:
    """(window_id, start_pos, seq, vi, off, base): what a window says of each base of its reads at variant sites.

    Only bases at sites are made rows: a read's sites are taken from the window's classes, not from its whole sequence."""
    at = members.join(assigned, ["window_id", "read_id"]).join(consensus, ["window_id", "class_id"]).join(variants.select("vi", "pos"), "vi")
    off = F.col("pos") - F.col("start_pos") + 1
    inside = at.withColumn("off", off).where((F.col("off") >= 0) & (F.col("off") < F.length("seq")))
    return inside.where(F.expr("substring(seq, off + 1, 1)") != ".").select("window_id", "start_pos", "seq", "vi", F.col("off").cast("int").alias("off"), "base")


def votes_of(members: DataFrame, variants: DataFrame, assigned: DataFrame, consensus: DataFrame) -> DataFrame:
    """(start_pos, seq, off, base, n): the windows' votes, counted."""
    return window_votes(members, variants, assigned, consensus).groupBy("start_pos", "seq", "off", "base").agg(F.count(F.lit(1)).alias("n"))


def majority_vote(reads: DataFrame, votes: DataFrame) -> DataFrame:
    """(start_pos, seq, cnt, voted_seq): the majority of the windows' votes for each base, the read's own where none votes.

    Votes are few a read; they are put into its sequence as a map, and no sequence is taken apart into rows."""
    best = majority(votes, ["start_pos", "seq", "off"], CLUSTER_ORDER)
    of_read = best.groupBy("start_pos", "seq").agg(F.map_from_entries(F.collect_list(F.struct(F.col("off").cast("int").alias("off"), "base"))).alias("votes"))
    new = F.array_join(F.transform(chars("seq"), lambda b, i: F.coalesce(F.col("votes")[i], b)), "")
    return reads.join(of_read, ["start_pos", "seq"], "left").select("start_pos", "seq", "cnt", F.when(F.col("votes").isNull(), F.col("seq")).otherwise(new).alias("voted_seq"))


def gibbs_assign(bases: DataFrame, members: DataFrame, sites: DataFrame, reference: DataFrame, *, seed: int = 1, sweeps: int = SWEEPS, burn_in: int = BURN_IN, part_reads: int = PART_READS, sync: int = SYNC) -> DataFrame:
    """(window_id, read_id, class_id): the sampler's classes, numbered in the order they arose; seeded by window.

    A window of up to ``part_reads`` reads is one task.  A larger one is swept in parts, see ``parts``: reads are distinct
    (start, sequence) pairs, which sequencing errors add to as coverage grows."""
    ref = {r.vi: r.base for r in reference.collect()}  # one row per site
    bases = bases.select("window_id", "read_id", F.col("cnt").cast("long"), "vi", "base")
    n = bases.groupBy("window_id").agg(F.countDistinct("read_id").alias("n"))
    wide = [r.window_id for r in n.where(F.col("n") > part_reads).select("window_id").collect()]  # one row a window
    own = bases.where(~F.col("window_id").isin(wide)).join(sites, "window_id")  # by window, as the sampler's tasks are

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf.f_start.iloc[0]), int(pdf.f_end.iloc[0])
        ids = np.sort(pdf.read_id.unique())
        codes, cnt = np.full((len(ids), b - a + 1), -1), np.zeros(len(ids))
        at = np.searchsorted(ids, pdf.read_id)
        codes[at, pdf.vi.to_numpy() - a] = [CLUSTER_ORDER.find(x) for x in pdf.base]
        cnt[at] = pdf.cnt
        reference_codes = np.array([CLUSTER_ORDER.find(ref.get(v, "?")) for v in range(a, b + 1)])
        who, _ = sample_window(codes, cnt, reference_codes, int(pdf.w_end.iloc[0] - pdf.w_start.iloc[0]), seed * 1_000_003 + int(pdf.window_id.iloc[0]), sweeps=sweeps, burn_in=burn_in)
        _, names = np.unique(who, return_inverse=True)
        return pd.DataFrame({"window_id": int(pdf.window_id.iloc[0]), "read_id": ids, "class_id": names})

    whole = own.groupBy("window_id").applyInPandas(run, "window_id int, read_id long, class_id int")
    if not wide:
        return whole
    return whole.unionByName(assigned_in_parts(bases.where(F.col("window_id").isin(wide)), sites, ref, seed=seed, part_reads=part_reads, sync=sync, sweeps=sweeps, burn_in=burn_in))


def clustering_votes(reads_with_ids: DataFrame, variants: DataFrame, windows: DataFrame, reference: DataFrame, **sampler) -> DataFrame:
    """(start_pos, seq, cnt, voted_seq): reads corrected by the sampler's classes in all windows."""
    members = window_membership(reads_with_ids, windows)
    sites = window_sites(windows, variants)
    bases = site_bases(members, variants, sites)
    assigned = gibbs_assign(bases, members, sites, reference, **sampler)
    votes = votes_of(members, variants, assigned, class_consensus(bases, assigned))
    return majority_vote(reads_with_ids.drop("read_id"), votes)


VOTES = "window_id int, start_pos int, seq string, off int, base string"


def resumed_votes(store: StageStore, name: str, reads_with_ids: DataFrame, variants: DataFrame, windows: DataFrame, reference: DataFrame, *, windows_a_job: int = 16, **sampler) -> DataFrame:
    """``clustering_votes`` whose windows are finished in the store, a few a job; windows that are there aren't made again."""
    ids = [r.window_id for r in windows.select("window_id").orderBy("window_id").collect()]  # one row a stride of a genome

    def votes(part: list[int]) -> DataFrame:
        own = windows.where(F.col("window_id").isin(part))
        members = staged(window_membership(reads_with_ids, own), "members")
        sites = window_sites(own, variants)
        bases = staged(site_bases(members, variants, sites), "bases")
        assigned = staged(gibbs_assign(bases, members, sites, reference, **sampler), "assigned")
        return window_votes(members, variants, assigned, class_consensus(bases, assigned)).drop("vi")

    every = store.resumed(name, VOTES, "window_id", ids, votes, windows_a_job)
    counted = every.groupBy("start_pos", "seq", "off", "base").agg(F.count(F.lit(1)).alias("n"))
    return majority_vote(reads_with_ids.drop("read_id"), counted)
