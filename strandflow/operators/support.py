"""Which compact reads fit which haplotypes, where they support them, and what follows for haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import chars, r9
from ..functions.tables import paired, sized, staged

#: Sites a read must reach past a site on either side, least overlap and least equal bases of a
#: supporting read; least share of the mean support; the fall of support that a haplotype does not survive.
REACH, OVERLAP, EQUAL, MEAN_SHARE, FALL = 5, 11, 5, 0.01, 0.99


def _pairs() -> Column:
    """Read base (r) and haplotype base (h) at each site that both cover; haplotypes begin at site 0."""
    hap = F.slice(chars("hseq"), F.col("cstart") + 1, F.length("cseq"))
    return F.filter(F.arrays_zip(chars("cseq").alias("r"), hap.alias("h")), lambda x: x["h"].isNotNull() & x["r"].isNotNull())


def compact_match(compacted: DataFrame, haps: DataFrame) -> DataFrame:
    """(cstart, cseq, cnt, hap_id, n_match, n_mismatch): equal and different bases; gaps are neither.

    ``haps`` (hap_id, cseq) is broadcast, or met in parts where it is large."""
    h = haps.select("hap_id", F.col("cseq").alias("hseq"))
    both = paired(compacted.select("cstart", "cseq", "cnt"), h).withColumn("p", _pairs())
    match = F.size(F.filter("p", lambda x: x["r"] == x["h"]))
    differ = F.size(F.filter("p", lambda x: (x["r"] != x["h"]) & (x["r"] != ".")))
    return both.select("cstart", "cseq", "cnt", "hap_id", match.alias("n_match"), differ.alias("n_mismatch"), F.size("p").alias("n_compared"))


#: Haplotypes of one number of the bitmap index.
BITS = 64


def numbered(haps: DataFrame) -> DataFrame:
    """(hap_id, n_sites, word, bit): the place of each haplotype in the bitmaps, in order of id; haplotypes are capped."""
    place = F.row_number().over(Window.orderBy("hap_id")) - 1
    return haps.select("hap_id", "cseq", F.length("cseq").alias("n_sites"), place.alias("at")).select("hap_id", "cseq", "n_sites", F.floor(F.col("at") / BITS).cast("int").alias("word"), (F.col("at") % BITS).cast("int").alias("bit"))


def bitmap_index(places: DataFrame, end: int) -> DataFrame:
    """(vi, base, word, bits): the haplotypes (``numbered``) that have the base at a site below ``end``, a bit each.

    A haplotype that ends before a site differs from no read there, so it has its bit under every base.  Base ``*`` holds
    those alone, for bases that no haplotype has."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    own = places.select("word", bit.alias("b"), F.posexplode(chars("cseq")).alias("vi", "base")).groupBy("vi", "base", "word").agg(F.bit_or("b").alias("bits"))
    past = places.where(F.col("n_sites") < end).select("word", bit.alias("b"), F.explode(F.sequence(F.col("n_sites"), F.lit(end - 1))).alias("vi")).groupBy("vi", "word").agg(F.bit_or("b").alias("past"))
    both = own.join(past, ["vi", "word"], "left").select("vi", "base", "word", F.col("bits").bitwiseOR(F.coalesce("past", F.lit(0).cast("long"))).alias("bits"))
    # a base that one word of haplotypes has at a site needs the ended haplotypes of the other words, too
    seen = own.select("vi", "base").distinct().join(past, "vi").join(own.select("vi", "base", "word"), ["vi", "base", "word"], "left_anti").select("vi", "base", "word", F.col("past").alias("bits"))
    return both.unionByName(seen).unionByName(past.select("vi", F.lit("*").alias("base"), "word", F.col("past").alias("bits")))


def fitting(compacted: DataFrame, haps: DataFrame) -> DataFrame:
    """(cstart, cseq, hap_id, n_match, n_compared) of reads and haplotypes (hap_id, cseq) that differ nowhere.

    A read's haplotypes are the AND of the bitmaps of its known bases, so that reads meet the index (sites x bases) by
    equi-joins, and haplotypes only where they fit.  A read without known bases within any haplotype fits all.
    ``n_match``: known sites that both cover; ``n_compared``: these and the read's gaps."""
    places = staged(numbered(haps), "numbered")
    most = places.agg(F.coalesce(F.max("n_sites"), F.lit(0)).alias("end"), F.coalesce(F.max("word"), F.lit(-1)).alias("word")).first()
    index = bitmap_index(places, most.end)
    reads = compacted.select("cstart", "cseq").distinct()
    at = reads.select("cstart", "cseq", F.posexplode(chars("cseq")).alias("off", "base")).withColumn("vi", F.col("cstart") + F.col("off")).where((F.col("base") != ".") & (F.col("vi") < most.end))
    has = index.select("vi", "base").distinct().withColumn("known", F.lit(True))
    # rows of the index for the base, or else for none
    at = at.join(has, ["vi", "base"], "left").select("cstart", "cseq", "vi", F.when(F.col("known"), F.col("base")).otherwise("*").alias("base"))
    n_known = F.length(F.translate(F.substring("cseq", F.lit(1), F.greatest(F.lit(most.end) - F.col("cstart"), F.lit(0))), ".", ""))
    needed = reads.select("cstart", "cseq", n_known.alias("n_known"))
    met = at.join(index, ["vi", "base"]).groupBy("cstart", "cseq", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    of_read = met.join(needed, ["cstart", "cseq"]).where("n = n_known and bits <> 0").select("cstart", "cseq", "word", "bits")
    every = F.explode(F.sequence(F.lit(0), F.lit(most.word))) if most.word >= 0 else F.explode(F.array().cast("array<int>"))
    free = needed.where("n_known = 0").select("cstart", "cseq", every.alias("word"), F.lit(-1).cast("long").alias("bits"))  # bits of no haplotype find none
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)).alias("bit")
    pairs = of_read.unionByName(free).select("cstart", "cseq", "word", bit).join(places.select("word", "bit", "hap_id", "n_sites"), ["word", "bit"])
    inside = F.expr("substring(cseq, 1, greatest(n_sites - cstart, 0))")
    return pairs.select("cstart", "cseq", "hap_id", F.length(F.translate(inside, ".", "")).alias("n_match"), F.length(inside).alias("n_compared"))


def match_matrix(compacted: DataFrame, haps: DataFrame, least: int = 2) -> DataFrame:
    """(cstart, cseq, hap_id) of reads without a difference on ``least`` sites or more, gaps counted as sites."""
    return fitting(compacted, haps).where(F.col("n_compared") >= least).select("cstart", "cseq", "hap_id")


def supporting(compacted: DataFrame, haps: DataFrame, b1: int, b2: int, *, reach: int = REACH, overlap: int = OVERLAP, equal: int = EQUAL) -> DataFrame:
    """(cstart, cseq, cnt, hap_id, p): reads that carry a haplotype over site p of the region [b1, b2).

    Fit is decided once per read and haplotype; only then sites are listed."""
    end = F.col("cstart") + F.length("cseq")
    size = F.least(end, F.lit(b2)) - F.greatest("cstart", F.lit(b1))
    wide = compacted.where(size >= overlap)
    fit = wide.select("cstart", "cseq", "cnt").join(fitting(wide, haps).where(F.col("n_match") >= equal).select("cstart", "cseq", "hap_id"), ["cstart", "cseq"])
    first, last = F.greatest(F.col("cstart") + reach, F.lit(b1)), F.least(end - 1 - reach, F.lit(b2 - 1))
    at = fit.where(first <= last).select("cstart", "cseq", "cnt", "hap_id", F.explode(F.sequence(first, last)).alias("p"))
    known = lambda x: F.translate(x, ".", "") != ""
    left, right = F.expr("substring(cseq, 1, p - cstart)"), F.expr("substring(cseq, p - cstart + 2)")
    here = F.expr("substring(cseq, p - cstart + 1, 1)") != "."
    return at.where(here | (known(left) & known(right)))


def support_matrix(support: DataFrame) -> DataFrame:
    """(hap_id, p, support): the reads behind each haplotype at each site."""
    return support.groupBy("hap_id", "p").agg(F.sum("cnt").alias("support"))


def total_extension(support: DataFrame) -> DataFrame:
    """(p, total): reads that support any haplotype at a site, each once."""
    return support.select("cstart", "cseq", "cnt", "p").distinct().groupBy("p").agg(F.sum("cnt").alias("total"))


def full_matrix(matrix: DataFrame, haps: DataFrame, b1: int, b2: int) -> DataFrame:
    """The support matrix with its zeros: all haplotypes at all sites."""
    sites = haps.sparkSession.range(b1, b2).select(F.col("id").cast("int").alias("p"))
    every = paired(sites, haps.select("hap_id"))
    return every.join(matrix, ["hap_id", "p"], "left").select("hap_id", "p", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def local_consistency(full: DataFrame, share: float = MEAN_SHARE) -> DataFrame:
    """(hap_id) that have at least this share of the mean support at every site."""
    low = full.withColumn("mean", F.avg("support").over(Window.partitionBy("p"))).where(F.col("support") < share * F.col("mean")).select("hap_id").distinct()
    return full.select("hap_id").distinct().join(low, "hap_id", "left_anti")


def flow_consistency(full: DataFrame, fall: float = FALL, least: int = 2) -> DataFrame:
    """(hap_id) whose support never is below ``least`` and never falls by more than ``fall`` against the site before,
    the best haplotype there, or the site after."""
    by = Window.partitionBy("hap_id").orderBy("p")
    top = F.max("support").over(Window.partitionBy("p"))
    loss = lambda other: (F.col("support") - other) / F.nullif(other, F.lit(0)) < -fall
    seen = full.withColumns({"before": F.lag("support").over(by), "after": F.lead("support").over(by), "top": top})
    inner = F.col("before").isNotNull()
    bad = seen.where((F.col("support") < least) | F.coalesce(loss(F.col("before")), F.lit(False)) | (inner & (F.coalesce(loss(F.col("top")), F.lit(False)) | F.coalesce(loss(F.col("after")), F.lit(False)))))
    return full.select("hap_id").distinct().join(bad.select("hap_id").distinct(), "hap_id", "left_anti")


def read_fraction(compacted: DataFrame, matrix: DataFrame) -> DataFrame:
    """(cstart, cseq, y): the read's share of all matched reads of equal range."""
    own = compacted.join(matrix.select("cstart", "cseq").distinct(), ["cstart", "cseq"], "left_semi")
    return own.select("cstart", "cseq", r9(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("cstart", "cend"))).alias("y"))


def fit_cost(matrix: DataFrame, y: DataFrame, h: DataFrame) -> DataFrame:
    """One row: the squared distance of y from the matrix times ``h`` (hap_id, h)."""
    fitted = matrix.join(sized(h), "hap_id").groupBy("cstart", "cseq").agg(F.sum("h").alias("yhat"))
    d = F.col("y") - F.coalesce("yhat", F.lit(0.0))
    return y.join(fitted, ["cstart", "cseq"], "left").agg(F.round(F.sum(d * d), 6).alias("cost"))


def credibility_score(full: DataFrame, totals: DataFrame, h: DataFrame) -> DataFrame:
    """(hap_id, score): least 1 + (seen - expected) / expected over sites with less support than frequency x total, at most 1."""
    all_sites = full.join(totals, "p", "left").join(sized(h), "hap_id")
    expected = F.col("h") * F.coalesce("total", F.lit(0))
    part = F.when(F.col("support") < expected, 1 + (F.col("support") - expected) / F.nullif(expected, F.lit(0.0))).otherwise(1.0)
    return all_sites.groupBy("hap_id").agg(F.round(F.least(F.lit(1.0), F.min(part)), 9).alias("score"))


def bucket_best(fits: DataFrame) -> DataFrame:
    """Of each number of haplotypes (k) the fit of least cost; ties go to the least id."""
    best = F.row_number().over(Window.partitionBy("k").orderBy("cost", "fit_id"))
    return fits.withColumn("r", best).where("r = 1").drop("r")


def elbow_pick(best: DataFrame, share: float = 0.9, before: bool = False) -> DataFrame:
    """The first bucket whose cost is above ``share`` of the one before it - or, with ``before``, that one; the last if none."""
    w = Window.orderBy("k")  # one row per number of haplotypes
    seen = best.select("k", "fit_id", "cost", F.lag("cost").over(w).alias("last"), F.lag("k").over(w).alias("last_k"))
    hit = seen.agg(F.min(F.when(F.col("cost") > share * F.col("last"), F.col("last_k" if before else "k"))).alias("hit"), F.max("k").alias("end"))
    return best.crossJoin(F.broadcast(hit)).where("k = coalesce(hit, end)").select("k", "fit_id", "cost")  # one row
