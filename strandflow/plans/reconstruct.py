"""From reads to scored haplotypes in one run: the operators of this library one after the other.

Regions are few (halvings of a genome's sites), so the driver goes through their list; reads, paths, sets and fits stay in
Spark, and what several steps read is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import staged
from ..operators import compact, graph, pileup, regress, support


def region_cut(compacted: DataFrame, a: int, b: int) -> DataFrame:
    """(cstart, cend, cseq, cnt) of what compact reads have in the sites [a, b], places counted from a."""
    inside = compacted.where((F.col("cstart") <= b) & (F.col("cend") >= a))
    part = F.expr(f"substring(cseq, greatest({a} - cstart, 0) + 1, least(cend, {b}) - greatest(cstart, {a}) + 1)")
    cut = inside.select((F.greatest("cstart", F.lit(a)) - a).alias("cstart"), (F.least("cend", F.lit(b)) - a).alias("cend"), part.alias("cseq"), "cnt")
    return compact.compact_dedup(cut)


def numbered_by_sequence(haps: DataFrame) -> DataFrame:
    """(hap_id, cseq) of distinct sequences (seq), numbered in their order; haplotypes are capped."""
    return haps.select(F.col("seq").alias("cseq")).distinct().withColumn("hap_id", (F.row_number().over(Window.orderBy("cseq")) - 1).cast("int"))


def reconstruct(reads: DataFrame, *, k: int = graph.K, most_local: int = 1000, most_global: int = 1000, reach: int = support.REACH, overlap: int = support.OVERLAP, equal: int = support.EQUAL, rhos: tuple[float, ...] = regress.RHOS, repeats: int = 100) -> DataFrame:
    """(cseq, h, score): haplotypes over the variant sites of reads (start_pos, seq, cnt), their frequencies and credibility.

    Correction at places of low entropy; regions of at most ``most_local`` paths; in each its paths, pruned until there are
    fewer than ``most_global`` combinations; fits of the combinations over a grid; the haplotypes of the chosen fit with their
    least support against what their frequency lets expect.  Reads without a variant site give no rows."""
    reads = staged(reads, "reads")
    piled = staged(pileup.pileup(reads), "pileup")
    variants = staged(pileup.variant_sites(pileup.site_entropy(piled)), "variants")
    corrected = pileup.after_correction(pileup.corrected_reads(reads, piled))
    compacted = staged(compact.compact_dedup(compact.compact_reads(corrected, variants)), "compact")
    empty = compacted.sparkSession.createDataFrame([], "cseq string, h double, score double")
    n_sites = variants.count()
    if not n_sites:
        return empty
    edges = staged(graph.kmer_edges(compacted, k), "edges")
    pruned = staged(graph.edge_prune(edges), "pruned")
    regions = [(r.first_site, r.last_site) for r in graph.region_split(compacted, 0, n_sites - 1, k=k, most=most_local).orderBy("first_site").collect()]
    starts = staged(graph.region_starts(edges, edges.sparkSession.createDataFrame(regions, "a int, b int"), k), "starts")
    local, matrix, y = [], None, None
    for i, (a, b) in enumerate(regions):
        begin = starts.where((F.col("a") == a) & (F.col("b") == b)).select(F.lit(a).alias("vi"), "node")
        haps = staged(numbered_by_sequence(graph.local_haplotypes(pruned, begin, a, b, k)), "local-haplotypes")
        local.append(haps)
        cut = staged(region_cut(compacted, a, b), "region-reads")
        m = staged(support.match_matrix(cut, haps), "region-matrix")
        parts = m.withColumn("region", F.lit(i)), support.read_fraction(cut, m).withColumn("region", F.lit(i))
        matrix, y = parts if matrix is None else (matrix.unionByName(parts[0]), y.unionByName(parts[1]))
    kept = staged(regress.local_prune(regress.normal_equations(matrix, y), most=most_global), "kept")
    chosen = [haps.join(kept.where(F.col("region") == i).select("hap_id"), "hap_id", "left_semi").select(F.col("cseq").alias("seq")) for i, haps in enumerate(local)]
    haps = staged(numbered_by_sequence(graph.global_haplotypes(chosen, most=most_global)), "haplotypes")
    if haps.isEmpty():
        return empty
    m = staged(support.match_matrix(compacted, haps), "matrix")
    fits = staged(regress.fit_grid(m, staged(support.read_fraction(compacted, m), "fractions"), rhos=rhos, repeats=repeats), "fits")
    found = staged(regress.solution(fits, haps), "solution")
    own = found.select("hap_id", "cseq")
    seen = staged(support.supporting(compacted, own, 0, n_sites, reach=reach, overlap=overlap, equal=equal), "support")
    full = support.full_matrix(support.support_matrix(seen), own, reach, n_sites - reach)
    scores = support.credibility_score(full, support.total_extension(seen), found.select("hap_id", "h"))
    return found.join(scores, "hap_id", "left").select("cseq", "h", "score")
