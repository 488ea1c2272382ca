"""All queries of the engine over the driver's tables: reads are derived from ``lineitem`` (``sources.reads``).

The genome of the derived reads is short, so k, reach and overlap are smaller than the operators' defaults."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import assembled, explode_bases
from ..functions.tables import staged
from ..operators import cluster, compact, evaluate, graph, pileup, regress, simulate, support
from ..sources import reads as source
from .reconstruct import reconstruct

K, B1, B2 = 4, 0, 20
SUPPORT = {"reach": 2, "overlap": 5, "equal": 4}
WINDOW = {"length": 50, "stride": 20}
REGION = (20, 100)
THETA = 0.98
SHARES = {0: 0.6, 1: 0.3, 2: 0.1}


class Tables:
    """The frames that queries share, each built when first asked for; those that several others read are written first,
    so that a query reads the input once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def counted(self) -> DataFrame:
        """The reads, for what reads them once."""
        return source.counted_reads(self.table("lineitem"))

    @cached_property
    def reads(self) -> DataFrame:
        return staged(self.counted, "reads")

    @cached_property
    def piled(self) -> DataFrame:
        return staged(pileup.pileup(self.reads), "pileup")  # one row per place of the genome

    @cached_property
    def entropy(self) -> DataFrame:
        return pileup.site_entropy(self.piled)

    @cached_property
    def variants(self) -> DataFrame:
        return pileup.variant_sites(self.entropy)

    @cached_property
    def fixed(self) -> DataFrame:
        return pileup.corrected_reads(self.reads, self.piled)

    @cached_property
    def corrected(self) -> DataFrame:
        return staged(pileup.after_correction(self.fixed), "corrected")

    @cached_property
    def compacted(self) -> DataFrame:
        return staged(compact.compact_dedup(compact.compact_reads(self.corrected, self.variants)), "compact")

    @cached_property
    def haps(self) -> DataFrame:
        return source.true_haplotypes(self.spark)

    @cached_property
    def compact_haps(self) -> DataFrame:
        return compact.compact_haplotypes(self.haps, self.variants)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.kmer_edges(self.compacted, K)

    @cached_property
    def support(self) -> DataFrame:
        return support.supporting(self.compacted, self.compact_haps, B1, B2, **SUPPORT)

    @cached_property
    def full(self) -> DataFrame:
        return support.full_matrix(support.support_matrix(self.support), self.compact_haps, B1 + 2, B2 - 2)

    @cached_property
    def matrix(self) -> DataFrame:
        return staged(support.match_matrix(self.compacted, self.compact_haps), "matrix")

    @cached_property
    def y(self) -> DataFrame:
        return support.read_fraction(self.compacted, self.matrix)

    @cached_property
    def shares(self) -> DataFrame:
        return self.spark.createDataFrame(list(SHARES.items()), "hap_id int, h double")

    @cached_property
    def nearest(self) -> DataFrame:
        return staged(evaluate.nearest_haplotype(evaluate.read_hap_distance(self.reads, self.haps)), "nearest")

    @cached_property
    def windows(self) -> DataFrame:
        return cluster.windows_over(self.reads, **WINDOW)

    @cached_property
    def members(self) -> DataFrame:
        return staged(cluster.window_membership(pileup.read_ids(self.reads), self.windows), "members")

    @cached_property
    def sites(self) -> DataFrame:
        return cluster.window_sites(self.windows, self.variants)

    @cached_property
    def bases(self) -> DataFrame:
        return staged(cluster.site_bases(self.members, self.variants, self.sites), "bases")

    @cached_property
    def assigned(self) -> DataFrame:
        """Classes of a frozen state: the nearest haplotype, and a class of their own for every seventh read."""
        own = self.members.join(self.nearest.select("start_pos", "seq", "hap_id"), ["start_pos", "seq"])
        return staged(own.select("window_id", "read_id", F.when(F.col("read_id") % 7 == 0, 3).otherwise(F.col("hap_id")).alias("class_id")), "assigned")

    @cached_property
    def consensus(self) -> DataFrame:
        return cluster.class_consensus(self.bases, self.assigned)

    @cached_property
    def reference(self) -> DataFrame:
        """(vi, base) of the first haplotype."""
        b = explode_bases(self.haps.where("hap_id = 0").select("seq", F.lit(1).alias("start_pos")))
        return b.join(self.variants.select("vi", "pos"), "pos").select("vi", "base")

    @cached_property
    def fits(self) -> DataFrame:
        """Fits with a number of haplotypes and a cost, derived from customers."""
        key = F.col("c_custkey")
        k = (1 + key % 9).cast("int")
        return self.table("customer").select(key.alias("fit_id"), k.alias("k"), F.round((key * 7919 % 10007) / 10007.0 / 10 + 2.0 / k, 9).alias("cost"))

    @cached_property
    def fragments(self) -> DataFrame:
        """Reads as mates of a name, some single."""
        name = F.concat_ws(":", F.col("start_pos").cast("string"), "seq")
        first = F.struct(F.col("start_pos").alias("start_pos"), F.expr("substring(seq, 1, 20)").alias("seq"))
        second = F.struct((F.col("start_pos") + 10 + F.col("start_pos") % 21).alias("start_pos"), F.translate(F.expr("substring(seq, 11 + start_pos % 21, 20)"), ".", "N").alias("seq"))
        mates = F.when(F.col("start_pos") % 10 == 0, F.array(first)).otherwise(F.array(second, first))
        return pileup.fragments(self.reads.select(name.alias("qname"), F.explode(mates).alias("x")).select("qname", "x.*"))

    @cached_property
    def nearest_of_fragments(self) -> DataFrame:
        return evaluate.nearest_haplotype(evaluate.read_hap_distance(self.fragments, self.haps))

    def halves(self) -> list[DataFrame]:
        """Distinct local haplotypes of the two halves of the sites."""
        return [self.compact_haps.select(F.expr(f"substring(cseq, {a}, 10)").alias("seq")).distinct() for a in (1, 11)]


def read_scan(t: Tables) -> DataFrame:
    return source.raw_reads(t.table("lineitem"))


def read_dedup(t: Tables) -> DataFrame:
    return t.counted


def read_ids(t: Tables) -> DataFrame:
    return pileup.read_ids(t.reads)


def read_bases(t: Tables) -> DataFrame:
    return explode_bases(t.counted)


def site_mode(t: Tables) -> DataFrame:
    return pileup.site_mode(t.piled).select("pos", "mode", "depth")


def entropy_corrected_reads(t: Tables) -> DataFrame:
    return t.fixed.drop("changed")


def correction_flags(t: Tables) -> DataFrame:
    return t.fixed.groupBy("start_pos", "seq").agg(F.bool_or("changed").alias("changed"))


def position_diff(t: Tables) -> DataFrame:
    return pileup.position_diff(pileup.variant_sites(t.entropy, 0.005), pileup.variant_sites_post(t.corrected))


def raw_read_filter(t: Tables) -> DataFrame:
    places = position_diff(t).join(pileup.shared_bases(t.corrected, source.GENOME), "pos")
    return pileup.raw_read_filter(t.reads, places.where("base is not null and base <> '_'"))


def mate_merge(t: Tables) -> DataFrame:
    shift = 10 + F.col("start_pos") % 21
    first = F.expr("substring(seq, 1, 20)")
    pairs = t.reads.select(F.col("start_pos").alias("start_1"), first.alias("seq_1"), (F.col("start_pos") + shift).alias("start_2"), F.translate(F.expr("substring(seq, 11 + start_pos % 21, 20)"), ".", "N").alias("seq_2"), "cnt")
    merged = pileup.merged_mates(pairs)
    single = pairs.select(F.col("start_1").alias("start_pos"), F.col("seq_1").alias("seq"), "cnt").where("start_pos % 10 = 0")
    return merged.unionByName(single).groupBy("start_pos", "seq").agg(F.sum("cnt").alias("cnt"))


def diversity(t: Tables) -> DataFrame:
    """Of the haplotypes that the graph of the reads has."""
    number = (F.row_number().over(Window.orderBy("seq")) - 1).alias("hap_id")  # local haplotypes are capped
    return evaluate.diversity(local_haplotypes(t).select(number, "seq"))


def simulate_variants(t: Tables) -> DataFrame:
    """Variants of the genome that most reads have at each place."""
    modes = pileup.site_mode(t.piled).select(F.lit(0).alias("hap_id"), "pos", F.col("mode").alias("base"))
    return simulate.simulate_variants(assembled(modes, ["hap_id"], "pos", "base", "seq"), n=3, diversity=0.05)


def compact_reads(t: Tables) -> DataFrame:
    return compact.compact_reads(t.corrected, t.variants)


def raw_lineage(t: Tables) -> DataFrame:
    return compact.raw_lineage(t.fixed, compact.compact_reads(t.reads, t.variants))


def compact_match(t: Tables) -> DataFrame:
    return support.compact_match(t.compacted, t.compact_haps).drop("n_compared")


def asof_variant(t: Tables) -> DataFrame:
    return compact.asof_variant(t.spark.range(source.GENOME + 5).select(F.col("id").cast("int").alias("x")), t.variants)


def window_membership(t: Tables) -> DataFrame:
    return cluster.window_membership(t.reads, t.windows)


def root_threshold(t: Tables) -> DataFrame:
    return graph.root_threshold(graph.graph_roots(t.edges))


def _walkable(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pruned edges and starts, written first: a recursive query reads them once per site."""
    edges = staged(t.edges, "edges")
    return staged(graph.edge_prune(edges), "pruned"), staged(graph.started(edges), "starts")


def _from_all_roots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pruned edges and every root, whatever its weight: more of the graph is reached than from the roots that count."""
    edges = staged(t.edges, "edges")
    return staged(graph.edge_prune(edges), "pruned"), staged(graph.started(edges, 0.0), "starts")


def branch_positions(t: Tables) -> DataFrame:
    return graph.branch_positions(*_walkable(t), K)


def branch_positions_all_ways(t: Tables) -> DataFrame:
    """Forks of the graph before any pruning: what errors make of the sites."""
    edges, begin = _from_all_roots(t)
    return graph.branch_positions(edges, begin, K, ways=t.edges)


def path_counts(t: Tables) -> DataFrame:
    return graph.reached(*_from_all_roots(t)).withColumn("n_paths", F.col("n_paths").cast("long"))


def path_ends(t: Tables) -> DataFrame:
    edges, begin = _from_all_roots(t)
    return graph.leading(edges, graph.ends_at(edges, begin, B2 - 1, K)).withColumn("n_paths", F.col("n_paths").cast("long"))


def local_haplotypes(t: Tables) -> DataFrame:
    return graph.local_haplotypes(*_walkable(t), B1, B2 - 1, K)


def haplotype_product(t: Tables) -> DataFrame:
    counts = [h.agg(F.count(F.lit(1)).alias("n")) for h in t.halves()]
    return graph.haplotype_product(counts[0].union(counts[1]))


def region_split(t: Tables) -> DataFrame:
    return graph.region_split(t.compacted, B1, B2 - 1, k=K, most=2)  # a small bound, so that the short genome is split


def local_prune(t: Tables) -> DataFrame:
    """Two halves of the sites, pruned to under seven combinations: a small bound, as there are three haplotypes only."""
    matrix, y = None, None
    for i, (a, b) in enumerate(((B1, 10), (10, B2))):
        inside = t.compacted.where((F.col("cstart") < b) & (F.col("cend") >= a))
        m = staged(support.match_matrix(inside, t.compact_haps), "matrix")
        parts = m.withColumn("region", F.lit(i)), support.read_fraction(inside, m).withColumn("region", F.lit(i))
        matrix, y = parts if matrix is None else (matrix.unionByName(parts[0]), y.unionByName(parts[1]))
    return regress.local_prune(regress.normal_equations(matrix, y), most=7)


def _matched(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Match matrix and read fractions, written: the normal equations read them in several jobs."""
    return t.matrix, staged(t.y, "fractions")


def _fit(t: Tables, solve) -> DataFrame:
    return regress.fitted(regress.normal_equations(*_matched(t)), solve).select("hap_id", F.round("h", 5).alias("h"))


def haplotype_sets(t: Tables) -> DataFrame:
    sets = regress.haplotype_sets(*_matched(t))
    return sets.select(F.array_join(F.transform("haps", lambda x: x.cast("string")), ",").alias("haps"), "n", F.round("sy", 9).alias("sy"), F.round("syy", 9).alias("syy"))


def gram_matrix(t: Tables) -> DataFrame:
    return regress.gram(regress.haplotype_sets(*_matched(t))).drop("region")


def confusion(t: Tables) -> DataFrame:
    new = t.fixed.select("start_pos", F.col("corrected_seq").alias("seq"), "cnt").distinct()
    after = evaluate.nearest_haplotype(evaluate.read_hap_distance(new, t.haps)).select("start_pos", F.col("seq").alias("corrected_seq"), "cnt", "hap_id", "dist")
    keyed = t.fixed.select("start_pos", "seq", "corrected_seq", "cnt").join(after, ["start_pos", "corrected_seq", "cnt"])
    return evaluate.nearest_confusion(t.nearest, keyed)


def class_haplotypes(t: Tables) -> DataFrame:
    return cluster.class_haplotypes(t.consensus, t.sites)


def class_merge(t: Tables) -> DataFrame:
    return cluster.class_merge(class_haplotypes(t), t.assigned, t.members)


def class_mode(t: Tables) -> DataFrame:
    ids = pileup.read_ids(t.reads).select("read_id")
    history = ids.select(F.lit(0).alias("window_id"), "read_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sweep"))
    return cluster.class_mode(history.withColumn("class_id", ((F.col("read_id") * 7 + F.col("sweep") * (F.col("read_id") % 3)) % 4).cast("int")))


def majority_vote(t: Tables) -> DataFrame:
    return cluster.majority_vote(t.reads, cluster.votes_of(t.members, t.variants, t.assigned, t.consensus))


def window_votes(t: Tables) -> DataFrame:
    return cluster.window_votes(t.members, t.variants, t.assigned, t.consensus).select("window_id", "start_pos", "seq", "off", "base")


def gibbs_assign(t: Tables) -> DataFrame:
    return cluster.gibbs_assign(t.bases, t.members, t.sites, t.reference)


def clustering_votes(t: Tables) -> DataFrame:
    return cluster.clustering_votes(pileup.read_ids(t.reads), t.variants, t.windows, t.reference)


def clustering_passes(t: Tables) -> DataFrame:
    """Passes with growing windows, each on the reads that the one before has corrected and written."""
    out, variants, reference = t.reads, staged(t.variants, "sites"), staged(t.reference, "reference")
    for length in (50, 60, 70):
        windows = cluster.window_grid(t.spark, 1, 81, length, 40)
        voted = cluster.clustering_votes(pileup.read_ids(out), variants, windows, reference)
        out = staged(voted.groupBy("start_pos", F.col("voted_seq").alias("seq")).agg(F.sum("cnt").alias("cnt")), "pass")
    return out


def grid(t: Tables) -> DataFrame:
    return regress.fit_grid(*_matched(t)).select("fit_id", "rho", "rep", "hap_id", F.round("h", 4).alias("h"), "k")


def solution(t: Tables) -> DataFrame:
    return regress.solution(regress.fit_grid(*_matched(t)), t.compact_haps).select("hap_id", F.round("h", 4).alias("h"), "cseq")


BUILD = {
    "read_scan": read_scan,
    "read_dedup": read_dedup,
    "read_ids": read_ids,
    "read_bases": read_bases,
    "read_length_range": lambda t: pileup.read_length_range(t.counted),
    "pileup": lambda t: t.piled,
    "site_entropy": lambda t: t.entropy.select("pos", "depth", "entropy"),
    "site_mode": site_mode,
    "variant_sites": lambda t: t.variants,
    "entropy_corrected_reads": entropy_corrected_reads,
    "correction_flags": correction_flags,
    "variant_sites_post": lambda t: pileup.variant_sites_post(t.corrected),
    "shared_bases": lambda t: pileup.shared_bases(t.corrected, source.GENOME),
    "position_diff": position_diff,
    "raw_read_filter": raw_read_filter,
    "mate_merge": mate_merge,
    "gap_bounds": lambda t: pileup.gap_bounds(t.counted),
    "compact_reads": compact_reads,
    "compact_range": lambda t: compact.compact_range(t.reads, t.variants),
    "compact_dedup": lambda t: t.compacted,
    "split_reads": lambda t: compact.split_reads(t.compacted),
    "region_reads": lambda t: compact.region_reads(t.compacted, 5, 15, 4),
    "compact_haplotypes": lambda t: t.compact_haps,
    "asof_variant": asof_variant,
    "raw_lineage": raw_lineage,
    "kmer_edges": lambda t: t.edges,
    "graph_roots": lambda t: graph.graph_roots(t.edges),
    "root_threshold": root_threshold,
    "edge_prune": lambda t: graph.edge_prune(t.edges),
    "branch_positions": branch_positions,
    "branch_positions_all_ways": branch_positions_all_ways,
    "path_counts": path_counts,
    "path_ends": path_ends,
    "local_haplotypes": local_haplotypes,
    "global_haplotypes": lambda t: graph.global_haplotypes(t.halves()),
    "haplotype_product": haplotype_product,
    "region_split": region_split,
    "compact_match": compact_match,
    "match_matrix": lambda t: t.matrix,
    "support_matrix": lambda t: support.support_matrix(t.support),
    "total_extension": lambda t: support.total_extension(t.support),
    "local_consistency": lambda t: support.local_consistency(t.full),
    "flow_consistency": lambda t: support.flow_consistency(t.full),
    "read_fraction": lambda t: t.y,
    "fit_cost": lambda t: support.fit_cost(t.matrix, t.y, t.shares),
    "credibility_score": lambda t: support.credibility_score(t.full, support.total_extension(t.support), t.shares),
    "bucket_best": lambda t: support.bucket_best(t.fits),
    "elbow_pick": lambda t: support.elbow_pick(support.bucket_best(t.fits)),
    "local_prune": local_prune,
    "haplotype_sets": haplotype_sets,
    "gram_matrix": gram_matrix,
    "stagewise_fit": lambda t: _fit(t, regress.stagewise),
    "lagrangian_fit": lambda t: _fit(t, lambda g, r: regress.lagrangian(g, r, 0.001, 1)),
    "refit": lambda t: _fit(t, lambda g, r: regress.refit(g, r, 0.001, 1)),
    "fit_grid": grid,
    "solution": solution,
    "reconstruction": lambda t: reconstruct(t.counted, k=K, **SUPPORT).select("cseq", F.round("h", 3).alias("h"), F.round("score", 3).alias("score")),
    "read_hap_distance": lambda t: evaluate.read_hap_distance(t.reads, t.haps),
    "nearest_haplotype": lambda t: t.nearest,
    "distance_histogram": lambda t: evaluate.distance_histogram(t.nearest),
    "nearest_confusion": confusion,
    "mismatch_profile": lambda t: evaluate.mismatch_profile(t.nearest, t.haps),
    "length_buckets": lambda t: evaluate.length_buckets(t.nearest, (33, 37, 41), known_only=True),
    "fragment_length_buckets": lambda t: evaluate.length_buckets(t.nearest_of_fragments, (25, 35, 45), REGION),
    "distance_histogram_region": lambda t: evaluate.distance_histogram(t.nearest, REGION, 100),
    "mismatch_profile_exact": lambda t: evaluate.mismatch_profile(t.nearest, t.haps, exact_only=True),
    "odd_sites": lambda t: evaluate.odd_sites(evaluate.mismatch_profile(t.nearest, t.haps), REGION, 3),
    "sam_fragments": lambda t: t.fragments,
    "window_votes": window_votes,
    "diversity": diversity,
    "site_report": lambda t: evaluate.site_report(t.entropy, t.nearest, 0, 3),
    "window_grid": lambda t: t.windows,
    "window_membership": window_membership,
    "class_consensus": lambda t: t.consensus,
    "class_merge": class_merge,
    "class_mode": class_mode,
    "theta_update": lambda t: cluster.theta_update(cluster.matches(t.bases, t.assigned, t.consensus), t.sites),
    "gamma_update": lambda t: cluster.gamma_update(t.consensus, t.sites, t.reference),
    "class_logweight": lambda t: cluster.class_logweight(t.bases, t.members, t.assigned, t.consensus, THETA),
    "majority_vote": majority_vote,
    "gibbs_assign": gibbs_assign,
    "clustering_votes": clustering_votes,
    "clustering_passes": clustering_passes,
    "simulate_variants": simulate_variants,
}


def _query(build):
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


QUERIES = {name: _query(build) for name, build in BUILD.items()}
