"""The positional de Bruijn graph of compact reads: nodes are (k-1)-mers at a site, edges k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import staged
from .paths import COUNT, FULL, interval_paths, leading, reached, tree

#: K, the least share of the strongest way on, the least share of the mean root, the least edge weight.
K, LEAST_SHARE, ROOT_SHARE, LEAST_EDGE = 11, 0.01, 0.20, 2


def kmer_edges(compacted: DataFrame, k: int = K) -> DataFrame:
    """(vi, src, dst, w): k-mers of the compact reads without gaps, with the sum of their counts."""
    at = F.explode(F.sequence(F.lit(0), F.length("cseq") - k)).alias("i")
    found = compacted.where(F.length("cseq") >= k).select("cstart", "cseq", "cnt", at)
    mer = F.expr(f"substring(cseq, i + 1, {k})")
    mers = found.select((F.col("cstart") + F.col("i")).alias("vi"), mer.alias("mer"), "cnt").where(~F.col("mer").contains("."))
    summed = mers.groupBy("vi", "mer").agg(F.sum("cnt").alias("w"))
    return summed.select("vi", F.expr(f"substring(mer, 1, {k - 1})").alias("src"), F.expr("substring(mer, 2)").alias("dst"), "w")


def graph_roots(edges: DataFrame) -> DataFrame:
    """(vi, node, w): nodes without an edge into them, with the weight of their edges out."""
    into = edges.select((F.col("vi") + 1).alias("vi"), F.col("dst").alias("src")).distinct()
    return edges.join(into, ["vi", "src"], "left_anti").groupBy("vi", F.col("src").alias("node")).agg(F.sum("w").alias("w"))


def root_threshold(roots: DataFrame, share: float = ROOT_SHARE) -> DataFrame:
    """One row: the number of roots, their mean weight and the least weight of a root that counts."""
    return roots.agg(F.count(F.lit(1)).alias("n_roots"), F.round(F.avg("w"), 9).alias("mean_w"), F.round(share * F.avg("w"), 9).alias("border"))


def edge_prune(edges: DataFrame, least: int = LEAST_EDGE, share: float = LEAST_SHARE) -> DataFrame:
    """Edges of at least this weight and at least this share of the heaviest edge out of their node."""
    kept = edges.where(F.col("w") >= least).withColumn("top", F.max("w").over(Window.partitionBy("vi", "src")))
    return kept.where(F.col("w") >= share * F.col("top")).drop("top")


def started(edges: DataFrame, share: float = ROOT_SHARE) -> DataFrame:
    """(vi, node) where paths begin: roots of the unpruned graph of at least the border's weight."""
    roots = graph_roots(edges)
    return roots.crossJoin(F.broadcast(root_threshold(roots, share))).where("w >= border").select("vi", "node")  # one row


def branch_positions(edges: DataFrame, begin: DataFrame, k: int = K, last: int | None = None, ways: DataFrame | None = None) -> DataFrame:
    """(vi): sites that a reached node with two ways on decides; edges beyond site ``last`` aren't followed.

    ``ways``: the edges that make a fork, by default those that are followed.  Edges of the least weight make one even where
    pruning by share keeps only one of them."""
    forks = (edges if ways is None else ways).groupBy("vi", "src").count().where("count > 1").select("vi", F.col("src").alias("node"))
    return forks.join(reached(edges, begin, last).select("vi", "node"), ["vi", "node"], "left_semi").select((F.col("vi") + k - 1).alias("vi")).distinct()


def ends_at(edges: DataFrame, begin: DataFrame, last: int, k: int) -> DataFrame:
    """(vi, node): the nodes whose last base is site ``last``."""
    layer = last - k + 2
    return edges.where(F.col("vi") == layer - 1).select(F.col("dst").alias("node")).union(begin.where(F.col("vi") == layer).select("node")).distinct().select(F.lit(layer).alias("vi"), "node")


def count_paths(edges: DataFrame, begin: DataFrame, first: int, last: int, k: int) -> int:
    """Number of full paths from a start at site ``first`` to a node that ends at ``last``; ``paths.FULL`` stands for more."""
    inside, start = edges.where((F.col("vi") >= first) & (F.col("vi") + k - 1 <= last)), begin.where(F.col("vi") == first)
    ways = leading(inside, ends_at(inside, start, last, k))
    return int(start.join(ways, ["vi", "node"]).agg(F.coalesce(F.try_sum("n_paths"), F.when(F.count(F.lit(1)) > 0, F.lit(str(FULL)).cast(COUNT)))).first()[0] or 0)


def local_haplotypes(edges: DataFrame, begin: DataFrame, first: int, last: int, k: int = K, most: int = 100_000) -> DataFrame:
    """(seq, n_sites): all paths from a start at ``first`` to a node that ends at ``last``, sites inclusive.

    Paths are counted before any is listed, and refused above ``most`` (split the region, see ``region_split``).  Only nodes
    that lead to an end are walked, so no layer holds more beginnings than there are paths."""
    inside, start = edges.where((F.col("vi") >= first) & (F.col("vi") + k - 1 <= last)), begin.where(F.col("vi") == first)
    ways = staged(leading(inside, ends_at(inside, start, last, k)), "ways")
    n = start.join(ways, ["vi", "node"]).agg(F.sum(F.least("n_paths", F.lit(most + 1)))).first()[0] or 0
    if n > most:
        raise ValueError(f"more than {most} local haplotypes; split the region first")
    live = inside.join(ways.select((F.col("vi") - 1).alias("vi"), F.col("node").alias("dst")), ["vi", "dst"], "left_semi")
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE walk(vi, node, seq) MAX RECURSION LEVEL {max(100, last - first + 5)} AS (
             SELECT vi, node, node AS seq FROM {{begin}}
             UNION ALL
             SELECT e.vi + 1, e.dst, concat(w.seq, right(e.dst, 1)) FROM walk w JOIN {{edges}} e ON e.vi = w.vi AND e.src = w.node)
           SELECT seq, length(seq) AS n_sites FROM walk WHERE vi + {k} - 2 = {last}""",
        begin=staged(start.join(ways, ["vi", "node"], "left_semi").select("vi", "node"), "walk-starts"),
        edges=staged(live.select("vi", "src", "dst"), "walk-edges"),
    )


def global_haplotypes(parts: list[DataFrame], most: int = 100_000) -> DataFrame:
    """All concatenations of local haplotypes (seq), region by region; refused where their number would pass ``most``."""
    n = 1
    for p in parts:
        n *= p.count()
    if n > most:
        raise ValueError(f"{n} global haplotypes; prune the local ones first")
    out = parts[0].select("seq")
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p.select(F.col("seq").alias("next")))).select(F.concat("seq", "next").alias("seq"))  # bounded by most
    return out


def haplotype_product(counts: DataFrame) -> DataFrame:
    """(n_regions, product) of the numbers of local haplotypes (n)."""
    return counts.agg(F.count(F.lit(1)).alias("n_regions"), F.aggregate(F.collect_list(F.col("n").cast("long")), F.lit(1).cast("long"), lambda a, x: a * x).alias("product"))


def halvings(spark: SparkSession, first: int, last: int, k: int) -> DataFrame:
    """(depth, a, b): all regions that halving [first, last] may lead to; those of under 2k sites aren't halved."""
    level = spark.range(1).select(F.lit(0).alias("depth"), F.lit(first).alias("a"), F.lit(last).alias("b"))
    out, size = level, last - first + 1
    while size >= 2 * k:
        middle = F.expr("(a + b) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))).alias("x")
        level = level.where(F.col("b") - F.col("a") + 1 >= 2 * k).select((F.col("depth") + 1).alias("depth"), halves).select("depth", "x.a", "x.b")
        out, size = out.unionByName(level), (size + 1) // 2
    return out


def region_starts(edges: DataFrame, regions: DataFrame, k: int = K, share: float = ROOT_SHARE) -> DataFrame:
    """(a, b, node): the nodes at site a where paths of the region [a, b] begin.

    ``edges`` are the unpruned edges of the whole graph.  A region's roots are all nodes of its first site, and the whole
    graph's roots at later ones; the least weight of a root follows from sums a site."""
    nodes = edges.groupBy("vi", F.col("src").alias("node")).agg(F.sum("w").alias("w"))
    of_site = nodes.groupBy("vi").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("w").alias("w_nodes"))
    roots = graph_roots(edges).groupBy("vi").agg(F.count(F.lit(1)).alias("n_roots"), F.sum("w").alias("w_roots"))
    of_site = of_site.join(roots, "vi", "left")
    own = regions.select("a", "b").distinct().where(F.col("b") - k + 1 >= F.col("a"))
    at = own.select("a", "b", F.explode(F.sequence("a", F.col("b") - k + 1)).alias("vi")).join(of_site, "vi")
    first = F.col("vi") == F.col("a")
    weight = F.sum(F.when(first, F.col("w_nodes")).otherwise(F.coalesce("w_roots", F.lit(0))))
    number = F.sum(F.when(first, F.col("n_nodes")).otherwise(F.coalesce("n_roots", F.lit(0))))
    border = at.groupBy("a", "b").agg(F.round(share * weight / F.nullif(number, F.lit(0)), 9).alias("border"))
    return nodes.join(border, nodes["vi"] == border["a"]).where("w >= border").select("a", "b", "node")


def region_paths(edges: DataFrame, regions: DataFrame, k: int = K, share: float = ROOT_SHARE) -> DataFrame:
    """``regions`` (a, b, ...) with ``n_paths``, the number of full paths of the graph of the k-mers inside each.

    ``edges`` are the unpruned edges of the whole graph.  A k-mer inside a region is the same whether reads are cut there or
    not, so edges and their pruning are the whole graph's; only the roots are the region's own."""
    edges = staged(edges, "edges")
    bounds = edges.agg(F.min("vi").alias("a"), F.max("vi").alias("b")).first()
    if bounds.a is None:
        return regions.withColumn("n_paths", F.lit(0).cast(COUNT))
    own = regions.select("a", "b").distinct().withColumn("id", F.struct("a", "b"))
    # a region that reaches beyond the edges has a layer without any
    inside = own.where((F.col("b") - k + 1 <= bounds.b) & (F.col("a") >= bounds.a) & (F.col("b") - k + 1 >= F.col("a")))
    start = region_starts(edges, inside, k, share).select(F.struct("a", "b").alias("id"), "node")
    whole = tree(edge_prune(edges).select((F.col("vi") - bounds.a).alias("block"), "src", "dst"), bounds.b - bounds.a + 1)
    lo, hi = (F.col("a") - bounds.a).cast("long"), (F.col("b") - k + 2 - bounds.a).cast("long")
    n = interval_paths(whole, inside.select("id", lo.alias("lo"), hi.alias("hi")), start)
    counted = own.join(n, "id", "left").select("a", "b", F.coalesce("n", F.lit(0).cast(COUNT)).alias("n_paths"))
    return regions.join(counted, ["a", "b"])


def region_split(compacted: DataFrame, first: int, last: int, *, k: int = K, most: int = 1000, share: float = ROOT_SHARE) -> DataFrame:
    """(first_site, last_site, n_paths) of regions with at most ``most`` paths: halved while there are more and 2k sites or more.

    All halvings are counted at once by products of the one graph's tables; a region is taken where its own count ends the
    halving and no larger one around it did.  Counts beyond 64 bits are the greatest of 64 bits."""
    counted = staged(region_paths(kmer_edges(compacted, k), halvings(compacted.sparkSession, first, last, k), k, share), "regions")
    ends = (F.col("n_paths") <= most) | (F.col("b") - F.col("a") + 1 < 2 * k)
    deepest = 0 if last - first + 1 < 2 * k else counted.agg(F.max("depth")).first()[0]
    open_, out = counted.where("depth = 0"), []
    for depth in range(deepest + 1):
        out.append(open_.where(ends))
        inner = counted.where(F.col("depth") == depth + 1)
        parent = open_.where(~ends).select((F.col("a")).alias("pa"), F.col("b").alias("pb"), F.expr("(a + b) div 2").cast("int").alias("pm"))
        halves = parent.select(F.explode(F.array(F.struct(F.col("pa").alias("a"), F.col("pm").alias("b")), F.struct((F.col("pm") + 1).alias("a"), F.col("pb").alias("b")))).alias("x")).select("x.a", "x.b")
        open_ = inner.join(halves, ["a", "b"], "left_semi")
    taken = out[0]
    for more in out[1:]:
        taken = taken.unionByName(more)
    return taken.select(F.col("a").alias("first_site"), F.col("b").alias("last_site"), F.least("n_paths", F.lit(2**63 - 1)).cast("long").alias("n_paths"))
