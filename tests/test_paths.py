"""Path counts by transfer tables against plain dynamic programming and listing."""

import random
import time
from collections import Counter
from decimal import Decimal

import pytest

from strandflow.operators import graph, paths

EDGE = "vi int, src string, dst string, w long"


def reads_of(spark, seqs):
    return spark.createDataFrame([(s, s + len(q) - 1, q, c) for s, q, c in seqs], "cstart int, cend int, cseq string, cnt long")


def brute_reached(edges, begin, last=None):
    count = Counter(dict.fromkeys(begin, 1))
    for vi in sorted({e[0] for e in edges}):
        if last is None or vi <= last:
            for a, src, dst, *_ in edges:
                if a == vi and count[(vi, src)]:
                    count[(vi + 1, dst)] += count[(vi, src)]
    return {k: v for k, v in count.items() if v}


def some_graph(seed, layers=13, width=4):
    rng = random.Random(seed)
    names = ["AA", "AC", "CA", "CC", "GG"][:width]
    edges = sorted({(vi, rng.choice(names), rng.choice(names), rng.randrange(1, 9)) for vi in range(3, 3 + layers) for _ in range(5)})
    edges = list({e[:3]: e for e in edges}.values())
    begin = sorted({(rng.choice([3, 3, 5, 9]), rng.choice(names)) for _ in range(4)})
    return edges, begin


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_reached_and_leading_by_brute_force(spark, seed):
    edges, begin = some_graph(seed, layers=(1, 13, 16)[seed])
    e, b = spark.createDataFrame(edges, EDGE), spark.createDataFrame(begin, "vi int, node string")
    got = {(r.vi, r.node): int(r.n_paths) for r in graph.reached(e, b).collect()}
    assert got == brute_reached(edges, begin)
    assert {(r.vi, r.node): int(r.n_paths) for r in graph.reached(e, b, 8).collect()} == brute_reached(edges, begin, 8)
    end = max(x[0] for x in edges) + 1
    ends = sorted({(end, d) for v, _, d, _ in edges if v == end - 1})
    back = brute_reached([(-v - 1, d, s) for v, s, d, _ in edges], [(-v, n) for v, n in ends])
    assert {(r.vi, r.node): int(r.n_paths) for r in graph.leading(e, spark.createDataFrame(ends, "vi int, node string")).collect()} == {(-v, n): c for (v, n), c in back.items()}


def test_nothing_and_a_start_beyond_the_edges(spark):
    none, start = spark.createDataFrame([], EDGE), spark.createDataFrame([(4, "AA")], "vi int, node string")
    assert [tuple(r) for r in graph.reached(none, start).collect()] == [(4, "AA", Decimal(1))]
    assert graph.reached(none, start.where("vi > 4")).count() == 0
    edges = spark.createDataFrame([(0, "AA", "AC", 1), (1, "AC", "CC", 1)], EDGE)
    assert {(r.vi, r.node): int(r.n_paths) for r in graph.reached(edges, start).collect()} == {(4, "AA"): 1}


@pytest.fixture(scope="module")
def bubbles(spark):
    """400 sites and 100 bubbles: at sites 2, 6, 10, ... either A or C goes on; k = 3."""
    at = set(range(2, 400, 4))
    edges = []
    for vi in range(398):
        bases = [("AC" if vi + i in at else "A") for i in range(3)]
        for x in bases[0]:
            for y in bases[1]:
                for z in bases[2]:
                    edges.append((vi, x + y, y + z, 10))
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame([(0, "AA")], "vi int, node string")


def test_a_hundred_bubbles_are_counted_and_not_listed(spark, bubbles):
    edges, begin = bubbles
    began = time.perf_counter()
    assert graph.count_paths(edges, begin, 0, 399, 3) == 2**100
    assert {r.vi for r in graph.branch_positions(edges, begin, 3).collect()} == set(range(2, 400, 4))
    assert time.perf_counter() - began < 180
    with pytest.raises(ValueError, match="split the region"):
        graph.local_haplotypes(edges, begin, 0, 399, 3, most=1000)
    assert graph.local_haplotypes(edges, begin, 0, 25, 3).count() == 2**6


def test_counts_stop_at_38_digits(spark):
    """Every site is open to A, C, G, T: 4^70 paths, more than a decimal holds."""
    edges = spark.range(69).selectExpr("cast(id as int) as vi", "explode(array('A', 'C', 'G', 'T')) as src").selectExpr("vi", "src", "explode(array('A', 'C', 'G', 'T')) as dst", "1L as w")
    begin = spark.createDataFrame([(0, x) for x in "ACGT"], "vi int, node string")
    got = graph.reached(edges, begin)
    assert {int(r.n_paths) for r in got.where("vi = 40").collect()} == {4**40}
    assert {int(r.n_paths) for r in got.where("vi = 69").collect()} == {paths.FULL}
    assert graph.count_paths(edges, begin, 0, 69, 2) == paths.FULL


def brute_split(seqs, first, last, k, most, share=graph.ROOT_SHARE):
    """Regions as the driver would halve them, reads cut at each region and the graph built anew."""

    def counted(a, b):
        w = Counter()
        for s, q, c in seqs:
            for i in range(len(q) - k + 1):
                if a <= s + i and s + i + k - 1 <= b and "." not in q[i : i + k]:
                    w[(s + i, q[i : i + k])] += c
        out = Counter()
        for (vi, m), c in w.items():
            out[(vi, m[:-1])] += c
        into = {(vi + 1, m[1:]) for vi, m in w}
        roots = {n: c for n, c in out.items() if n not in into}
        if not roots:
            return 0
        border = round(share * sum(roots.values()) / len(roots), 9)
        heavy = {x: c for x, c in w.items() if c >= graph.LEAST_EDGE}
        top = {}
        for (vi, m), c in heavy.items():
            top[(vi, m[:-1])] = max(top.get((vi, m[:-1]), 0), c)
        edges = [(vi, m[:-1], m[1:]) for (vi, m), c in heavy.items() if c >= graph.LEAST_SHARE * top[(vi, m[:-1])]]
        got = brute_reached(edges, [n for n, c in roots.items() if n[0] == a and c >= border])
        return sum(c for (vi, _), c in got.items() if vi == b - k + 2)

    todo, out = [(first, last)], []
    while todo:
        a, b = todo.pop(0)
        n = counted(a, b)
        if n > most and b - a + 1 >= 2 * k:
            todo += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]
        else:
            out.append((a, b, n))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 2])
def test_region_split_by_brute_force(spark, seed):
    rng = random.Random(seed)
    true = ["".join(rng.choice("AC") for _ in range(40)) for _ in range(4)]
    seqs = []
    for _ in range(150):
        n, h = rng.randrange(4, 14), rng.choice(true)
        s = rng.randrange(0, 41 - n)
        q = "".join(rng.choice("ACGT") if rng.random() < 0.02 else "." if rng.random() < 0.01 else x for x in h[s : s + n])
        seqs.append((s, q, rng.randrange(1, 5)))
    for most in (3, 40):
        got = sorted(tuple(r) for r in graph.region_split(reads_of(spark, seqs), 0, 39, k=4, most=most).collect())
        assert got == brute_split(seqs, 0, 39, 4, most)


def test_region_split_of_no_reads_and_of_a_short_region(spark):
    none = reads_of(spark, [(0, "ACGT", 1)]).where("cnt > 1")
    assert [tuple(r) for r in graph.region_split(none, 0, 9, k=4).collect()] == [(0, 9, 0)]
    assert [tuple(r) for r in graph.region_split(reads_of(spark, [(0, "ACGTA", 5)]), 0, 2, k=4).collect()] == [(0, 2, 0)]
