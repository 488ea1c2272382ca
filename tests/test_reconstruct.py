"""One run from reads to scored haplotypes."""

from strandflow.plans.queries import Tables
from strandflow.plans.reconstruct import reconstruct, region_cut

DIR = "/root/testdata/sf0.001"


def test_reads_to_scored_haplotypes(spark):
    t = Tables(spark, DIR)
    kind = {"k": 4, "reach": 2, "overlap": 5, "equal": 4, "rhos": (0.001,), "repeats": 6}
    true = {r.cseq for r in t.compact_haps.collect()}
    whole = reconstruct(t.counted, **kind).collect()
    assert {r.cseq for r in whole} == true and abs(sum(r.h for r in whole) - 1) < 0.01
    assert all(0 <= r.score <= 1 for r in whole)
    # in several regions, combinations that no read spans are told apart by frequencies only
    split = reconstruct(t.counted, most_local=2, **kind).collect()
    assert {len(r.cseq) for r in split} == {20} and abs(sum(r.h for r in split) - 1) < 0.01
    assert {r.cseq[:5] for r in split} <= {x[:5] for x in true}


def test_reads_without_sites(spark):
    same = spark.createDataFrame([(1, "ACGTACGT", 5)], "start_pos int, seq string, cnt long")
    assert reconstruct(same, k=3).count() == 0


def test_reads_cut_to_a_region(spark):
    c = spark.createDataFrame([(0, 4, "ACGTA", 2), (1, 4, "CGTA", 3), (6, 7, "AC", 1), (3, 6, "TTTT", 1)], "cstart int, cend int, cseq string, cnt long")
    got = sorted(tuple(r) for r in region_cut(c, 1, 3).select("cstart", "cend", "cseq", "cnt").collect())
    assert got == [(0, 2, "CGT", 5), (2, 2, "T", 1)]
