"""The bitmap index of haplotypes against plain comparison."""

import random

import pytest

from strandflow.operators import support


def brute(reads, haps):
    out = set()
    for s, q in reads:
        for h, seq in haps:
            pairs = [(r, seq[s + i]) for i, r in enumerate(q) if s + i < len(seq)]
            if not any(r not in (".", x) for r, x in pairs):
                out.add((s, q, h, sum(r != "." for r, _ in pairs), len(pairs)))
    return out


@pytest.mark.parametrize(("n", "same"), [(5, True), (70, False), (1000, True)])
def test_fitting_by_brute_force(spark, n, same):
    rng = random.Random(n)
    base = ["".join(rng.choice("AC") for _ in range(24)) for _ in range(6)]
    haps = [(7 * i + 3, "".join(rng.choice("ACG-") if rng.random() < 0.03 else x for x in rng.choice(base))[: 24 if same else rng.randrange(6, 25)]) for i in range(n)]
    reads = {(s, "".join(rng.choice("ACGT-") if rng.random() < 0.02 else "." if rng.random() < 0.2 else x for x in rng.choice(base)[s : s + w])) for s, w in ((rng.randrange(0, 22), rng.randrange(1, 12)) for _ in range(150))}
    reads |= {(0, "..."), (2, "TTTT"), (23, "AC"), (30, "ACG"), (5, "A")}
    compacted = spark.createDataFrame([(s, s + len(q) - 1, q, 1 + s) for s, q in sorted(reads)] * 2, "cstart int, cend int, cseq string, cnt long")
    h = spark.createDataFrame(haps, "hap_id int, cseq string")
    got = support.fitting(compacted, h)
    want = brute(reads, haps)
    assert {tuple(r) for r in got.select("cstart", "cseq", "hap_id", "n_match", "n_compared").collect()} == want
    assert got.count() == len(want)
    assert {tuple(r) for r in support.match_matrix(compacted, h).collect()} == {x[:3] for x in want if x[4] >= 2}


def test_no_reads_meet_all_haplotypes(spark):
    """Neither the matrix nor the support joins reads and haplotypes but by equal sites, bases and bits."""
    h = spark.createDataFrame([(0, "ACGT"), (1, "ACGA")], "hap_id int, cseq string")
    c = spark.createDataFrame([(0, 3, "ACGT", 2)], "cstart int, cend int, cseq string, cnt long")
    for df in (support.fitting(c, h), support.match_matrix(c, h), support.supporting(c, h, 0, 4, reach=0, overlap=2, equal=2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = c.where("cnt > 5")
    assert support.fitting(none, h).count() == 0 and support.fitting(c, h.where("hap_id > 5")).count() == 0
