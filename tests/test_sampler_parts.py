"""The sampler in parts against the sampler of a whole window."""

import numpy as np
import pytest

from strandflow.operators import cluster, parts, sampling


def planted(n, sites=12, seed=1, error=0.02, genomes=3):
    rng = np.random.default_rng(seed)
    true = rng.integers(0, 4, (genomes, sites))
    who = rng.choice(genomes, n, p=np.array([5, 3, 2])[:genomes] / sum([5, 3, 2][:genomes]))
    codes = true[who]
    wrong = rng.random(codes.shape) < error
    codes = np.where(wrong, (codes + rng.integers(1, 4, codes.shape)) % 4, codes)
    codes[rng.random(codes.shape) < 0.1] = -1
    return codes, who, true


def agreement(a, b):
    """Share of pairs of reads that both put together or both apart."""
    x, y = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    table = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(table, (x, y), 1)
    pairs = lambda t: (t * (t - 1) / 2).sum()
    n = len(x)
    return 1 + (2 * pairs(table) - pairs(table.sum(0)) - pairs(table.sum(1))) / (n * (n - 1) / 2)


def frames(spark, codes, cnt, sites):
    rows = [(3, i, int(cnt[i]), 5 + s, "ACTG-"[c]) for i, r in enumerate(codes.tolist()) for s, c in enumerate(r) if c >= 0]
    bases = spark.createDataFrame(rows, "window_id int, read_id long, cnt int, vi int, base string")
    where = spark.createDataFrame([(3, 0, 40, 5, 4 + sites)], "window_id int, w_start int, w_end int, f_start int, f_end int")
    return bases, where, spark.createDataFrame([(5 + s, "A") for s in range(sites)], "vi int, base string")


def test_parts_find_the_planted_genomes(spark):
    codes, who, _ = planted(600)
    bases, where, reference = frames(spark, codes, np.ones(600), 12)
    kind = {"sweeps": 24, "burn_in": 12}
    whole = {r.read_id: r.class_id for r in cluster.gibbs_assign(bases, None, where, reference, **kind).collect()}
    for sync in (1, 8):
        got = cluster.gibbs_assign(bases, None, where, reference, part_reads=100, sync=sync, **kind)
        split = {r.read_id: r.class_id for r in got.collect()}
        assert split.keys() == whole.keys()
        order = sorted(split)
        assert agreement([split[i] for i in order], [who[i] for i in order]) > 0.97
        assert agreement([split[i] for i in order], [whole[i] for i in order]) > 0.97
        assert sorted({*split.values()}) == list(range(len({*split.values()})))
    again = {r.read_id: r.class_id for r in cluster.gibbs_assign(bases, None, where, reference, part_reads=100, sync=8, **kind).collect()}
    assert again == split  # reruns agree


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_of_parts_are_those_of_the_window(seed):
    codes, _, _ = planted(300, seed=seed)
    rng = np.random.default_rng(seed)
    cnt, who = rng.integers(1, 9, 300).astype(float), rng.integers(0, 6, 300)
    part = rng.integers(0, 4, 300)
    shares = []
    for p in range(4):
        own = part == p
        ids, at = np.unique(who[own], return_inverse=True)
        shares.append({"ids": ids, "seen": parts.class_bases(codes[own], cnt[own], at, len(ids)), "size": np.bincount(at, weights=cnt[own]), "matched": 0})
    ref = np.zeros(12, int)
    got = parts.summed(shares, 300, 1 - sampling.TINY, ref, 40, None)
    ids, at = np.unique(who, return_inverse=True)
    seen = parts.class_bases(codes, cnt, at, len(ids))
    haps = np.where(seen.sum(2) > 0, seen.argmax(2), -1)
    merged = parts.equal_classes(haps)
    assert np.array_equal(got["ids"], ids[np.unique(merged)]) and np.array_equal(got["was"], ids) and np.array_equal(got["becomes"], ids[merged])
    assert np.allclose(got["seen"].sum(0), seen.sum(0)) and np.allclose(got["size"].sum(), cnt.sum())


def test_one_part_sweeps_like_a_window():
    """With all reads in one part nothing is frozen: classes settle as in the whole window's sampler."""
    codes, who, _ = planted(200, seed=4)
    cnt, ref = np.ones(200), np.zeros(12, int)
    ids, at = np.unique(np.random.default_rng(1).integers(0, 10, 200), return_inverse=True)
    state = parts.summed([{"ids": ids, "seen": parts.class_bases(codes, cnt, at, len(ids)), "size": np.bincount(at, weights=cnt), "matched": 0}], 200, 1 - sampling.TINY, ref, 40, None)
    place = np.searchsorted(state["ids"], state["becomes"][np.searchsorted(state["was"], ids[at])])
    swept, share = parts.part_sweeps(codes, cnt, ref, 40, place, state | {"rest": None}, sweeps=20, new_id=1 << 20, rng=np.random.default_rng(2))
    assert agreement(swept[-1], who) > 0.97
    assert share["size"].sum() == 200 and set(share["ids"]) == set(swept[-1])
    whole, _ = sampling.sample_window(codes, cnt, ref, 40, 3, sweeps=20, burn_in=10)
    assert agreement(swept[-1], whole) > 0.95
