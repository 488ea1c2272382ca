"""Hand-made reads with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import cluster, compact, evaluate, graph, pileup, regress, simulate, support
from strandflow.sources import reads as source
from strandflow.streaming.pileup import read_stream, running_pileup


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def reads(spark, *rows):
    return df(spark, rows, "start_pos int, seq string, cnt long")


def got(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_dedup(spark):
    raw = df(spark, [(1, "AC"), (1, "AC"), (1, "AG"), (1, "AC"), (2, "AC")], "start_pos int, seq string")
    assert got(pileup.read_dedup(raw), "start_pos", "seq", "cnt") == [(1, "AC", 3), (1, "AG", 1), (2, "AC", 1)]
    assert got(pileup.read_ids(pileup.read_dedup(raw)), "read_id", "start_pos", "seq") == [(0, 1, "AC"), (1, 1, "AG"), (2, 2, "AC")]


def test_pileup_ties_gaps_and_n(spark):
    piled = pileup.pileup(reads(spark, (1, "A-.N", 2), (1, "-A.A", 2), (3, "..", 1)))
    assert got(piled, "pos", "n_a", "n_gap", "depth", "n_dot") == [(0, 2, 2, 4, 0), (1, 2, 2, 4, 0), (2, 0, 0, 0, 5), (3, 2, 0, 2, 3)]
    ent = {r.pos: r.entropy for r in pileup.site_entropy(piled).collect()}
    assert ent[2] == 0 and ent[3] == 0 and math.isclose(ent[0], 1 / 2.32192809, abs_tol=1e-9) and math.copysign(1, ent[3]) == 1
    assert {r.pos: r["mode"] for r in pileup.site_mode(piled).collect()}[0] == "A"


def test_correction_replaces_all_but_gaps(spark):
    r = reads(spark, (1, "AN.", 1), (1, "ACG", 500))
    fixed = pileup.corrected_reads(r, pileup.pileup(r))
    assert got(fixed, "seq", "corrected_seq", "changed") == [("ACG", "ACG", False), ("AN.", "AC.", True)]
    assert got(pileup.after_correction(fixed), "seq", "cnt") == [("AC.", 1), ("ACG", 500)]
    assert got(pileup.shared_bases(r, 4), "pos") == [(0,), (1,), (2,), (3,)]
    assert {x.pos: x.base for x in pileup.shared_bases(r, 4).collect()} == {0: "A", 1: "_", 2: "G", 3: None}


def test_compact_first_last_and_beyond(spark):
    variants = df(spark, [(0, 0), (1, 3), (2, 6)], "vi int, pos int")
    r = reads(spark, (1, "AAAC", 1), (4, "G..T", 2), (8, "CC", 1))
    assert got(compact.compact_reads(r, variants), "cstart", "cend", "cseq", "cnt") == [(0, 1, "AC", 1), (1, 2, "GT", 2)]
    assert {x.seq: (x.cstart, x.cend) for x in compact.compact_range(r, variants).collect()} == {"AAAC": (0, 1), "G..T": (1, 2), "CC": (None, None)}
    assert {x.seq: (x.cstart, x.cend) for x in compact.compact_range(r, variants, compat=True).collect()} == {"AAAC": (None, None), "G..T": (1, 1), "CC": (None, None)}
    x = df(spark, [(0,), (1,), (6,), (7,)], "x int")
    assert got(compact.asof_variant(x, variants), "x", "vi") == [(0, 0), (1, 1), (6, 2), (7, 2)]


def test_split_reads(spark):
    rows = [(0, 2, "ACG", 1), (3, 8, "A..CGT", 2), (1, 9, ".AC.G..T.", 1), (2, 3, "..", 1), (5, 8, "..AC", 1)]
    parts = compact.split_reads(df(spark, rows, "cstart int, cend int, cseq string, cnt long"))
    assert got(parts, "cstart", "cend", "cseq", "cnt") == [(0, 2, "ACG", 1), (2, 3, "AC", 1), (3, 3, "A", 2), (5, 8, "G..T", 1), (6, 8, "CGT", 2), (7, 8, "AC", 1)]


@pytest.mark.parametrize(("second", "want"), [((4, "GT"), "ACGGT"), ((5, "GT"), "ACG.GT"), ((3, "GT"), "ACGT"), ((1, "ACGT"), "ACGT"), ((2, "C"), "ACG"), ((4, "NN"), "ACG--")])
def test_mates(spark, second, want):
    pairs = df(spark, [(1, "ACG", second[0], second[1], 1)], "start_1 int, seq_1 string, start_2 int, seq_2 string, cnt long")
    assert got(pileup.merged_mates(pairs), "start_pos", "seq", "cnt") == [(1, want, 1)]


def test_graph(spark):
    c = df(spark, [(0, 4, "AAAAA", 200), (0, 4, "AACAA", 90), (0, 4, "AAGAA", 1), (0, 4, "TTTTT", 3)], "cstart int, cend int, cseq string, cnt long")
    edges = graph.kmer_edges(c, 3)
    roots = graph.graph_roots(edges)
    assert got(roots, "vi", "node", "w") == [(0, "AA", 291), (0, "TT", 3)]
    begin = graph.started(edges)
    assert got(begin, "vi", "node") == [(0, "AA")]
    pruned = graph.edge_prune(edges)
    assert got(graph.local_haplotypes(pruned, begin, 0, 4, 3), "seq") == [("AAAAA",), ("AACAA",)]
    assert graph.count_paths(pruned, begin, 0, 4, 3) == 2
    assert got(graph.branch_positions(pruned, begin, 3, 10), "vi") == [(2,)]
    none = c.where("cnt < 0")
    assert graph.started(graph.kmer_edges(none, 3)).count() == 0
    with pytest.raises(ValueError):
        graph.global_haplotypes([df(spark, [("A",), ("C",)], "seq string")] * 3, most=7)
    assert graph.global_haplotypes([df(spark, [("A",), ("C",)], "seq string")] * 2).count() == 4


def test_support_borders(spark):
    haps = df(spark, [(0, "A" * 30), (1, "A" * 14 + "C" + "A" * 15)], "hap_id int, cseq string")
    c = df(spark, [(9, 19, "A" * 11, 5), (9, 18, "A" * 10, 7), (9, 19, "AAAAA.AAAAA", 2), (9, 19, "AAAA......A", 3)], "cstart int, cend int, cseq string, cnt long")
    s = support.supporting(c, haps, 0, 30)
    assert got(support.support_matrix(s), "hap_id", "p", "support") == [(0, 14, 10), (1, 14, 5)]
    assert got(support.total_extension(s), "p", "total") == [(14, 10)]
    assert ("A" * 10, 0) in got(support.match_matrix(c, haps), "cseq", "hap_id")


def test_flow_and_consistency(spark):
    rows = [(h, p, v) for h, vs in {0: [500, 500, 500], 1: [500, 5, 500], 2: [500, 4, 500], 3: [1, 9, 9], 4: [500, 500, 4]}.items() for p, v in enumerate(vs)]
    full = df(spark, rows, "hap_id int, p int, support long")
    assert got(support.flow_consistency(full), "hap_id") == [(0,), (1,)]
    assert got(support.local_consistency(full), "hap_id") == [(0,), (1,), (2,), (4,)]
    h = df(spark, [(i, 0.5) for i in range(5)], "hap_id int, h double")
    totals = df(spark, [(p, 1000) for p in range(3)], "p int, total long")
    assert dict(got(support.credibility_score(full, totals, h), "hap_id", "score"))[0] == 1.0
    assert math.isclose(dict(got(support.credibility_score(full, totals, h), "hap_id", "score"))[2], 0.008)


def test_model_choice(spark):
    fits = df(spark, [(1, 1, 1.0), (2, 2, 0.5), (3, 2, 0.6), (4, 3, 0.49), (5, 4, 0.1)], "fit_id int, k int, cost double")
    best = support.bucket_best(fits)
    assert got(best, "k", "fit_id") == [(1, 1), (2, 2), (3, 4), (4, 5)]
    assert got(support.elbow_pick(best), "k") == [(3,)]
    assert got(support.elbow_pick(best, before=True), "k") == [(2,)]
    assert got(support.elbow_pick(best.where("k = 1")), "k") == [(1,)]


def test_regression(spark):
    def pruned(sets, **kind):
        return local_pruned(spark, sets, **kind)

    g, r = np.eye(3), np.array([0.6, 0.3, 0.1])
    for h in (regress.stagewise(g, r, 0.0, 1e-3), regress.lagrangian(g, r, 0.0, 1), regress.refit(g, r, 0.001, 2)):
        assert math.isclose(h.sum(), 1, abs_tol=1e-6) and np.allclose(h, r, atol=5e-3)
    assert np.allclose(regress.lagrangian(np.ones((1, 1)), np.ones(1), 0.1, 1), [1])
    assert math.isclose(regress.lagrangian(np.ones((2, 2)), np.ones(2), 0.0, 3).sum(), 1)
    assert math.isclose(regress.largest_eigenvalue(np.diag([1.0, 5.0])), 5, rel_tol=1e-2)
    assert pruned([(["a", "b"], np.eye(2), np.array([1.0, 0.0]))] * 2, most=3) == [["a"], ["a"]]
    with pytest.raises(RuntimeError):
        pruned([(["a", "b"], np.eye(2), np.array([0.5, 0.5]))], most=1, rounds=2)


def local_pruned(spark, sets, **kind):
    rows = [(i, ids, bytearray(np.ascontiguousarray(g, dtype=float).tobytes()), bytearray(np.asarray(r, dtype=float).tobytes()), 1.0) for i, (ids, g, r) in enumerate(sets)]
    left = regress.local_prune(df(spark, rows, "region int, ids array<string>, g binary, r binary, yy double"), **kind)
    return [sorted(x.hap_id for x in left.where(f"region = {i}").collect()) for i in range(len(sets))]


def test_windows(spark):
    w = cluster.window_grid(spark, 1, 5, 4, 4)
    assert got(w, "window_id", "w_start", "w_end") == [(0, 1, 5), (1, 5, 9)]
    r = reads(spark, (1, "ACGT", 1), (2, "ACGT", 1), (4, "ACGTACGTACGTACGTACGT", 1))
    assert got(cluster.window_membership(r, w), "window_id", "start_pos") == [(0, 1)]


def test_sampler_separates_two_classes():
    codes = np.array([[0, 0, 0, 0]] * 6 + [[1, 1, 1, 1]] * 6)
    who, _ = cluster.sample_window(codes, np.ones(12), np.zeros(4, int), 40, 3, sweeps=30, burn_in=20)
    assert len(set(who[:6])) == 1 and len(set(who[6:])) == 1 and who[0] != who[6]


def test_distances(spark):
    haps = df(spark, [(0, "ACGTAC"), (1, "ACGTTT")], "hap_id int, seq string")
    d = evaluate.read_hap_distance(reads(spark, (5, "TT", 1), (5, "A.", 2), (3, "GT", 1)), haps)
    assert got(evaluate.nearest_haplotype(d), "seq", "hap_id", "dist") == [("A.", 0, 0), ("GT", 0, 0), ("TT", 1, 0)]
    assert got(evaluate.diversity(haps), "mean_dist") == [(2.0,)]


def test_text_layouts(spark, tmp_path):
    (tmp_path / "raw").write_text("a b c 7 e f g ACGT\nshort line\n")
    assert got(source.raw_paired(spark, str(tmp_path / "raw")), "start_pos", "seq") == [(7, "ACGT")]
    (tmp_path / "f.fasta").write_text(">one x\nACG\nT\n>two\nGG\n")
    assert got(source.fasta(spark, str(tmp_path / "f.fasta")), "hap_id", "name", "seq") == [(0, "one x", "ACGT"), (1, "two", "GG")]
    (tmp_path / "s.sam").write_text("@HD\n" + "\t".join(["r1", "0", "c", "5", "1", "2M", "*", "0", "0", "AC"]) + "\n")
    assert got(source.sam(spark, str(tmp_path / "s.sam")), "qname", "start_pos", "seq") == [("r1", 5, "AC")]
    (tmp_path / "p").write_text("3 5 9")
    assert got(source.positions(spark, str(tmp_path / "p")), "vi", "pos") == [(0, 3), (1, 5), (2, 9)]
    (tmp_path / "n").write_text("A_-")
    assert got(source.shared(spark, str(tmp_path / "n")), "pos", "base") == [(0, "A"), (1, "_"), (2, "-")]
    c = df(spark, [(1, 2, 4, "AC")], "cstart int, cend int, cnt long, cseq string")
    source.write_lines(c, ["cstart", "cend", "cnt", "cseq"], str(tmp_path / "c"))
    assert got(source.compact(spark, str(tmp_path / "c")), "cstart", "cend", "cnt", "cseq") == [(1, 2, 4, "AC")]
    (tmp_path / "e").write_text("4 2 ACG AC\n5 1 CC\n")
    assert got(source.corrected(spark, str(tmp_path / "e")), "start_pos", "cnt", "seq") == [(4, 2, "ACG"), (5, 1, "CC")]


def test_running_pileup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1").write_text("a b c 1 e f g AC\n")
    (tmp_path / "in/2").write_text("a b c 2 e f g CC\n")
    q = running_pileup(read_stream(spark, str(tmp_path / "in")), "running", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("running"), "pos", "n_a", "n_c") == [(0, 1, 0), (1, 0, 2), (2, 0, 1)]


def test_local_prune_steps_below_the_border(spark):
    r = np.array([0.6, 0.4, 0.0016])
    fine, coarse = regress.stagewise(np.eye(3), r, 0.001), regress.stagewise(np.eye(3), r, 0.001, 1e-3)
    assert fine[2] < regress.LEAST <= coarse[2]
    assert local_pruned(spark, [(list("abc"), np.eye(3), r)], most=3, rounds=2) == [["a", "b"]]


def test_normal_equations_of_regions_by_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.random((400, 40)) < 0.2
    p[:, 39] = False  # fits no read, so it has no place in the fit
    y = rng.random(400)
    region = np.arange(400) % 2
    matrix = df(spark, [(int(region[i]), int(i), "x", f"h{j:02d}") for i, j in zip(*np.nonzero(p), strict=True)], "region int, cstart int, cseq string, hap_id string")
    ys = df(spark, [(int(region[i]), int(i), "x", float(y[i])) for i in range(400)], "region int, cstart int, cseq string, y double")
    for row in regress.normal_equations(matrix, ys).collect():
        own = (region == row.region) & p.any(1)
        m = p[own].astype(float)
        on = np.flatnonzero(m.any(0))
        assert row.ids == [f"h{j:02d}" for j in on]
        assert np.array_equal(np.frombuffer(row.g).reshape(len(on), -1), m[:, on].T @ m[:, on])
        assert np.allclose(np.frombuffer(row.r), m[:, on].T @ y[own]) and math.isclose(row.yy, float(y[own] @ y[own]))


def test_fits_of_a_wide_region_run_in_tasks(spark):
    """600 haplotypes, shares of three: found again by fits whose reads are 30,000 but fall into few sets."""
    pairs = spark.range(30_000).select(F.col("id").cast("int").alias("cstart"), F.lit("x").alias("cseq"), F.explode(F.expr("array(cast(id % 600 as int), cast((id * 7 + 1) % 600 as int))")).alias("hap_id")).distinct()
    share = F.when(F.col("hap_id") == 5, 0.5).when(F.col("hap_id") == 77, 0.3).when(F.col("hap_id") == 400, 0.2).otherwise(0.0)
    y = pairs.groupBy("cstart", "cseq").agg(F.sum(share).alias("y"))
    assert regress.haplotype_sets(pairs, y).count() <= 600
    h = {r.hap_id: r.h for r in regress.fitted(regress.normal_equations(pairs, y), lambda g, r: regress.stagewise(g, r, step=1e-3)).collect()}
    assert len(h) == 600 and {k for k, v in h.items() if v > 0.05} == {5, 77, 400} and abs(h[5] - 0.5) < 0.05


@pytest.mark.parametrize("most_places", [1 << 20, 2])
def test_correction_of_short_and_long_genomes(spark, most_places):
    r = reads(spark, (1, "AN.-", 1), (1, "ACGT", 500), (3, "G", 7), (4, "TCC", 2), (4, "GCC", 300))
    fixed = pileup.corrected_reads(r, pileup.pileup(r), most_places=most_places)
    want = [("ACGT", "ACGT", False), ("AN.-", "AC.-", True), ("G", "G", False), ("GCC", "GCC", False), ("TCC", "TCC", False)]
    assert got(fixed, "seq", "corrected_seq", "changed") == want  # the fourth place varies and stays
    none = r.where("cnt < 0")
    assert pileup.corrected_reads(none, pileup.pileup(none), most_places=most_places).count() == 0


def planted(spark):
    """Thirty reads of each of two genomes of 12 places that differ in three, from places 1 to 12."""
    rows = [(1, f"{a}C{b}GAC{c}TACG{d}", 3) for a, b, c in (("A", "A", "A"), ("T", "T", "T")) for d in "ACGT"]
    return reads(spark, *rows), df(spark, [(0, 0), (1, 2), (2, 6)], "vi int, pos int"), df(spark, [(0, "A"), (1, "A"), (2, "A")], "vi int, base string")


def test_gibbs_assign_separates_planted_genomes(spark):
    r, variants, reference = planted(spark)
    windows = cluster.window_grid(spark, 1, 1, 12, 12)
    ids = pileup.read_ids(r)
    members, sites = cluster.window_membership(ids, windows), cluster.window_sites(windows, variants)
    found = cluster.gibbs_assign(cluster.site_bases(members, variants, sites), members, sites, reference, sweeps=60, burn_in=40)
    groups = {}
    for x in found.join(ids, "read_id").collect():
        groups.setdefault(x.class_id, set()).add(x.seq[0])
    assert sorted(map(tuple, groups.values())) == [("A",), ("T",)]
    voted = cluster.clustering_votes(ids, variants, windows, reference, sweeps=60, burn_in=40)
    assert got(voted, "seq", "voted_seq") == sorted((x.seq, x.seq) for x in r.collect())  # nothing to correct


def test_simulated_variants(spark):
    genome = "ACGT" * 50
    out = {x.variant_id: x.seq for x in simulate.simulate_variants(df(spark, [(0, genome), (1, "A")], "hap_id int, seq string"), n=3, diversity=0.05).collect()}
    assert sorted(out) == [1, 2, 3]
    changed = {k: [i for i, (a, b) in enumerate(zip(genome, seq, strict=True)) if a != b] for k, seq in out.items()}
    for places in changed.values():
        assert len(places) == 10 and all(b - a >= 3 for a, b in zip(places, places[1:]))
    shared = set(changed[1]) & set(changed[2]) & set(changed[3])
    assert len(shared) == 5 and all(out[1][p] == out[2][p] == out[3][p] for p in shared)
