"""The stage store, ordered files, mates by name, and joins by bins and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import cluster, compact, pileup
from strandflow.sources import reads as source
from strandflow.sources import sinks
from strandflow.sources.stages import StageStore


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_store_goes_on_with_missing_parts(spark, tmp_path):
    store, made = StageStore(spark, f"file://{tmp_path}/store"), []

    def make(parts, fail=()):
        made.extend(parts)
        df = spark.createDataFrame([(p, f"v{p}") for p in parts if p != 4], "window_id int, v string")
        bad = F.expr("cast(raise_error('killed') as string)")
        return df.withColumn("v", F.when(F.col("window_id").isin(list(fail)), bad).otherwise(F.col("v"))) if fail else df

    schema = "window_id int, v string"
    assert store.read("votes", schema, "window_id").count() == 0
    with pytest.raises(Exception, match="killed"):
        store.resumed("votes", schema, "window_id", list(range(7)), lambda p: make(p, [5]), at_a_time=2)
    assert store.finished("votes") == {"0", "1", "2", "3"} and made == [0, 1, 2, 3, 4, 5]
    assert rows(store.read("votes", schema, "window_id")) == [(i, f"v{i}") for i in range(4)]  # nothing of the killed job
    made.clear()
    got = store.resumed("votes", schema, "window_id", list(range(7)), make, at_a_time=2)
    assert made == [4, 5, 6] and rows(got) == [(i, f"v{i}") for i in range(7) if i != 4]
    made.clear()
    assert rows(store.resumed("votes", schema, "window_id", [1, 4], make)) == [(1, "v1")] and not made
    store.write("votes", spark.createDataFrame([(1, "new")], schema), "window_id", [1])
    assert (1, "new") in rows(store.read("votes", schema, "window_id")) and (1, "v1") not in rows(store.read("votes", schema, "window_id"))
    plan = store.read("votes", schema, "window_id").where("window_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(window_id" in plan


def test_votes_of_windows_go_on(spark, tmp_path, monkeypatch):
    seqs = [(1 + 4 * i, f"{a}C{b}GAC{c}TACG{d}", 3) for i in range(3) for a, b, c in (("A", "A", "A"), ("T", "T", "T")) for d in "ACGT"]
    reads = spark.createDataFrame(seqs, "start_pos int, seq string, cnt long")
    variants = spark.createDataFrame([(i, p) for i, p in enumerate((0, 2, 4, 6, 8, 10, 14))], "vi int, pos int")
    reference = spark.createDataFrame([(i, "A") for i in range(7)], "vi int, base string")
    ids, windows = pileup.read_ids(reads), cluster.window_grid(spark, 1, 9, 12, 4)
    want = rows(cluster.clustering_votes(ids, variants, windows, reference, sweeps=12, burn_in=6))
    store, seen, plain = StageStore(spark, f"file://{tmp_path}/votes"), [], cluster.gibbs_assign

    def counted(bases, members, sites, ref, **kind):
        seen.append(sorted(r.window_id for r in sites.select("window_id").collect()))
        if len(seen) == 2:
            raise RuntimeError("killed")
        return plain(bases, members, sites, ref, **kind)

    monkeypatch.setattr(cluster, "gibbs_assign", counted)
    run = lambda: cluster.resumed_votes(store, "votes", ids, variants, windows, reference, windows_a_job=1, sweeps=12, burn_in=6)
    with pytest.raises(RuntimeError):
        run()
    assert store.finished("votes") == {"0"}
    assert rows(run()) == want
    assert seen == [[0], [1], [1], [2]]


def test_ordered_files_keep_their_numbers(spark, tmp_path):
    n = 5000
    df = spark.range(n).select(F.col("id"), F.expr("cast(pmod(hash(id), 1000) as string)").alias("v")).repartition(7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # several splits a file, several files a task
    try:
        sinks.write_ordered(df, F.concat_ws(" ", "id", "v"), ["id"], f"file://{tmp_path}/lines", parts=5)
        got = sinks.read_ordered(spark, f"file://{tmp_path}/lines").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.row, int(r.value.split(" ")[0])) for r in got) == [(i, i) for i in range(n)]
    sinks.write_ordered(df.where("id < 0"), F.col("v"), ["id"], f"file://{tmp_path}/none")
    assert sinks.read_ordered(spark, f"file://{tmp_path}/none").count() == 0


def test_round_trips(spark, tmp_path):
    rng, at = random.Random(1), lambda name: f"file://{tmp_path}/{name}"
    votes = [(i, rng.randrange(90), rng.randrange(1, 9), None if i % 3 == 0 else "".join(rng.choice("ACGT-") for _ in range(5))) for i in range(300)]
    sinks.write_votes(spark.createDataFrame(votes, "read_id long, start_pos int, cnt long, votes string").repartition(4), at("votes"))
    assert sorted(map(tuple, sinks.read_votes(spark, at("votes")).collect()), key=repr) == sorted(votes, key=repr)
    lineage = [(c, r) for c in range(50) for r in (rng.sample(range(1000), 3) if c % 4 else [None])]
    sinks.write_tracker(spark.createDataFrame(lineage, "cread_id long, raw_id long"), at("tracker"))
    assert rows(sinks.read_tracker(spark, at("tracker"))) == sorted(x for x in lineage if x[1] is not None)
    places = [(i, 7 * i + 2) for i in range(40)]
    sinks.write_positions(spark.createDataFrame(places, "vi int, pos int"), at("positions"))
    assert rows(source.positions(spark, at("positions"))) == places
    solution = [(0.5, "ACG"), (0.3, "CCC"), (0.2, "AAA")]
    sinks.write_solution(spark.createDataFrame(solution[::-1], "h double, cseq string"), at("solution"))
    assert rows(sinks.read_solution(spark, at("solution"))) == [(i, *x) for i, x in enumerate(solution)]
    flags = [(i, rng.random() < 0.5) for i in range(200)]
    sinks.write_flags(spark.createDataFrame(flags, "read_id long, changed boolean").repartition(3), at("flags"))
    assert rows(sinks.read_flags(spark, at("flags"))) == flags
    matrix = [(10 * i, h) for i in range(60) for h in sorted(rng.sample(range(9), 1 + i % 3))]
    y = [(10 * i, rng.random()) for i in range(60)]
    sinks.write_matrix(spark.createDataFrame(matrix, "read_id long, hap_id int"), spark.createDataFrame(y, "read_id long, y double"), at("matrix"))
    got_matrix, got_y = sinks.read_matrix(spark, at("matrix"))
    assert rows(got_matrix) == matrix and rows(got_y) == y


def test_mates_by_name(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:g\tLN:99", "@PG\tID:x", "@CO\tfour header lines"]
    sam = {
        "gap": [(1, "ACG"), (6, "TT")],
        "touch": [(1, "ACG"), (4, "TT")],
        "over": [(1, "ACGT"), (3, "GTNA")],
        "inside": [(1, "ACGTAC"), (2, "CG")],
        "late first": [(6, "TT"), (1, "ACG")],
        "same start": [(2, "ACGT"), (2, "AC")],
        "single": [(9, "NAC")],
    }
    reads = [(name.replace(" ", "_"), *r) for name, own in sam.items() for r in own]
    random.Random(3).shuffle(reads)
    lines += [f"{q}\t0\tg\t{s}\t60\t*\t=\t0\t0\t{seq}\t*" for q, s, seq in reads]
    (tmp_path / "r.sam").write_text("\n".join(lines) + "\n")
    aligned = source.sam(spark, f"file://{tmp_path}/r.sam")
    want = [(1, "ACG..TT", 2), (1, "ACGTAC", 1), (1, "ACGT-A", 1), (1, "ACGTT", 1), (2, "ACGT", 1), (9, "-AC", 1)]
    assert rows(pileup.fragments(aligned), "start_pos", "seq", "cnt") == sorted(want)
    every = pileup.fragments(aligned, with_mates=True)
    assert every.agg(F.sum("cnt")).first()[0] == 7 + 12
    three = aligned.union(spark.createDataFrame([("over", 7, "A")], "q string, s int, x string"))
    with pytest.raises(Exception, match="more than two reads named over"):
        pileup.fragments(three).collect()
    assert pileup.fragments(aligned.where("start_pos < 0")).count() == 0


def test_windows_by_bins(spark):
    rng = random.Random(2)
    reads = [(rng.choice("xy"), rng.randrange(1, 900), "A" * rng.randrange(0, 120), 1 + i) for i in range(300)]
    windows = [(i, c, s, s + n) for i, (c, s, n) in enumerate((rng.choice("xy"), rng.randrange(1, 900), rng.choice([30, 100, 400])) for _ in range(25))]
    df = spark.createDataFrame(reads, "contig string, start_pos int, seq string, cnt int")
    grid = spark.createDataFrame(windows, "window_id int, contig string, w_start int, w_end int")
    inside = lambda s, n, a, b: n > 0 and (n - max(0, a - s) - max(0, s + n - b)) / n > 0.75
    want = sorted((w, c) for w, g, a, b in windows for h, s, q, c in reads if g == h and inside(s, len(q), a, b))
    for width in (16, 256):
        got = cluster.window_membership(df, grid, width=width)
        assert rows(got, "window_id", "cnt") == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_by_ranges(spark):
    rng = random.Random(4)
    sites = sorted(rng.sample(range(2000), 60))
    variants = spark.createDataFrame(list(enumerate(sites)), "vi int, pos int")
    places = [rng.randrange(-50, 2200) for _ in range(400)] + [sites[0]] * 5
    df = spark.createDataFrame([(x,) for x in places], "x int")
    want = sorted((x, next((i for i, p in enumerate(sites) if p >= x), len(sites) - 1)) for x in places)
    for width in (7, 100, 1 << 16):
        got = compact.asof_variant(df, variants, width=width)
        assert rows(got, "x", "vi") == want
        assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.vi for r in compact.asof_variant(df, variants.where("vi < 0")).collect()} == {None}
