"""Joins whose small side is measured, ids in ranges, and the fit that is chosen."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions.seq import dense_ids
from strandflow.functions.tables import bytes_of, paired, sized
from strandflow.operators import evaluate, regress, support


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_bytes_of_a_table(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "é")], "n int, s string")
    assert bytes_of(df) == 3 * 2 * 8 + 3 + 2
    assert bytes_of(df.where("n > 9")) == 0


@pytest.mark.parametrize("most_bytes", [1 << 20, 100, 1])
def test_pairs_are_whole_at_any_size(spark, most_bytes):
    left = spark.createDataFrame([(i % 7, None if i % 5 == 0 else "x") for i in range(40)], "a int, b string")  # rows repeat
    right = spark.createDataFrame([(i, "y" * i) for i in range(9)] + [(3, "yyy"), (None, None)], "c int, d string")
    want = left.crossJoin(right)
    got = paired(left, right, most_bytes)
    key = lambda df: sorted(map(str, df.collect()))
    assert got.columns == want.columns and key(got) == key(want)
    plan = plan_of(got)
    assert ("BroadcastNestedLoopJoin" in plan) == (most_bytes == 1 << 20) and "CartesianProduct" not in plan
    assert paired(left, right.limit(0), most_bytes).count() == 0 == paired(left.limit(0), right, most_bytes).count()


def test_sized_is_a_hint_for_small_sides_only(spark):
    small = spark.range(10)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(sized(small)) and not hinted(sized(small, 79)) and hinted(sized(small, 80))


@pytest.mark.parametrize("most_bytes", [1 << 26, 10])
def test_distances_and_matches_do_not_depend_on_the_join(spark, monkeypatch, most_bytes):
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT-.") for _ in range(n))
    reads = [(rng.randint(1, 20), base(rng.randint(1, 12)), rng.randint(1, 5)) for _ in range(60)]
    haps = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice((20, 26, 30))))) for i in range(13)]
    for module in (evaluate, support):
        monkeypatch.setattr(module, "paired", lambda a, b: paired(a, b, most_bytes))
        monkeypatch.setattr(module, "sized", lambda a: sized(a, most_bytes), raising=False)
    r, h = spark.createDataFrame(reads, "start_pos int, seq string, cnt int"), spark.createDataFrame(haps, "hap_id int, seq string")
    far = lambda s, q, g: sum(a != b and a != "." for a, b in zip(q, g[s - 1 :], strict=False))
    assert rows(evaluate.read_hap_distance(r, h)) == sorted((s, q, c, i, far(s, q, g)) for s, q, c in reads for i, g in haps)
    compacted, known = r.select((F.col("start_pos") - 1).alias("cstart"), F.col("seq").alias("cseq"), "cnt"), h.withColumnRenamed("seq", "cseq")
    pairs = [[(a, b) for a, b in zip(q, g[s - 1 :], strict=False)] for s, q, c in reads for i, g in haps]
    counts = [(sum(a == b for a, b in p), sum(a not in (b, ".") for a, b in p), len(p)) for p in pairs]
    who = [(s - 1, q, c, i) for s, q, c in reads for i, g in haps]
    assert rows(support.compact_match(compacted, known)) == sorted(w + n for w, n in zip(who, counts, strict=True))
    near = evaluate.nearest_haplotype(evaluate.read_hap_distance(r, h)).distinct()
    want = {}
    for x in near.collect():
        g = dict(haps)[x.hap_id]
        for off, b in enumerate(x.seq):
            pos = x.start_pos + off - 1
            if b != "." and pos < len(g):
                n = want.setdefault((pos, x.hap_id), [0, 0])
                n[b != g[pos]] += 1
    assert rows(evaluate.mismatch_profile(near, h)) == sorted((*k, *v) for k, v in want.items())


def test_ids_of_one_start_lie_in_several_ranges(spark):
    """All reads but few have one start: ids are those of a plain sort, and no range holds the start alone."""
    rng = random.Random(4)
    reads = list({(5 if i % 50 else rng.randint(1, 9), "".join(rng.choice("ACGT") for _ in range(9))) for i in range(20_000)})
    df = spark.createDataFrame(reads + [(None, "A"), (5, None)], "start_pos int, seq string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        out = dense_ids(df, "start_pos", ["seq"], "id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = {(r.start_pos, r.seq): r.id for r in out.collect()}
    order = sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [got[x] for x in order] == list(range(len(reads) + 2))
    written = spark.read.parquet(spark._strandflow_staged[-1])
    held = written.where("start_pos = 5").groupBy(F.input_file_name()).count().collect()
    assert len(held) >= 3 and max(r["count"] for r in held) < 0.5 * len(reads)
    assert dense_ids(df.limit(0), "start_pos", ["seq"], "id").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_solution_by_brute_force(spark, seed):
    """The elbow over the best fit of each number of haplotypes, in plain Python."""
    rng = random.Random(seed)
    fits = [(f, h, rng.choice((0.0, 1e-9, 0.2, 0.5)), rng.choice((0.1, 0.2, 0.21, 0.5))) for f in range(9) for h in range(4)]
    cost = {f: c for f, _, _, c in fits}
    k = {f: sum(x > regress.LEAST for g, _, x, _ in fits if g == f) for f in cost}
    best = {n: min((cost[f], f) for f in cost if k[f] == n) for n in set(k.values())}
    order = sorted(best)
    pick = next((b for a, b in zip(order, order[1:], strict=False) if best[b][0] > 0.9 * best[a][0]), order[-1])
    want = sorted((h, x, f"s{h}") for f, h, x, _ in fits if f == best[pick][1] and x > regress.LEAST)
    df = spark.createDataFrame([(f, h, x, cost[f], k[f]) for f, h, x, _ in fits], "fit_id int, hap_id int, h double, cost double, k int")
    haps = spark.createDataFrame([(h, f"s{h}") for h in range(4)], "hap_id int, cseq string")
    assert rows(regress.solution(df, haps)) == want
