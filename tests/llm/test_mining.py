"""Phrases, centroids and near vectors against brute force, with the edges that their docstrings name."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import centroids, phrases, vectors

# ---- phrases ----


def brute_phrases(rows, least=10, longest=3, percent=50, most=2000):
    f, n = defaultdict(Counter), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, own in f.items():
        kept = []
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        for p, a in candidates.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most])}
    return out


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["New", "york", "new", "of", "the", "naïve", "É", "é", "a", "x y", "\x1f", "the"]
    made = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]
    return made + [(None, "en"), ("", None), (" \n ", "fr"), ("Only once", "zz"), ("z " * 40 + "z", "en"), *[("new york of the", "en")] * 15]


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_phrases_by_brute_force(spark, shard_bytes):
    rows = texts(3)
    df = spark.createDataFrame([(t, g, "x", 7) for t, g in rows], "text string, lang string, phrase string, A int").repartition(5)
    got = {tuple(r) for r in phrases.collocations(df, shard_bytes=shard_bytes).collect()}
    assert got == brute_phrases(rows)
    longer = {tuple(r) for r in phrases.collocations(df, longest=5, least=4, most=40, shard_bytes=shard_bytes).collect()}
    assert longer == brute_phrases(rows, least=4, longest=5, most=40)
    two = {tuple(r) for r in phrases.collocations(df, longest=2, shard_bytes=shard_bytes).collect()}
    assert two == brute_phrases(rows, longest=2)


def test_phrases_of_nothing_and_of_a_long_text(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400_000)) + "."
    rows = [(long, "en"), ("a b", "en")]
    got = {tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), shard_bytes=1 << 16).collect()}
    assert got == brute_phrases(rows)


def test_packed_and_sorted_bitmaps_agree():
    rng = np.random.default_rng(1)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 5000) % 300]
    n, names, counts, places, bits = phrases.bitmaps(pa.array([" ".join(words)]))
    assert (counts.astype(np.int64) * phrases.DENSE >= n).any() and (counts.astype(np.int64) * phrases.DENSE < n).any()
    maps = phrases.Bitmaps(n, counts, places, bits, np.arange(len(names)), 3)
    names = names.to_pylist()
    got = {(names[a - 1], names[b - 1]): c for a, b, c in zip(*maps.pairs(), strict=True)}
    assert got == Counter(zip(words, words[1:], strict=False))


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 3 * 10**9), ("en", "a", 1, 4 * 10**9), ("en", "b", 1, 5 * 10**9)], "lang string, phrase string, m int, f long")
    total = spark.createDataFrame([("en", 10**10)], "lang string, n long")
    made, phrases.counted_phrases = phrases.counted_phrases, lambda *_, **__: (counts, total)
    try:
        row = phrases.collocations(counts).collect()
    finally:
        phrases.counted_phrases = made
    assert [tuple(r) for r in row] == [("en", 1, "a b", 3 * 10**9, 4 * 10**9, 5 * 10**9, 10**10, 450_000)]


# ---- centroids ----


def brute_centroids(rows, dims, k, rounds, scale):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in start]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((dist(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        who = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), w in zip(kept, who, strict=True) if w == j]
            if own:
                c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
        c = list(c)
    last = [(i, *near(x)) for i, x in kept]
    spread = Counter()
    for _, d, j in last:
        spread[j] += d
    fit = lambda v: v if v < 1 << 63 else None
    return sorted(((i, j, fit(d), fit(spread[j]), fit(sum(spread.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


@pytest.mark.parametrize("wide", [False, True])
def test_centroids_by_brute_force(spark, wide):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-2, 0, 3]) + rng.gauss(0, 0.5) for _ in range(6)]) for i in range(120)]
    rows += [(7, rows[3][1]), (200, rows[3][1]), (None, rows[4][1]), (201, None), (202, []), (203, [1.0] * 5), (204, [None] + [0.0] * 5), (205, [float("nan")] * 6), (206, [float("inf")] * 6), (207, [-0.0] * 6)]
    if wide:  # past 2^53 in the expansion, and past 2^63 in the distance
        rows += [(300 + i, [v * 2.0**24 for v in rows[i][1]]) for i in range(10)] + [(400, [3e30] * 6), (401, [-3e30, 1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, Cluster int").repartition(3)
    got = centroids.centroid_clusters(df, dims=6, k=5, rounds=4, block=16).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_centroids(rows, 6, 5, 4, 1024)


def test_centroids_of_few_and_of_none(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in centroids.centroid_clusters(few, dims=2).collect()), key=repr) == brute_centroids([(1, [1, 2]), (2, [1, 2]), (3, [5, 5])], 2, 8, 10, 1024)
    assert centroids.centroid_clusters(few.limit(0), dims=2).count() == 0


def test_ties_go_to_the_smaller_number_and_blocks_change_nothing():
    x = np.array([[0.0, 0.0], [2.0**30, 1.0]])
    assert centroids.squared_distances(x, [[1, 0], [0, 1], [-1, 0]]).argmin(1).tolist() == [0, 0]
    huge = centroids.squared_distances(x, [[2**60, 3], [1, 2**31]])
    assert huge[1].tolist() == [(2**30 - 2**60) ** 2 + 4, (2**30 - 1) ** 2 + (1 - 2**31) ** 2]


# ---- vectors ----


def brute_vectors(rows, least=0.98):
    usable = lambda x, g: g is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, x, g), (_, y, h) = rows[i], rows[j]
            if g == h and usable(x, g) and usable(y, h) and len(x) == len(y):
                p, q = (np.array(v, dtype=np.float64) / np.abs(np.array(v, dtype=np.float64)).max() for v in (x, y))
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= least:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least_id = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least_id, rows[i][0] == least_id))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [7, 2048])
def test_vectors_by_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 8))
    rows = [(int(i), (centre[i % 12] + rng.standard_normal(8) * rng.choice([0.02, 0.08, 0.15, 0.6])).astype(np.float32).tolist(), int(rng.choice([1, 1, 2]))) for i in range(220)]
    rows += [(500 + i, rows[5][1], 1) for i in range(20)] + [(5, rows[6][1], 1), (6, rows[6][1], None), (None, rows[7][1], 1)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 8, 1), (603, [0.0] * 8, 1), (604, [None] + [1.0] * 7, 1), (605, [float("nan")] * 8, 1), (606, [float("inf")] * 8, 1), (607, [1.0] * 3, 1), (608, [1.0] * 3, 1), (609, [1e-30] * 8, 3), (610, [1e30] * 8, 3), (None, [0.0] * 8, 1)]
    df = spark.createDataFrame([(i, x, g, "clash") for i, x, g in rows], "vec_id long, embedding array<float>, label int, node string").repartition(4)
    want = brute_vectors([(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], g) for i, x, g in rows])
    got = sorted((tuple(r) for r in vectors.near_vectors(df, tile=tile).collect()), key=repr)
    differ = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not (a[0] is None and a[2] is None and b[2] is None)]
    assert not differ
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_bounds_hold_and_nothing_is_ruled_out_wrongly():
    rng = np.random.default_rng(4)
    for dims in (3, 64, 1500):
        x = vectors.scaled(np.concatenate((rng.standard_normal((60, dims)), rng.standard_cauchy((60, dims)), np.eye(dims)[:2] * 1e-200)))
        u = vectors.units(x)
        block = vectors.quantised(u)
        assert (vectors.upper_bounds(block, block) >= u @ u.T - 1e-12).all()
        base = u[:30] + rng.standard_normal((30, dims)) * 0.2 / np.sqrt(dims)
        both = np.concatenate((u[:30], vectors.units(base)))
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if both[i] @ both[j] >= 0.98}
        got = [(i, j) for p, q in vectors.linked(both, both, vectors.quantised(both), vectors.quantised(both), 0.98, True) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
        assert set(got) == want and len(got) == len(want)
