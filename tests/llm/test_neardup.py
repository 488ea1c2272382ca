import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strandflow.llm import neardup


def bag(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    """Brute force: components of all pairs at 0.8 or more."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 30, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(15)]
    texts += [None, "", " \n", "a", "a", "spam " * 300, "spam " * 310, "spam " * 100, "a b c d e " * 40, "a b c d e " * 44]
    return texts


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
        got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(df).collect()}
        want = classes(texts)
        assert {i: c for i, (c, _) in got.items()} == dict(enumerate(want))
        assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in neardup.near_duplicates(some).collect()) == [(0, 0, True), (1, 1, True), (2, 1, False)]
    names = spark.createDataFrame([("x", "a b c d e f"), ("y", "a b c d e f"), ("z", "q")], "doc_id string, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(names).collect()} == {"x": "x", "y": "x", "z": "z"}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    m, off = 240, []
    for _ in range(60):
        a = Counter({int(x): int(c) for x, c in zip(rng.integers(0, 120, 60), rng.integers(1, 40, 60))})
        b = Counter({k: max(1, v + int(rng.integers(-6, 6))) for k, v in a.items() if rng.random() < 0.9})
        true = sum((a & b).values()) / sum((a | b).values())
        h, d, w = [], [], []
        for doc, x in enumerate((a, b)):
            h += [hash((k, 7)) & (2**63 - 1) for k in x]
            d += [doc] * len(x)
            w += list(x.values())
        sig = neardup.bag_min_hash(neardup.mixed(np.array(h, np.uint64)), np.array(d), np.array(w), 2, m)
        off.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(off)) < 0.012
    assert np.std(off) < 0.05


def test_batches_do_not_matter():
    texts = pa.array(corpus(5))
    h, of, *_ = neardup.shingles(texts)
    for i in range(len(texts)):
        one, _, *_ = neardup.shingles(texts[i : i + 1])
        assert sorted(one.tolist()) == sorted(h[of == i].tolist())


def test_copies_that_only_their_origin_links(spark):
    """Edited copies near their origin but not near each other: classes hang on the pairs with one member of 1,201."""
    rng = random.Random(11)
    base = ["w%d" % rng.randrange(4000) for _ in range(400)]
    texts = []
    for c in range(1200):
        copy = list(base)
        for k in range(7):
            copy[rng.randrange(50 * k + 10, 50 * k + 50)] = f"c{c}x{k}"
        texts.append(" ".join(copy))
    texts.insert(700, " ".join(base))
    bags = [bag(t) for t in texts]
    share = lambda i, j: sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values())
    assert min(share(i, 700) for i in range(len(texts))) >= 0.8 and max(share(0, j) for j in range(1, 300)) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in neardup.near_duplicates(df).collect()} == {0}


def test_no_pair_of_a_bucket_is_left_out(spark):
    """Without leader rounds, and in blocks of few members, all classes must come from the pairs of the buckets."""
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, rounds=0, block=3).collect()}
    assert got == dict(enumerate(classes(texts)))
