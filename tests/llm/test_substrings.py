import hashlib
import random
import re
from collections import Counter

import pytest

from strandflow.llm.substrings import remove_repeats


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        drop = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                drop.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in drop]
        out.append((len(w), len(drop), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: "é%d" % rng.randrange(3000)
    pool = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window, 8 * window]))] for _ in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += rng.choice([p, p[a:], p[:a], [word() for _ in range(rng.randrange(1, 90))]])
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    return texts + [None, "", "   ", texts[3], texts[3], "x " * 200, "y " * window, "y " * (window - 1), "a b " * window]


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 12)])
def test_equals_brute_force(spark, seed, window):
    texts = corpus(seed, window)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, window=window).collect()}
    assert got == dict(enumerate(brute(texts, window)))
    spans = {r.doc_id: sum(s.end - s.start for s in r.removed) for r in remove_repeats(df, window=window).collect()}
    assert spans == {i: v[1] for i, v in got.items()}


def test_edges_of_input(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(map(str, range(40)))
    rows = remove_repeats(spark.createDataFrame([(None, t), (None, "z " + t), (7, None), (7, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 40, 40), (0, 41, 40), (7, 0, 0), (7, 40, 40)]


def test_rows_of_one_id_do_not_meet_all_its_texts(spark):
    """Null ids, ids that repeat and equal rows among texts that share a passage, against brute force; a long text too."""
    rng = random.Random(8)
    word = lambda: "v%d" % rng.randrange(900)
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(rng.randrange(9))] + passage[rng.randrange(20) :] + [word() for _ in range(rng.randrange(9))]) for _ in range(150)]
    texts += texts[:20] + [" ".join(word() for _ in range(60_000)) + " " + " ".join(passage)]
    ids = [None if i % 3 else i % 10 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == Counter((i, *x) for i, x in zip(ids, brute(texts, 35)))
    many = spark.createDataFrame([(None, t) for t in texts[:120]] * 10, "doc_id long, text string")
    assert remove_repeats(many).where("n_words <> n_removed").count() == 0
