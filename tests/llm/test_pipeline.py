import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from strandflow.llm import oracle, quality, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_order_and_on_all_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == columns
        docs = corpus_pipeline.staged(out, "test")
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] and seen[4] == seen[5]
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_token_file_edges(spark, tmp_path):
    from tokenizers import Tokenizer

    from strandflow.llm.queries import VOCABULARY, tokenizer_file

    library = Tokenizer.from_file(tokenizer_file())
    rows = [(5, "b a"), (None, "null id"), (1, None), (3, ""), (3, "Naïve, naïve.\n" * 400), (2, "x"), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokens.write_tokens(df, f"file://{tmp_path}/t", tokenizer_file(), vocabulary=VOCABULARY, block_tokens=50)
    got = sorted(tokens.read_tokens(spark, path, vocabulary=VOCABULARY).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 3, 5]
    sizes = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r.n_tokens for r in got) == sizes and got[-1].start + got[-1].n_tokens == sum(sizes)
    empty = tokens.write_tokens(df.limit(0), f"file://{tmp_path}/e", tokenizer_file(), vocabulary=VOCABULARY)
    assert tokens.read_tokens(spark, empty, vocabulary=VOCABULARY).count() == 0


def small_corpus(spark, tmp_path):
    """Junk, copies, benchmark passages, nulls, repeated rows, a long text, and columns named like the operators'."""
    rng = random.Random(11)
    words = ["the", "river", "runs", "under", "a", "stone", "bridge", "where", "children", "often", "wait", "for", "evening", "trains", "and", "light"]
    prose = lambda n: " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    question = " ".join(f"quiz{i}" for i in range(20))
    texts = [prose(rng.randrange(40, 90)) + "." for _ in range(60)]
    near = texts[3].split(" ")
    near[20] = "changed"
    texts += [texts[0], texts[0], " ".join(near), texts[5] + " " + question, question.upper() + " " + prose(30), prose(600) + " " + question + ".", "### $$$ %%% " * 30, "same line here\n" * 40, "a b", None, "", prose(900_000)]
    rows = [(i if i != 7 else None, t, "en", [None, "a", "b", "c"][i % 4], 1, f"S{i}", i, True, -1, "x", 0.5) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, SIZE string, target long, kept boolean, n_words int, Items string, source_size double")
    spark.createDataFrame([("q1", question), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, question


def plain_quality(votes, kinds, rounds=60, weight=20.0):
    """EM over single documents, as plain sums."""
    prior = [quality.PRIORS[k] for k in kinds]
    table, share = [p.copy() for p in prior], 0.8
    good = []
    for turn in range(rounds + 1):
        good = []
        for v in votes:
            like = [share, 1 - share]
            for t, x in zip(table, v, strict=True):
                like = [like[0] * t[1][x + 1], like[1] * t[0][x + 1]]
            good.append(like[0] / (like[0] + like[1]))
        if turn == rounds:
            return good
        share = min(max((sum(good) + 0.8 * weight) / (len(votes) + weight), 0.01), 0.99)
        for j, p in enumerate(prior):
            sums = [[sum((g if c else 1 - g) for g, v in zip(good, votes, strict=True) if v[j] == x - 1) + weight * p[c][x] for x in range(3)] for c in (0, 1)]
            table[j] = np.array([[x / sum(row) for x in row] for row in sums])


def similar(x, y):
    bag = lambda t: Counter(tuple(w[i : i + 5]) for w in [WORD.findall(t or "")] for i in range(max(1, len(w) - 4)) if w)
    a, b = bag(x), bag(y)
    both = sum((a & b).values())
    return bool(a) and bool(b) and both >= 0.8 * (a.total() + b.total() - both)


def key(r):
    return tuple(repr(x) for x in r)


def test_pipeline_by_brute_force(spark, tmp_path):
    docs, question = small_corpus(spark, tmp_path)
    now, columns = [tuple(r) for r in docs.collect()], docs.columns
    run = lambda k, rows: [tuple(r) for r in corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, docs.schema), str(tmp_path)).select(*columns).collect()]
    at = {c: i for i, c in enumerate(columns)}
    text, doc = (lambda r: r[at["text"]]), (lambda r: r[at["doc_id"]])

    judged = quality.weak_quality(spark.createDataFrame([(i, text(r)) for i, r in enumerate(now)], "doc_id long, text string")).collect()
    votes = [[{"-": -1, "0": 0, "+": 1}[x] for x in r.votes] for r in judged]
    p = plain_quality(votes, ["bad" if k in quality.BAD else "good" for k in quality.rules()])
    assert all(abs(r.p_good - x) < 1e-9 for r, x in zip(judged, p, strict=True))
    keep = {r.doc_id for r, x in zip(judged, p, strict=True) if x >= 0.5 and not r.base_failed}
    want = [r for i, r in enumerate(now) if i in keep]
    got = run(0, now)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) < len(now)

    now, ids = got, sorted({doc(r) for r in got if doc(r) is not None})
    least = {i: i for i in ids}
    links = [(doc(a), doc(b)) for k, a in enumerate(now) for b in now[:k] if doc(a) is not None and doc(b) is not None and len(text(a)) < 10**6 and len(text(b)) < 10**6 and similar(text(a), text(b))]
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    want = [r for r in now if doc(r) is None or least[doc(r)] == doc(r)]
    got = run(1, now)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) < len(now)

    now, fold = got, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    q = split(question)
    grams = {tuple(q[i : i + 13]) for i in range(len(q) - 12)}

    def dirty(t):
        w = split(t)
        hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in grams for j in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    want = [r for r in now if not dirty(text(r))]
    got = run(2, now)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) < len(now)

    now, con = got, duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(doc(r), text(r), r[at["source"]]) for r in now])
    mixed = {d: (size, taken) for d, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({oracle.SQL['op3_mix']})").fetchall()}
    got = run(3, now)
    often = Counter(doc(r) for r in got)
    rows = Counter(doc(r) for r in now)
    assert all(often[d] * mixed[d][0] == mixed[d][1] for d, n in rows.items() if n == 1)
    assert {key(r) for r in got} <= {key(r) for r in now}

    now = got
    library = Tokenizer.from_file(corpus_pipeline.tokenizer_file())
    read = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(now, docs.schema), str(tmp_path)).collect()
    of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted((-1 if doc(r) is None else doc(r), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in now for x in [of(text(r))])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in read) == want


def test_pipeline_of_no_documents(spark, tmp_path):
    docs, _ = small_corpus(spark, tmp_path)
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
