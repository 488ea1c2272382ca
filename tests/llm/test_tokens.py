import random

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import tokens
from strandflow.llm.queries import VOCABULARY, tokenizer_file


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    pool = ["The", "naïve.", "ÉÉ!!", "don't", "it's.", "a1b2", "Straße,", "x|y", "ΣΑΣ", "İstanbul", "éa", " x", "日本語", "<|endoftext|>", "...", "--", "AKIA99", "　", "ſ", "ǅ", "﻿", "🙂", "́", "1", "'s", "a's"]
    rng = random.Random(1)
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(400)] + ["", None, " \n", "".join(pool)]
    ids, at = tokens.Encoder(tokenizer_file()).encode(pa.array(texts))
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert ids[at[i] : at[i + 1]].tolist() == want, x


@pytest.mark.parametrize("seed", range(6))
def test_pack_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, 60) if seed else np.array([1])
    at = np.concatenate(([0], np.cumsum(lengths)))
    ids = rng.zipf(1.3 + seed / 5, at[-1]) % (3 if seed == 5 else 49000)
    ids[at[1:] - 1] = tokens.END
    got = tokens.pack(ids, at, VOCABULARY, least=3)
    assert tokens.expanded(got["packed"], got["rules"], got["sizes"], VOCABULARY).tolist() == ids.tolist()
    for k in range(len(lengths)):
        assert tokens.document(got, k, VOCABULARY).tolist() == ids[at[k] : at[k + 1]].tolist()
    if seed:
        assert len(got["packed"]) < 2 * len(ids)


def test_pack_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(9)
    one = np.concatenate((rng.permutation(49000)[:4000] + 2, [tokens.END]))
    at = np.arange(41) * len(one)
    ids = np.tile(one, 40)
    got = tokens.pack(ids, at, VOCABULARY)
    assert tokens.expanded(got["packed"], got["rules"], got["sizes"], VOCABULARY).tolist() == ids.tolist()
    assert len(got["packed"]) == 2 * 40  # a symbol a document


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_file(), encoding="utf-8") as f:
        known = json.load(f)
    known["normalizer"] = {"type": "Sequence", "normalizers": known["normalizer"]["normalizers"][:2]}  # no lower-casing
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(known, f)
    assert tokens.by_word(tokenizer_file()) and not tokens.by_word(path)
    texts = ["Hello World", None, "", "Naïve, ÉÉ!! x"]
    ids, at = tokens.Encoder(path).encode(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids + [1]


def test_file_gives_the_ids_of_the_library(spark, tmp_path):
    """Ids, places and checksums of a whole table, read back from its file, against the library on whole texts."""
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    path = tokens.write_tokens(df, f"file://{tmp_path}/t", tokenizer_file(), vocabulary=VOCABULARY, block_tokens=20_000)
    start = 0
    got = {r.doc_id: r for r in tokens.read_tokens(spark, path, vocabulary=VOCABULARY).collect()}
    for r in df.orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_ranges_follow_the_bytes():
    of = tokens.ranges_for
    assert of(0, 8) == of(1, 8) == 1 and of(9 << 20, 8) == 3 and of(1 << 28, 8) == 8 and of(1 << 35, 8) == 512
    assert of(10**14, 8000) == tokens.MOST_RANGES


def test_file_does_not_depend_on_the_number_of_ranges(spark, tmp_path):
    rows = [(i % 50 if i % 9 else None, f"one word and {i} more" * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    for k, task_bytes in enumerate((1 << 20, 300, 40)):
        path = tokens.write_tokens(df, f"file://{tmp_path}/t{k}", tokenizer_file(), vocabulary=VOCABULARY, task_bytes=task_bytes)
        parts = spark.read.parquet(path).select("part").distinct().count()
        assert (parts == 1) == (k == 0)
        found.append(sorted(map(tuple, tokens.read_tokens(spark, path, vocabulary=VOCABULARY).collect()), key=lambda r: r[1]))
    assert found[0] == found[1] == found[2]


def test_tasks_hold_few_texts_and_one_block(spark, tmp_path, monkeypatch):
    most, seen, cut, ranges_for, staged = tokens.ARROW_ROWS, [], tokens.sub_batches, tokens.ranges_for, tokens.staged

    def checked(batches, text_at, most_bytes):
        def each():
            for batch in batches:
                assert batch.num_rows <= most, batch.num_rows
                yield batch

        return cut(each(), text_at, most_bytes)

    monkeypatch.setattr(tokens, "sub_batches", checked)
    monkeypatch.setattr(tokens, "ranges_for", lambda n, cores, size: seen.append(size) or ranges_for(n, cores, size))
    monkeypatch.setattr(tokens, "staged", lambda df, name, rows: seen.append(rows) or staged(df, name, rows))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.range(3 * most).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    path = tokens.write_tokens(df, f"file://{tmp_path}/t", tokenizer_file(), vocabulary=VOCABULARY, block_tokens=2000)
    assert tokens.read_tokens(spark, path, vocabulary=VOCABULARY).count() == 3 * most
    assert seen == [16 << 20, 1] and spark.conf.get(key) == before


def test_words_that_come_again_are_encoded_once():
    encoder, seen = tokens.Encoder(tokenizer_file(), most=80), []
    model = encoder.model

    class Counted:
        def tokenize(self, word):
            seen.append(word)
            return model.tokenize(word)

    encoder.model = Counted()
    rare = [a + b for a in "abcdefghijklmno" for b in "pqrstuvwxyz"]
    for k in range(5):
        encoder.encode(pa.array([" ".join(["frequent", "words,", *rare[30 * k : 30 * k + 30]])]))
    assert seen.count("frequent") == seen.count("words") == 1 and len(seen) == 152
    assert len(encoder.letters) + len(encoder.letters_before) <= 80 + 32
