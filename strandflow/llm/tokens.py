"""Token-id output: texts as ids of a public tokenizer, packed by Re-Pair, in a format that can be read at any document.

Format.  A table of blocks (a Parquet file holds one column chunk per field; any Spark file system takes it).  A block
holds the ids of consecutive documents in ascending order of id, each document followed by ``END``.  Re-Pair replaces
frequent pairs of ids by nonterminals until no pair is frequent or the 16-bit symbols run out; fields of a block:

  part, block      order of the block (parts hold disjoint, ascending id ranges; see ``starts``)
  first_id, tie    key of its first document
  n_tokens         ids in the block
  ids              document ids (array)
  lengths          uint32 per document: ids it expands to, END included
  places           uint32 per document: where it begins in ``packed``
  rules            two uint16 per rule: what nonterminal FIRST + r stands for
  sizes            uint32 per rule: the length it expands to
  packed           uint16 per symbol

Pairs never cross the end of a document, so a document is decoded from ``packed[places[i]:places[i + 1]]`` alone.

Re-Pair is run in rounds: each counts all pairs, takes the most frequent ones of which no symbol is a left part of one
and a right part of another (so occurrences can't overlap) and replaces them at once; runs of one symbol are paired
from their left end.

Defined results: a null or empty text is END alone; equal ids are ordered by a hash of their text; null ids come
first; an empty table gives no block; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from math import ceil
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_ROWS, arrow_rows, lean, new_path, staged, sub_batches, words_of

END = 1
#: Text of a task where memory is no matter, and of about one block; tasks, whose bounds the driver draws from a sample of ids.
#: A task holds a block at a time, whatever its range.
TASK_BYTES, BLOCK_BYTES, MOST_RANGES = 64 << 20, 4 << 20, 20_000
#: What a task holds beside its block: the range's text, which it fetches and sorts whole, rows of blocks in an Arrow batch
#: (of texts: ``ARROW_ROWS``) and text encoded at once.
RANGE_BYTES, BLOCK_ROWS, ENCODED_BYTES = 16 << 20, 1, 2 << 20


#: The tokenizer steps for which ids follow word by word; fixed values of the file format.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False}
#: Letters that NFC leaves as they are and that have one lower-case letter.
_LATIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"


def by_word(file: str) -> bool:
    """Whether a tokenizer file has exactly the steps for which a text's ids are its words' ids in a row."""
    with open(file, encoding="utf-8") as f:
        known = json.load(f)
    blank = any(" " in t["content"].strip() or t.get("lstrip") or t.get("rstrip") for t in known.get("added_tokens", []))
    model = known.get("model", {})
    return known.get("normalizer") == _NORMALIZER and known.get("pre_tokenizer") == _PRE_TOKENIZER and not blank and all(model.get(k, v) == v for k, v in _PLAIN_MODEL.items())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _gathered(flat: np.ndarray, where: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[where[i]:where[i] + size[i]]`` of all ``index`` in a row, and where each begins (one more at the end)."""
    run = size[index]
    before = np.concatenate(([0], np.cumsum(run)))
    return flat[np.arange(before[-1]) + np.repeat(where[index] - before[:-1], run)], before


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist


def _cut(words: pa.Array, lo: np.ndarray, hi: np.ndarray, index: np.ndarray) -> pa.Array:
    """Of the words ``index`` the bytes from ``lo`` to ``hi``."""
    words = words.cast(pa.large_string())
    where = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words)]
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    flat, before = _gathered(raw, where + lo, hi - lo, index)
    return pa.LargeStringArray.from_buffers(len(index), pa.py_buffer(before), pa.py_buffer(flat))


class Encoder:
    """A tokenizer file's encoding of whole texts.

    With a tokenizer that is known to work word by word (``by_word``) each distinct word between ASCII blanks is encoded
    once: no pre-token crosses a blank.  Of Latin letters with marks behind them it makes two pre-tokens, so their ids
    follow from those of the lower-cased letters, which go straight to the library's BPE model, and of the marks; all
    other words go through the whole tokenizer.  With any other file whole texts go through the library."""

    def __init__(self, file: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.by_word = Tokenizer.from_file(file), most, by_word(file)
        self.model = self.tokenizer.model
        self.letters: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.letters_before: dict[str, bytes] = {}  # words of the time before: those met again move on, the rest is forgotten

    def _whole(self, word: str) -> bytes:
        got = self.others[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return got

    def _bpe(self, word: str) -> bytes:
        got = self.letters_before.get(word)
        if got is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            got = array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()
        self.letters[word] = got
        return got

    def _forget(self) -> None:
        """Makes room when half of ``most`` words are new; words of the last batches and those that come again stay."""
        if len(self.letters) > self.most // 2:
            self.letters_before, self.letters = self.letters, {}
        if len(self.others) > self.most // 4:
            self.others = {}

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin (one more at the end)."""
        core = pc.utf8_rtrim(words, characters=punctuation)
        plain = pc.match_substring_regex(core, _LATIN)
        is_plain = np.asarray(plain.to_numpy(zero_copy_only=False), dtype=bool)
        n_core, n_word = (np.asarray(pc.binary_length(x), dtype=np.int64) for x in (core, words))
        marked = is_plain & (n_core != n_word)
        low = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        tails = _cut(words, n_core, n_word, np.flatnonzero(marked)).dictionary_encode()
        letters, others, bpe, whole = self.letters.get, self.others.get, self._bpe, self._whole
        parts = [b""]
        parts += [letters(w) or bpe(w) for w in _strings(low.dictionary)]
        n_low = len(parts)
        parts += [others(w) or whole(w) for w in _strings(tails.dictionary)]
        n_tail = len(parts)
        parts += [others(w) or whole(w) for w in _strings(words.filter(pa.array(~is_plain)))]
        size = np.fromiter((len(p) >> 2 for p in parts), dtype=np.int64, count=len(parts))
        where = np.concatenate(([0], np.cumsum(size)[:-1]))
        pieces = np.zeros((len(words), 2), dtype=np.int64)  # a word's core (or all of it) and its marks
        pieces[is_plain, 0] = 1 + np.asarray(low.indices, dtype=np.int64)
        pieces[marked, 1] = n_low + np.asarray(tails.indices, dtype=np.int64)
        pieces[~is_plain, 0] = n_tail + np.arange(len(parts) - n_tail)
        flat, before = _gathered(np.frombuffer(b"".join(parts), dtype=np.uint32), where, size, pieces.ravel())
        return flat, before[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a batch of texts, each followed by END, and where each begins (one more at the end)."""
        self._forget()
        if self.by_word:
            words, starts = words_of(texts)
            flat, where = self._words(words.dictionary)
            ids, before = _gathered(flat, where[:-1], np.diff(where), np.asarray(words.indices, dtype=np.int64))
            before = before[starts]
        else:
            got = [x.ids for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            ids, before = np.array([i for x in got for i in x], dtype=np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
        at = before + np.arange(len(before))  # END of the documents before
        out = np.full(int(at[-1]), END, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(before) - 1), np.diff(before))] = ids
        return out, at


def pack(ids: np.ndarray, at: np.ndarray, first: int, least: int = 12, most: int = 6000) -> dict:
    """Re-Pair of the ids of a block whose documents begin at ``at``: packed, places, rules and sizes.

    Ends when no pair occurs ``least`` times or all symbols of 16 bits are used."""
    seq = ids.astype(np.uint16)
    left, right = np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    starts = np.zeros(len(seq), dtype=bool)  # the first symbol of a document is never a right part
    starts[at[:-1]] = True
    while True:
        room = min(most, 65536 - first - len(left))
        if len(seq) < 2 or room <= 0:
            break
        inner = ~starts[1:]
        key = (seq[:-1].astype(np.uint32) << 16) | seq[1:]
        ordered = np.sort(key[inner])
        if not len(ordered):
            break
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.concatenate((heads, [len(ordered)])))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        good = good[np.argsort(-counts[good], kind="stable")][:room]
        chosen, role = [], {}
        for pair in ordered[heads[good]].tolist():
            a, b = pair >> 16, pair & 65535
            if a == b:
                if a not in role:
                    role[a] = "run"
                    chosen.append(pair)
            elif role.setdefault(a, "left") == "left" and role.setdefault(b, "right") == "right":
                chosen.append(pair)
        pairs = np.array(chosen, dtype=np.uint32)
        order = np.argsort(pairs)
        names = (first + len(left) + order).astype(np.uint16)
        pairs_sorted = pairs[order]
        is_left, is_right = np.zeros(65536, bool), np.zeros(65536, bool)
        is_left[pairs >> 16], is_right[pairs & 65535] = True, True
        maybe = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]] & inner)
        place = np.minimum(np.searchsorted(pairs_sorted, key[maybe]), len(pairs) - 1)
        hit = pairs_sorted[place] == key[maybe]
        maybe, place = maybe[hit], place[hit]
        double = (key[maybe] >> 16) == (key[maybe] & 65535)
        if double.any():  # in a run, every other pair from its left end
            at_run = maybe[double]
            new_run = np.concatenate(([True], np.diff(at_run) != 1))
            begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at_run)), 0))
            take = np.ones(len(maybe), bool)
            take[np.flatnonzero(double)[(np.arange(len(at_run)) - begin) % 2 == 1]] = False
            maybe, place = maybe[take], place[take]
        seq[maybe] = names[place]
        stay = np.ones(len(seq), bool)
        stay[maybe + 1] = False
        seq, starts = seq[stay], starts[stay]
        left, right = np.concatenate((left, (pairs >> 16).astype(np.uint16))), np.concatenate((right, (pairs & 65535).astype(np.uint16)))
    rules = np.stack([left, right], axis=1) if len(left) else np.zeros((0, 2), np.uint16)
    return {"packed": seq.astype("<u2").tobytes(), "places": np.flatnonzero(starts).astype("<u4").tobytes(), "rules": rules.astype("<u2").tobytes(), "sizes": rule_sizes(rules, first).astype("<u4").tobytes()}


def rule_sizes(rules: np.ndarray, first: int) -> np.ndarray:
    sizes: list[int] = []
    for a, b in rules.tolist():
        sizes.append((sizes[a - first] if a >= first else 1) + (sizes[b - first] if b >= first else 1))
    return np.array(sizes, dtype=np.int64)


def expanded(packed: bytes, rules: bytes, sizes: bytes, first: int) -> np.ndarray:
    """The ids that (a part of) a block's packed symbols stand for."""
    seq = np.frombuffer(packed, "<u2").astype(np.int64)
    rule = np.frombuffer(rules, "<u2").astype(np.int64)
    flat, parts = rule, np.concatenate((np.arange(first), rule))
    where = np.concatenate((np.arange(first), first + 2 * np.arange(len(rule) // 2)))
    while len(flat) and flat.max() >= first:  # all rules at once, a level of their parts a turn
        flat, _ = _gathered(parts, where, 1 + (np.arange(len(where)) >= first), flat)
    size = np.concatenate((np.ones(first, np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)))
    return _gathered(np.concatenate((np.arange(first), flat)).astype(np.uint32), np.cumsum(size) - size, size, seq)[0]


def document(block, k: int, first: int) -> np.ndarray:
    """The ids of the block's k-th document, decoded by itself."""
    places = np.frombuffer(block["places"], "<u4")
    end = places[k + 1] if k + 1 < len(places) else len(block["packed"]) // 2
    return expanded(block["packed"][2 * places[k] : 2 * end], block["rules"], block["sizes"], first)


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker, by file


def ranges_for(n_bytes: int, cores: int, task_bytes: int = TASK_BYTES) -> int:
    """How many ranges of ids: one for each ``task_bytes`` of text, and a task for each core as long as that leaves a block each."""
    return max(1, min(MOST_RANGES, max(ceil(n_bytes / task_bytes), min(cores, ceil(n_bytes / BLOCK_BYTES)))))


def write_tokens(docs: DataFrame, path: str, file: str, *, vocabulary: int, id_col: str = "doc_id", text: str = "text", block_tokens: int = 1 << 20, task_bytes: int = RANGE_BYTES) -> str:
    """Write the token file of ``docs`` to ``path``.  ``file`` is the tokenizer, on every machine; ids are below ``vocabulary``.

    Ranges of ids: see ``ranges_for``."""
    if vocabulary > 65535:
        raise ValueError("symbols are 16 bits: the vocabulary must leave room for nonterminals")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first_id", kind), T.StructField("tie", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "places", "rules", "sizes", "packed"))])

    def run(batches):
        encoder = _ENCODERS.get(file) or _ENCODERS.setdefault(file, Encoder(file))
        part, number, held, keys, ties = TaskContext.get().partitionId(), 0, [], [], []

        def block():
            nonlocal number
            ids = np.concatenate([x for x, _ in held])
            lengths = np.concatenate([np.diff(at) for _, at in held])
            packed = pack(ids, np.concatenate(([0], np.cumsum(lengths))), vocabulary)
            who = pa.chunked_array(keys).combine_chunks()
            n = pa.array([0, len(who)], pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), who[:1], pa.array([ties[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(n, who), pa.array([lengths.astype("<u4").tobytes()], pa.binary()), *(pa.array([packed[c]], pa.binary()) for c in ("places", "rules", "sizes", "packed"))], names=schema.names)
            number += 1
            held.clear(), keys.clear(), ties.clear()
            return out

        for batch in sub_batches(batches, "__text", ENCODED_BYTES):
            held.append(encoder.encode(batch.column(2)))
            keys.append(batch.column(0))
            ties.append(batch.column(1)[0].as_py())
            if sum(len(x) for x, _ in held) >= block_tokens:
                yield block()
        if held:
            yield block()

    own = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tie"), F.col(text).alias("__text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = ranges_for(n_bytes, docs.sparkSession.sparkContext.defaultParallelism, task_bytes)
    dealt = own.repartitionByRange(ranges, "__id", "__tie").sortWithinPartitions("__id", "__tie")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        dealt.mapInArrow(lean(run), schema).write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, *, vocabulary: int, id_col: str = "doc_id") -> DataFrame:
    """The documents of a token file: id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Their rows are staged, so that the blocks go to Python one by one: a file holds as many as its range has text for."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["first_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = expanded(b["packed"], b["rules"], b["sizes"], vocabulary).astype("<u4")
                at = np.concatenate(([0], np.cumsum(np.frombuffer(b["lengths"], "<u4").astype(np.int64))))
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b["part"], np.int32)), pa.array(np.full(n, b["block"], np.int32)), pa.array(b["ids"], batch.schema.field("ids").type.value_type), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["part", "block", "__id", "inner", "n_tokens", "ids_crc32"])

    one = blocks.select("part", "block", "ids", "lengths", "rules", "sizes", "packed")
    rows = one.mapInArrow(lean(run), f"part int, block int, `__id` {kind}, inner long, n_tokens long, ids_crc32 long")
    joined = staged(rows, "token-rows", BLOCK_ROWS).join(starts(blocks), ["part", "block"])
    return joined.select(F.col("__id").alias(id_col), (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def starts(blocks: DataFrame) -> DataFrame:
    """(part, block, start): ids before each block.  Parts are summed first, so no task sees all blocks."""
    slim = blocks.select("part", "block", "first_id", "tie", "n_tokens")
    parts = slim.groupBy("part").agg(F.min(F.struct("first_id", "tie")).alias("key"), F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy(F.col("key.first_id").asc_nulls_first(), "key.tie")) - F.col("n")).alias("base"))
    inside = slim.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("own"))
    return inside.join(before, "part").select("part", "block", (F.col("base") + F.col("own")).alias("start"))


def token_output(docs: DataFrame, file: str, *, vocabulary: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``write_tokens`` to the shared folder, then ``read_tokens`` from there."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, new_path(spark, "tokens"), file, vocabulary=vocabulary, id_col=id_col, text=text), vocabulary=vocabulary, id_col=id_col)
