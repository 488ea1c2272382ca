"""Phrase collocations from position bitmaps, in the manner of SPAM's sequence extension.

Pieces.  Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words.

Shards.  The texts of a language that a task reads make shards of about ``shard_bytes``.  Each word of a shard has a
bitmap of its positions: packed bits where it holds a position in 32 or more, sorted positions otherwise (as differences);
both are compressed.  A position between two pieces belongs to no word, so nothing that is shifted reaches over it.  Shards
are written once and hold all that later steps need.

Counts, in two walks over the bitmaps, whose popcounts are summed over all shards:

 * words: the popcounts of the bitmaps; words of fewer than ``least`` occurrences can't be part of a candidate;
 * pairs: a bitmap shifted by one AND the bitmaps of all frequent words.  Where both are packed this is an AND and a
   popcount of machine words; elsewhere each shifted bit is looked up in the table of which bitmap holds a position,
   which is the AND with all sorted bitmaps at once;
 * longer phrases, depth first: phrases are taken in blocks by their first word, and a block is extended by shift and AND
   to ``longest`` words before the next begins; only along frequent pairs, since a phrase is no more frequent than its
   parts.

Every count is exact: nothing is sampled, and a phrase is left out only when a part of it is below ``least`` over all
shards.  A word, a pair or a phrase is one row a shard before it is shuffled.  The dictionary of a shard and what is kept
of it travel to the shard by its number (a cogroup); no vocabulary is broadcast.

Scores are decimals of 38 digits, exact up to counts of 10^16.

Defined results: a null language is ``und``, a null or empty text has no words; equal rows count each; a text longer than
``shard_bytes`` is a shard of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, words_of

BREAK = r"[.,;:!?\x0A-\x0D]"
#: A bitmap is packed if its word holds a position in this many or more.
DENSE = 32
#: Bits of a word id: partition, shard of the partition, word of the shard.
PARTITION_BITS, SHARD_BITS, CODE_BITS = 22, 15, 26

SHARD = "lang string, shard long, n_positions long, words array<string>, counts array<int>, places binary, bits binary"


def squeezed(x: np.ndarray) -> bytes:
    """32-bit numbers as compressed differences, like bytes of each beside each other."""
    planes = np.diff(x.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32).view(np.int32)


def positions(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of the texts one after the other, dictionary-encoded, ``.`` for the end of a piece; which code is ``.``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), BREAK, " . ")
    words, _ = words_of(pc.binary_join_element_wise(cut, pa.scalar(" .", pa.large_string()), pa.scalar("", pa.large_string())))
    return words, np.asarray(pc.equal(words.dictionary, ".").to_numpy(zero_copy_only=False), dtype=bool)


def bitmaps(texts: pa.Array) -> tuple[int, pa.Array, np.ndarray, bytes, bytes] | None:
    """Number of positions, words, their counts, the sorted positions of sparse words and the packed bits of dense ones."""
    words, ends = positions(texts)
    code = np.asarray(words.indices)
    size = np.bincount(code, minlength=len(ends))
    order = np.argsort(code, kind="stable").astype(np.int32)
    keep = np.flatnonzero(~ends)
    if not len(keep):
        return None
    first = np.cumsum(size) - size
    dense = (size * DENSE >= len(code)) & ~ends
    sparse = ~dense & ~ends
    places = order[np.repeat(sparse, size)]
    packed = []
    for w in np.flatnonzero(dense):
        bit = np.zeros(len(code), dtype=np.uint8)
        bit[order[first[w] : first[w] + size[w]]] = 1
        packed.append(np.packbits(bit).tobytes())
    return len(code), words.dictionary.take(pa.array(keep)), size[keep].astype(np.int32), squeezed(places), zstandard.ZstdCompressor(level=1).compress(b"".join(packed))


def to_shards(batches, shard_bytes: int):
    """Rows SHARD of a task's texts (lang, text); what is held back is at most a shard for a language and eight in all."""
    part, held, size, made = TaskContext.get().partitionId(), {}, {}, 0

    def row(lang: str):
        nonlocal made
        got = bitmaps(pa.concat_arrays(held.pop(lang)))
        size.pop(lang)
        if got is None:
            return
        n, words, counts, places, bits = got
        if part >= 1 << PARTITION_BITS or made >= 1 << SHARD_BITS or len(words) >= 1 << CODE_BITS:
            raise ValueError("more partitions, shards or words than word ids have room for")
        shard = part << SHARD_BITS | made
        made += 1
        arrays = [pa.array([lang]), pa.array([shard]), pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts)), pa.array([places]), pa.array([bits])]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "shard", "n_positions", "words", "counts", "places", "bits"])

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.column(1).filter(pc.equal(langs.indices, i))
            sizes = np.asarray(pc.fill_null(pc.binary_length(own), 0), dtype=np.int64)
            lo = 0
            while lo < len(own):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), shard_bytes - size.get(lang, 0), side="right")) + lo)
                held.setdefault(lang, []).append(own[lo:hi].cast(pa.large_string()))
                size[lang] = size.get(lang, 0) + int(sizes[lo:hi].sum())
                lo = hi
                if size[lang] >= shard_bytes or lo < len(own):
                    yield from row(lang)
        while sum(size.values()) > 8 * shard_bytes or len(size) > 1000:
            yield from row(max(size, key=size.get))
    for lang in list(held):
        yield from row(lang)


class Bitmaps:
    """The bitmaps of a shard's frequent words, numbered from 1 in the order of ``codes``."""

    def __init__(self, n: int, counts: np.ndarray, places: bytes, bits: bytes, codes: np.ndarray, longest: int):
        number = np.zeros(len(counts), dtype=np.int32)
        number[codes] = np.arange(1, len(codes) + 1, dtype=np.int32)
        dense = counts.astype(np.int64) * DENSE >= n
        self.size = len(codes) + 1
        self.owner = np.zeros(n + longest, dtype=np.int32)  # which bitmap holds a position
        self.owner[unsqueezed(places)] = np.repeat(number[~dense], counts[~dense])
        rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8).reshape(int(dense.sum()), -1) if dense.any() else np.zeros((0, 0), np.uint8)
        live = number[dense] > 0
        self.packed, self.packed_number = rows[live], number[dense][live]
        for row, w in zip(self.packed, self.packed_number, strict=True):
            self.owner[np.flatnonzero(np.unpackbits(row))] = w
        self.is_packed = np.zeros(self.size, dtype=bool)
        self.is_packed[self.packed_number] = True

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, popcount) of each pair of words that occurs."""
        left, right = self.owner[:-1], self.owner[1:]
        sparse = (left > 0) & (right > 0) & ~(self.is_packed[left] & self.is_packed[right])
        key, n = np.unique(left[sparse].astype(np.int64) * self.size + right[sparse], return_counts=True)
        found = [(key // self.size, key % self.size, n)]
        for i, row in zip(self.packed_number, self.packed, strict=True):
            shifted = np.packbits(np.concatenate((np.zeros(1, np.uint8), np.unpackbits(row)[:-1])))
            n = np.bitwise_count(self.packed & shifted).sum(1, dtype=np.int64)
            on = n > 0
            found.append((np.full(on.sum(), i), self.packed_number[on], n[on]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def longer(self, first: np.ndarray, second: np.ndarray, longest: int, block: int = 1 << 20):
        """(words of a phrase, one column each; popcounts) of phrases of three words to ``longest`` along the given pairs."""
        allowed = np.sort(first * self.size + second)
        at = np.flatnonzero((self.owner[:-1] > 0) & (self.owner[1:] > 0))
        key = self.owner[at].astype(np.int64) * self.size + self.owner[at + 1]
        slot = np.minimum(np.searchsorted(allowed, key), max(len(allowed) - 1, 0))
        at = at[allowed[slot] == key] if len(allowed) else at[:0]
        follows = np.zeros(len(self.owner), dtype=bool)
        follows[at] = True
        at = at[np.argsort(self.owner[at], kind="stable")]
        head = np.flatnonzero(np.diff(self.owner[at], prepend=-1))  # where a first word begins
        cuts = [0]
        for end in [*head[1:].tolist(), len(at)]:
            if end - cuts[-1] >= block:
                cuts.append(end)
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            now = at[lo:hi]
            group = self.owner[now].astype(np.int64) * self.size + self.owner[now + 1]
            for m in range(3, longest + 1):
                on = follows[now + m - 2]
                now, group = now[on], group[on]
                if not len(now):
                    break
                _, group = np.unique(group, return_inverse=True)
                _, one, group, n = np.unique(group * self.size + self.owner[now + m - 1], return_index=True, return_inverse=True, return_counts=True)
                yield np.stack([self.owner[now[one] + i] for i in range(m)]), n


def counted_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, shard_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of every phrase of one to ``longest`` words with ``least`` occurrences or more, m its words;
    and (lang, n), the number of all words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    shards = staged(texts.mapInArrow(lambda b: to_shards(b, shard_bytes), SHARD), "phrase-shards")
    total = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))

    listed = shards.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("lang", "shard", "code", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    same = Window.partitionBy("lang", "word")  # a row for each shard at most
    place = F.shiftleft(F.col("shard"), CODE_BITS).bitwiseOR(F.col("code").cast("long"))
    known = listed.select("*", F.sum("c").over(same).alias("f"), F.min(place).over(same).alias("id")).where(F.col("f") >= least)
    known = staged(known.select("lang", "shard", "code", "word", "f", "id"), "phrase-words")
    words = known.where(F.col("id") == place).select("lang", "id", F.col("word").alias("phrase"), "f")
    body = shards.select("shard", "n_positions", "counts", "places", "bits").groupBy("shard")
    codes = known.select("shard", F.lit(0).alias("kind"), F.col("code").cast("long").alias("a"), F.col("id").alias("b"))

    def opened(shard: pa.Table, listed: pa.Table) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """Ids of the shard's frequent words, its listed pairs of ids, and its bitmaps."""
        kind, a, b = (listed.column(k).to_numpy() for k in ("kind", "a", "b"))
        cell = {k: shard.column(k)[0] for k in shard.column_names}
        maps = Bitmaps(cell["n_positions"].as_py(), np.asarray(cell["counts"].values), cell["places"].as_py(), cell["bits"].as_py(), a[kind == 0], longest)
        return b[kind == 0], np.stack((a[kind == 1], b[kind == 1])), maps

    def pairs(shard: pa.Table, listed: pa.Table) -> pa.Table:
        names, kinds = ["shard", "w1", "w2", "c"], [pa.int64()] * 4
        if not shard.num_rows or not listed.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        word, _, maps = opened(shard, listed)
        a, b, n = maps.pairs()
        return pa.table([pa.array(np.full(len(n), shard.column("shard")[0].as_py(), dtype=np.int64)), pa.array(word[a - 1]), pa.array(word[b - 1]), pa.array(n)], names=names)

    ids = [f"w{i}" for i in range(1, longest + 1)]

    def phrases(shard: pa.Table, listed: pa.Table) -> pa.Table:
        schema = pa.schema([(x, pa.int64()) for x in [*ids, "c"]])
        if not shard.num_rows or not listed.num_rows:
            return schema.empty_table()
        word, pair, maps = opened(shard, listed)
        by_id = np.argsort(word)
        first, second = (by_id[np.searchsorted(word, x, sorter=by_id)] + 1 for x in pair)
        found = []
        for code, n in maps.longer(first, second, longest):
            out = np.full((longest, len(n)), -1, dtype=np.int64)
            out[: len(code)] = word[code - 1]
            found.append(pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(n)], schema=schema))
        return pa.Table.from_batches(found, schema)

    pair = Window.partitionBy("w1", "w2")  # a row for each shard at most
    counted = body.cogroup(codes.groupBy("shard")).applyInArrow(pairs, "shard long, w1 long, w2 long, c long")
    counted = counted.withColumn("f", F.sum("c").over(pair)).where(F.col("f") >= least)
    counted = staged(counted.select("shard", "w1", "w2", "f"), "phrase-pairs")
    found = [(2, counted.groupBy("w1", "w2").agg(F.max("f").alias("f")))]
    if longest > 2:
        allowed = codes.unionByName(counted.select("shard", F.lit(1).alias("kind"), F.col("w1").alias("a"), F.col("w2").alias("b")))
        longer = body.cogroup(allowed.groupBy("shard")).applyInArrow(phrases, ", ".join(f"{x} long" for x in [*ids, "c"]))
        longer = staged(longer.groupBy(*ids).agg(F.sum("c").alias("f")).where(F.col("f") >= least), "phrase-longer")
        found += [(m, longer.where(" and ".join(f"{x} {'>=' if i < m else '<'} 0" for i, x in enumerate(ids)))) for m in range(3, longest + 1)]
    out = words.select("lang", "phrase", F.lit(1).alias("m"), "f")
    for m, level in found:
        named = level
        for i in range(1, m + 1):
            word = words.select(F.col("id").alias(f"w{i}"), F.col("phrase").alias(f"p{i}"), *(["lang"] if i == 1 else []))
            named = named.join(word, f"w{i}")
        out = out.unionByName(named.select("lang", F.concat_ws(" ", *(f"p{i}" for i in range(1, m + 1))).alias("phrase"), F.lit(m).alias("m"), "f"))
    return staged(out, "phrase-counts"), total


def first_rows(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """``df`` with ``rank``: the first ``most`` rows of each group.  Tasks see a part of a group each, in three turns."""
    spread = F.pmod(F.xxhash64("phrase"), F.lit(1024))
    df = df.withColumn("__part", spread)
    for parts in (1024, 32):
        w = Window.partitionBy(group, F.pmod(F.col("__part"), F.lit(parts))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return df.drop("__part").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, within_percent: int = 50, most: int = 2000, scale: int = 1_000_000, shard_bytes: int = 16 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words; the score is
    floor(``scale`` a² / (l r)).  A phrase goes that lies in a longer candidate of ``within_percent`` of its count or more."""
    counts, total = counted_phrases(docs, text=text, lang=lang, least=least, longest=longest, shard_bytes=shard_bytes)
    several = counts.where("m > 1").withColumn("words", F.split("phrase", " ", -1)).withColumnRenamed("f", "a")
    cut = several.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"), "words")
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", joined(1, F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    big = lambda x: F.col(x).cast("decimal(16,0)")
    cut = cut.withColumn("x", big("a") * big("a") * F.lit(scale).cast("decimal(7,0)")).withColumn("y", big("l") * big("r")).withColumn("score", F.expr("x div y"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = several.select("lang", F.col("a").alias("f"), F.size("words").alias("m"), "words").where("m > 2")
    part = inner.select("lang", "f", "words", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("m"), F.col("m").alias("whole"))
    part = part.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("whole") - F.col("m") + 1), lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))).alias("phrase"))
    longest_of = part.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    left = scored.join(longest_of, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < within_percent * F.col("a")))
    out = first_rows(left.select("lang", "phrase", "a", "x.l", "x.r", "x.score"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return out.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
