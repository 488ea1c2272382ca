"""Removal of long word runs that occur twice or more, by a sparse de Bruijn graph of the corpus.

A window is ``window`` consecutive words of one text.  Windows are found by their anchors: of the k-mers of words in
each window the one with the least hash, so equal windows have equal anchors at equal places, and a text has about
2 / (window - k + 2) anchors a word.  Anchors are the nodes of the graph, the words from one anchor to the end of the
next its edges.

 1. Texts of equal word sequences are collapsed; a sequence that occurs twice goes whole, and one of it stays in the
    graph.
 2. Nodes are counted; only those that occur twice or more are followed, with their places in the texts.
 3. Edges between them are counted and joined with their nodes.  An edge that occurs as often as its node is the only
    way on from there: such edges in a row compact to one path, and a window that lies within a path occurs as often
    as the path's first node, so it is repeated without a look at it.
 4. All other windows whose anchor is repeated - across branchings and at the ends of paths - are verified at
    their source coordinates: repeated within their own text, or counted among the hashes of all candidate windows, of
    which a text sends each once.

Hashes of windows have 64 bits, keys of texts 128.  No step gathers the occurrences of a node, edge or window: counts
are partial sums over ``SPLIT`` parts of each key, and what a key's count says is joined back by key and part, so that
the occurrences of a frequent key lie in as many tasks.

Defined results: a null or empty text has no words and nothing is removed; texts shorter than the window stay whole;
of rows that repeat each loses the repeated words, none is left as the original; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, staged, sub_batches, window_hashes, word_hashes, words_of

K = 8
#: Parts of each key in joins of occurrences with their counts.
SPLIT = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """Of each window the place of its first least k-mer; h: hashes of one text's words."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    node = mixed(window_hashes(h, k) ^ _ODD)
    views = np.lib.stride_tricks.sliding_window_view(node, window - k + 1)
    return np.arange(len(views)) + views.argmin(1)


def prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers from which the hash of any run of words follows (a polynomial in the words' 64-bit hashes)."""
    power = np.full(len(h), _ODD, dtype=np.uint64)
    if len(h):
        power[0] = 1
    power = np.multiply.accumulate(power, dtype=np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h) * power, dtype=np.uint64))), power


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [start, end) of a text, and of their lengths."""
    if not len(start):
        return np.zeros(0, np.uint64)
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(start.max()), _INVERSE))), dtype=np.uint64)
    return mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _key(h: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(h.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def graph_of(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, their node hashes, and the hashes of the edges to the next (of the last: to the text's end)."""
    at = np.unique(anchors(h, window, k))
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums, _ = prefix_sums(h)
    edge_end = np.concatenate((at[1:] + k, [len(h)]))
    edge = run_hashes(sums, at, edge_end)
    edge[-1] ^= _ODD  # the text ends: not the same as going on
    return at, window_hashes(h, k)[at], edge


def candidates(h: np.ndarray, nodes: np.ndarray, solid: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have a repeated anchor, and which lie within a path.

    ``nodes``: places of the text's anchors that are repeated; ``solid``: whether the edge from each is the only way on."""
    n = len(h) - window + 1
    own = anchors(h, window, k)
    at = np.unique(own)
    repeated = np.zeros(len(h), dtype=bool)
    repeated[nodes] = True
    maybe = repeated[own]
    follows = np.zeros(len(at), dtype=bool)
    place = np.searchsorted(at, nodes)
    follows[place[solid]] = True
    follows[-1] = False
    inside = np.zeros(n, dtype=bool)
    turns = np.diff(np.concatenate(([0], follows.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True):  # edges a .. b - 1 are a path
        inside[at[a] : max(at[a], at[b] + k - window + 1)] = True
    return maybe, inside & maybe


def cover(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(words: list[bytes], drop: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(w for w, d in zip(words, drop.tolist(), strict=True) if not d)).hexdigest()


def _texts(batches, column: int):
    """Row, words and their hashes of each text of the batches."""
    for batch in sub_batches(batches, "__text", 1 << 20):
        words, starts = words_of(batch.column(column))
        h = word_hashes(words)
        distinct, index = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), np.asarray(words.indices).tolist()
        yield batch, [([distinct[i] for i in index[a:b]], h[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _part(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(SPLIT)).cast("int")


def with_totals(rows: DataFrame, key: str, what: dict, more: DataFrame | None = None) -> DataFrame:
    """(key, part, *what) of the parts of each key that occur in ``rows``: sums of counts and greatest values over all
    parts.  ``what`` maps names to "sum" or "max" of columns of ``rows``; ``more``: further counted rows of part -1."""
    by_part = rows.groupBy(key, "part").agg(*(getattr(F, how)(name).alias(name) for name, how in what.items()))
    if more is not None:
        by_part = by_part.unionByName(more)
    over = Window.partitionBy(key)
    return by_part.select(key, "part", *(getattr(F, how)(name).over(over).alias(name) for name, how in what.items())).where("part >= 0")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = 35, k: int = K) -> DataFrame:
    """(id, ``n_words``, ``n_removed``, ``kept_sha256``, ``removed``) of each row; ``removed``: spans of word places, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("__text"))  # id and tie tell texts apart

    def read(batches):
        for batch, rows in _texts(batches, 2):
            keys = [_key(h) for _, h in rows]
            graphs = [graph_of(h, window, k) for _, h in rows]
            blob = lambda j: pa.array([g[j].tobytes() for g in graphs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in keys]), pa.array([b for _, b in keys]), pa.array([len(h) for _, h in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w, _ in rows], pa.binary()), pa.ListArray.from_arrays(*_lists([g[0] for g in graphs], pa.int32())), pa.ListArray.from_arrays(*_lists([g[1].view(np.int64) for g in graphs], pa.int64())), pa.ListArray.from_arrays(*_lists([g[2].view(np.int64) for g in graphs], pa.int64()))], names=["id", "tie", "c1", "c2", "n_words", "sha", "at", "node", "edge"])

    read_all = staged(texts.mapInArrow(read, f"id {kind}, tie long, c1 long, c2 long, n_words long, sha binary, at array<int>, node array<long>, edge array<long>"), "repeat-graph")
    long = read_all.where(F.col("n_words") >= window)
    own = F.struct("id", "tie")
    contents = long.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.min(own).alias("own"))
    contents = staged(contents.select("c1", "c2", "copies", "own.id", "own.tie"), "repeat-contents")
    first = long.join(contents.select("c1", "c2", F.col("id").alias("own"), F.col("tie").alias("own_tie")), ["c1", "c2"]).where(F.col("id").eqNullSafe(F.col("own")) & (F.col("tie") == F.col("own_tie")))
    places = first.select("c1", "c2", F.explode(F.arrays_zip("at", "node", "edge")).alias("x")).select("c1", "c2", "x.at", "x.node", "x.edge").withColumn("part", _part("c1", "c2", "at"))
    nodes = with_totals(places.withColumn("n", F.lit(1)), "node", {"n": "sum"}).where("n > 1")
    followed = staged(places.join(nodes, ["node", "part"]), "repeat-nodes")  # every place of a repeated node
    edges = with_totals(followed.withColumn("m", F.lit(1)), "edge", {"m": "sum", "n": "max"}).where("m = n").select("edge", "part", F.lit(True).alias("only"))
    marked = followed.join(edges, ["edge", "part"], "left").select("c1", "c2", "at", F.coalesce("only", F.lit(False)).alias("solid"))
    of_text = staged(marked.groupBy("c1", "c2").agg(F.sort_array(F.collect_set(F.struct("at", "solid"))).alias("nodes")), "repeat-paths")  # at most a text's anchors
    wanted = of_text.join(contents, ["c1", "c2"]).select(F.col("id").alias("w"), F.col("tie").alias("w_tie"), "c1", "c2", "nodes")
    with_text = texts.join(wanted, F.col("id").eqNullSafe(F.col("w")) & (F.col("tie") == F.col("w_tie"))).select("c1", "c2", F.col("nodes.at").alias("at"), F.col("nodes.solid").alias("solid"), "__text")

    def judge(batches):
        for batch, rows in _texts(batches, 4):
            out: list[list] = [[] for _ in range(5)]
            ats, solids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for (c1, c2), (_, h), at, solid in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), rows, ats, solids, strict=True):
                if _key(h) != (c1, c2):  # another row of the same id
                    continue
                maybe, inside = candidates(h, np.array(at, np.int64), np.array(solid, bool), window, k)
                sums, _ = prefix_sums(h)
                every = np.flatnonzero(maybe)
                keys = run_hashes(sums, every, every + window)
                _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
                sure = inside[every] | (times[back] > 1)  # within a path, or twice in this very text
                for column, value in zip(out, (c1, c2, _spans(every[sure]), every[~sure], (keys[~sure].view(np.int64), np.unique(keys[sure]).view(np.int64))), strict=True):
                    column.append(value)
            hashes = [x for x, _ in out[4]], [y for _, y in out[4]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.ListArray.from_arrays(*_lists([s.ravel() for s in out[2]], pa.int32())), pa.ListArray.from_arrays(*_lists(out[3], pa.int32())), pa.ListArray.from_arrays(*_lists(hashes[0], pa.int64())), pa.ListArray.from_arrays(*_lists(hashes[1], pa.int64()))], names=["c1", "c2", "sure", "open", "open_hash", "sure_hash"])

    judged = staged(with_text.mapInArrow(judge, "c1 long, c2 long, sure array<int>, open array<int>, open_hash array<long>, sure_hash array<long>"), "repeat-candidates")
    open_at = judged.select("c1", "c2", F.explode(F.arrays_zip("open", "open_hash")).alias("x")).select("c1", "c2", F.col("x.open").alias("at"), F.col("x.open_hash").alias("hash"))
    open_at = open_at.withColumn("part", _part("c1", "c2", "at"))
    in_paths = judged.select(F.explode("sure_hash").alias("hash")).groupBy("hash").agg(F.sum(F.lit(1)).alias("n")).select("hash", F.lit(-1).alias("part"), "n")
    twice = with_totals(open_at.withColumn("n", F.lit(1)), "hash", {"n": "sum"}, in_paths).where("n > 1").select("hash", "part")
    found = open_at.join(twice, ["hash", "part"]).groupBy("c1", "c2").agg(F.collect_set("at").alias("found"))  # at most a text's windows
    result = judged.select("c1", "c2", "sure").join(found, ["c1", "c2"], "left").where("size(sure) > 0 or found is not null")
    ends = result.join(contents, ["c1", "c2"]).where("copies = 1").select(F.col("id").alias("w"), F.col("tie").alias("w_tie"), "c1", "c2", "sure", "found")
    again = texts.join(ends, F.col("id").eqNullSafe(F.col("w")) & (F.col("tie") == F.col("w_tie"))).select("c1", "c2", "sure", "found", "__text")

    def cut(batches):
        for batch, rows in _texts(batches, 4):
            out: list[list] = [[] for _ in range(5)]
            for c1, c2, sure, found_at, (words, h) in zip(*(batch.column(i).to_pylist() for i in range(4)), rows, strict=True):
                if _key(h) != (c1, c2):
                    continue
                starts = [np.array(found_at or [], np.int64)] + [np.arange(a, b) for a, b in np.array(sure, np.int64).reshape(-1, 2).tolist()]
                drop = cover(len(h), np.concatenate(starts), window)
                for column, value in zip(out, (c1, c2, int(drop.sum()), _kept(words, drop), _spans(np.flatnonzero(drop)).ravel()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.ListArray.from_arrays(*_lists(out[4], pa.int32()))], names=["c1", "c2", "n_cut", "cut_sha", "cut"])

    done = staged(again.mapInArrow(cut, "c1 long, c2 long, n_cut long, cut_sha string, cut array<int>"), "repeat-cuts").dropDuplicates(["c1", "c2"])
    copied = contents.where("copies > 1").select("c1", "c2", "copies")
    rows = read_all.select("id", "c1", "c2", "n_words", F.lower(F.hex("sha")).alias("sha")).join(copied, ["c1", "c2"], "left").join(done, ["c1", "c2"], "left")
    whole = F.col("copies").isNotNull()
    spans = F.transform(F.sequence(F.lit(0), (F.size("cut") / 2 - 1).cast("int")), lambda i: F.struct(F.get("cut", (2 * i).cast("int")).alias("start"), F.get("cut", (2 * i + 1).cast("int")).alias("end")))
    none = F.array().cast("array<struct<start: int, `end`: int>>")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).when(F.size("cut") > 0, spans).otherwise(none).alias("removed"),
    )


def _spans(at: np.ndarray) -> np.ndarray:
    """Sorted places as runs [first, one past the last]."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))] + 1], axis=1)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.array(ends, pa.int32()), pc.cast(pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)), kind)
