"""Near-duplicate documents by BagMinHash over five-word shingles, counted as often as they occur.

Signature.  Of each shingle the weights (0, 1], (1, 2], (2, 4], (4, 8], ... are intervals with a Poisson process of
their own, seeded by shingle and interval, at the interval's length as rate; a point bears a uniform slot and a uniform
level in its interval.  A document takes the points of its shingles whose level is within the
shingle's count there; the least point of each slot is its signature.  Two documents agree in a slot with the
probability of their weighted Jaccard similarity.  Points are made in ascending order up to the height at which all
slots are expected to be filled, so their number depends on the slots and not on the length of the text.

Candidates.  The signature is cut in bands.  Equal word sequences are collapsed first.  In each bucket of a band one
leader is paired with the members of other classes, in ``rounds`` rounds; the leaders differ from band to band at first.
A pair is verified by the overlap of the two whole multisets of shingles, and links are joined to classes.  Leaders only
come first, to join most documents with few pairs.  What they leave open is settled for every pair that shares a bucket:

 * in a bucket of at most ``block`` members all pairs of different classes are verified, at most block - 1 a member;
 * in larger ones (copies too far from their origin, documents that share a passage) shingles tell which pairs can
   still reach ``least``.  Shingles are counted over all members of large buckets, in parts of about ``part_tokens`` that
   are dealt by the shingle and counted in arrays.  Pairs that share a rare shingle (of
   three members at most) are found by it.  A pair that shares none overlaps in common shingles only, so both
   members' common shingles bound the size of the other: a document with a ninth of shingles of its own has no partner
   of its size.  Members are met within bucket and size class, and only where the bound allows the pair.

Both look at a pair's odd sketches first (parities of hashed shingles), which bound from below in how many shingles the
two differ.  All bounds are exact, so every two documents that share a bucket are verified, ruled out, or in one class already.  With
the default 40 bands of 6 slots, two documents of similarity 0.8 share no bucket with probability 5e-6.

Defined results: a text of one to four words has one shingle, all its words; a document without words (or null, or
with a null id) is in a class of its own; rows of one id are one document; the class id is its least document id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mixed, staged, sub_batches, window_hashes, word_hashes, words_of

SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of every shingle of a batch, in order; hashes of all words; where each document's words begin."""
    words, starts = words_of(texts)
    h = word_hashes(words)
    size = np.diff(starts)
    own = np.repeat(np.arange(len(size)), size)
    whole = window_hashes(h, SHINGLE)
    inside = np.flatnonzero(own[: len(whole)] == own[SHINGLE - 1 :]) if len(whole) else np.zeros(0, np.int64)
    hashes, of = whole[inside], own[inside]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        one = np.array([window_hashes(h[starts[i] : starts[i + 1]], int(size[i]))[0] for i in short], dtype=np.uint64)
        hashes, of = np.concatenate([hashes, mixed(one ^ _ODD)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of, h, starts


def counted(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: hash, document, count; in order of document."""
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    head = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])))) if len(of) else np.zeros(0, np.int64)
    return hashes[head], of[head], np.diff(np.concatenate((head, [len(of)])))


def _units(seed: np.ndarray) -> np.ndarray:
    return ((mixed(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(hashes: np.ndarray, of: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures [document, slot] (0 for a document without shingles): the height of the least point, as 40 bits."""
    total = np.bincount(of, weights=count, minlength=n_docs)
    out = np.zeros((n_docs, slots), dtype=np.uint64)
    todo, height = total > 0, (np.log(slots) + 6) * slots / np.maximum(total, 1)
    while todo.any():
        pick = todo[of]
        seeds, docs, weights, levels, rates = [], [], [], [], []
        h, d, w = hashes[pick], of[pick], count[pick]
        k = 0
        while len(h):  # interval k: (0, 1], (1, 2], (2, 4], ...
            seeds.append(mixed(h + np.uint64(k * int(_ODD) & (2**64 - 1)))), docs.append(d), weights.append(w)
            low = 0 if k == 0 else 1 << (k - 1)
            levels.append(np.full(len(h), low)), rates.append(np.full(len(h), max(low, 1)))
            more = w > max(low, 1 if k == 0 else 2 * low) if k else w > 1
            h, d, w, k = h[more], d[more], w[more], k + 1
        seed, doc, weight, low, rate = (np.concatenate(x) for x in (seeds, docs, weights, levels, rates))
        at, top = np.zeros(len(seed)), height[doc]
        packed = []
        while len(seed):
            seed = seed + _ODD
            at = at - np.log(_units(seed)) / rate
            live = at < top
            seed, doc, weight, low, rate, at, top = (x[live] for x in (seed, doc, weight, low, rate, at, top))
            mark = mixed(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            slot = ((mark >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
            level = low + ((mark & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64) + 1
            own = level <= weight
            packed.append(((doc[own].astype(np.uint64) * np.uint64(slots) + slot[own]) << np.uint64(40)) | (at[own].view(np.uint64) >> np.uint64(24)))
        points = np.sort(np.concatenate(packed)) if packed else np.zeros(0, np.uint64)
        cell = points >> np.uint64(40)
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        flat = np.zeros(n_docs * slots, dtype=np.uint64)
        flat[cell[first]] = points[first] & np.uint64((1 << 40) - 1)
        got = flat.reshape(n_docs, slots)
        done = todo & (got > 0).all(1)
        out[done] = got[done]
        todo &= ~done
        height = height * 3
    return out


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each document, [document, band]."""
    rows = signature.shape[1] // bands
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _ODD, (len(signature), bands))
    for r in range(rows):
        key = mixed(key * _ODD + signature[:, r::rows][:, :bands])
    return key


def expanded(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Multisets as sets: a value for each occurrence of a shingle, equal over documents."""
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mixed(np.repeat(hashes, count) + which.astype(np.uint64) * _ODD)


ODD_LONGS = 16


def odd_sketch(values: np.ndarray, of: np.ndarray, n_docs: int) -> np.ndarray:
    """Bits [document, long] that tell whether the values that hash to a bit are odd in number.  Two sets that differ in
    d values differ in d bits at most, as common values cancel out."""
    bits = ODD_LONGS * 64
    at = of.astype(np.int64) * bits + (mixed(values ^ _ODD) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n_docs * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(n_docs, ODD_LONGS)


def bits_apart(x: str, y: str):
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, ODD_LONGS)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))


def _node(df: DataFrame, id_col: str):
    kind = df.schema[id_col].dataType
    return F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(id_col)


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, comp) of all nodes of links (a, b): the least node that can be reached.

    Each node takes the least label of itself and its neighbours; from the third turn on also its label's label."""
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    for turn in range(most):
        sent = both.join(label, both["a"] == label["node"]).select(F.col("b").alias("node"), "comp", F.lit(None).cast("long").alias("old"))
        new = label.select("node", "comp", F.col("comp").alias("old")).union(sent).groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        if turn > 1:
            up = label.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
            new = new.join(up, new["comp"] == up["n2"]).select("node", F.least("comp", "c2").alias("comp"), "old")
        new = staged(new, "labels")
        label = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {most} turns")


def absorbed(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links so far (comp; None for none yet) and further ones, which are looked at between components only."""
    if comp is None:
        return components(links)
    x, y = (comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")) for side in ("a", "b"))
    between = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    between = staged(between.distinct(), "links")
    if between.isEmpty():
        return comp
    top = components(between).select(F.col("node").alias("t"), F.col("comp").alias("ct"))
    fresh = top.join(comp, top["t"] == comp["node"], "left_anti").select(F.col("t").alias("node"), F.col("t").alias("comp"))
    every = comp.union(fresh)
    return staged(every.join(top, every["comp"] == top["t"], "left").select("node", F.coalesce("ct", "comp").alias("comp")), "labels")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = 40, rows: int = 6, rounds: int = 2, block: int = 64, part_tokens: int = 1 << 17) -> DataFrame:
    """(id, ``class_id``, ``kept``) of each distinct document id; one document of each class is kept."""
    slots = bands * rows

    def sign(batches):
        for batch in sub_batches(batches, "__text", 1 << 20):
            hashes, of, words, starts = shingles(batch.column(1))
            h, d, w = counted(hashes, of)
            keys = bands_of(bag_min_hash(h, d, w, batch.num_rows, slots), bands)
            content = [xxhash.xxh3_128_digest(words[i:j].tobytes()) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(np.bincount(of, minlength=batch.num_rows)), lists], names=["node", "content", "n", "bands"])

    def sets(batches):
        for batch in sub_batches(batches, "__text", 1 << 20):
            hashes, of, _, _ = shingles(batch.column(1))
            h, d, w = counted(hashes, of)
            token = expanded(h, w)
            cut = np.concatenate(([0], np.cumsum(np.bincount(d, weights=w, minlength=batch.num_rows)))).astype(np.int64)
            odd = odd_sketch(token, np.repeat(d, w), batch.num_rows)
            bag = [np.unique((token[i:j] >> np.uint64(32)).astype(np.uint32)).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(token.view(np.int64)))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * ODD_LONGS, pa.int32()), pa.array(odd.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bag, pa.binary()), lists, sketch], names=["node", "bag", "tokens", "odd"])

    def holders(parts: int):
        def run(batches):
            """Of each token of a batch: how many rows hold it, the least and the greatest node, and the xor of all; a row for
            each part of the tokens, which are dealt by their value."""
            for batch in batches:
                lists = batch.column(1)
                token = lists.flatten().to_numpy(zero_copy_only=False)
                node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets)))
                part = (mixed(token.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((token, part))
                token, node, part = token[order], node[order], part[order]
                if len(token):
                    head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                    found = np.stack([token[head], np.diff(np.concatenate((head, [len(token)]))), *(how.reduceat(node, head) for how in (np.minimum, np.maximum, np.bitwise_xor))])
                    own = part[head]
                    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                    yield pa.RecordBatch.from_arrays([pa.array(own[cut[:-1]]), pa.array([found[:, i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["part", "held"])

        return run

    def rare(table: pa.Table) -> pa.Table:
        """Of a part's tokens that three rows hold at most: (a, null, k), how many a node holds, and (a, b, k), how many two
        nodes have in common."""
        found = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(5, -1) for x in table.column("held")], axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
        head = np.flatnonzero(np.concatenate(([True], found[0][1:] != found[0][:-1])))
        f, p, q, x = (how.reduceat(v, head) for how, v in zip((np.add, np.minimum, np.maximum, np.bitwise_xor), found[1:], strict=True))
        f, p, q, x = (v[f <= 3] for v in (f, p, q, x))
        third = np.where(f == 3, x ^ p ^ q, p)
        second, last = q != p, (third != p) & (third != q)
        who, n = np.unique(np.concatenate((p, q[second], third[last])), return_counts=True)
        pairs = np.concatenate([np.stack([u[on], v[on]]) for u, v, on in ((p, q, second), (p, third, last), (q, third, last & second))], axis=1)
        pairs, k = np.unique(np.sort(pairs, axis=0), axis=1, return_counts=True)
        b = pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(pairs[1])])
        return pa.table([pa.array(np.concatenate((who, pairs[0]))), b, pa.array(np.concatenate((n, k)))], names=["a", "b", "k"])

    def overlap(batches):
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            same = np.zeros(batch.num_rows, dtype=bool)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                both = np.concatenate((np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                same[i] = common >= least * (len(both) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in batch.columns[:2]], names=["a", "b"])

    texts = docs.where(F.col(id_col).isNotNull()).select(_node(docs, id_col).alias("node"), F.col(text).alias("__text"))
    signed = staged(texts.mapInArrow(lean(sign), "node long, content binary, n long, bands array<long>"), "near-signatures")
    filled = signed.where("n > 0")
    content = staged(filled.groupBy("content").agg(F.min("node").alias("rep")), "near-contents")
    placed = staged(filled.select("node", "content").join(content, "content").select("node", "rep").distinct(), "near-copies")
    keyed = filled.join(content.select("rep"), filled["node"] == content["rep"], "left_semi").select("node", "n", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    keyed = staged(keyed.join(shared, "band"), "near-buckets")  # buckets of two and more only
    wanted = keyed.select("node").distinct()
    bags = staged(texts.join(wanted, "node", "left_semi").mapInArrow(lean(sets), "node long, bag binary, tokens array<long>, odd array<long>"), "near-bags")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one_side = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
        both = one_side.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a")
        fits = both.where(F.least(F.length("x"), F.length("y")) >= (least - 1e-9) * F.greatest(F.length("x"), F.length("y")))
        return staged(fits.select("a", "b", "x", "y").mapInArrow(lean(overlap), "a long, b long"), name)

    def led(now: DataFrame, k: int) -> DataFrame:
        """(a, b, votes): each open bucket's leader with its members of other classes; a hashed one in the first round, then
        the member that meets the most documents in its buckets, which finds what many copies were made from."""
        rank = F.col("node").bitwiseXOR(F.xxhash64("band", F.lit(k)))
        if k:
            met = now.groupBy("node").agg(F.sum("c").alias("met"))
            now = now.join(met, "node")
        order = F.struct(F.col("met") if k else F.lit(0), rank, "node", "comp", "n")
        heads = now.groupBy("band").agg(F.max(order).alias("x")).select("band", F.col("x.node").alias("a"), F.col("x.comp").alias("ca"), F.col("x.n").alias("na"))
        pairs = now.select("band", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb")).join(heads, "band")
        return voted(pairs.where("ca <> cb"))

    def crossed(now: DataFrame) -> DataFrame:
        """(a, b, votes): the pairs of an open bucket whose classes differ, in large buckets those that the bound allows.

        Of either, only pairs whose sketches leave room: sets with at least ``least`` in common differ in few values."""
        now = now.join(bags.select("node", "odd"), "node")
        room = (bits_apart("oa", "ob") * (1 + least) <= (F.col("na") + F.col("nb")) * (1 - least) + 1e-6) & (F.least("na", "nb") >= (least - 1e-6) * F.greatest("na", "nb"))
        names = {"node": "", "comp": "c", "n": "n", "odd": "o"}
        x, y = (now.where(F.col("c") <= block).select("band", *(F.col(c).alias(short + side) for c, short in names.items())) for side in "ab")
        near = voted(x.join(y, "band").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & room))
        large = now.where(F.col("c") > block)
        if large.isEmpty():
            return near
        both = (1 + least) / least - 1e-6  # an overlap of o allows sizes of o * both in sum
        hot = large.groupBy("node").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.sort_array(F.collect_set("band")).alias("bands"))  # at most ``bands`` a text
        hot = staged(hot, "near-hot")
        of_hot = bags.join(hot.select("node"), "node", "left_semi")
        total = staged(of_hot.groupBy("node").agg(F.sum(F.size("tokens")).alias("all")), "near-sizes")
        parts = max(1, -(-(total.agg(F.sum("all")).first()[0] or 0) // part_tokens))
        token = of_hot.select("node", "tokens").mapInArrow(lean(holders(parts)), "part long, held binary")
        held = staged(token.groupBy("part").applyInArrow(rare, "a long, b long, k long"), "near-rare")
        own = total.join(held.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("own")), "node", "left")
        known = staged(hot.join(own.select("node", (F.col("all") - F.coalesce("own", F.lit(0))).alias("common")), "node"), "near-common")

        met = held.where("b is not null").groupBy("a", "b").agg(F.sum("k").alias("k"))
        for side in "ab":
            met = met.join(known.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("comp").alias(f"c{side}"), F.col("common").alias(f"s{side}")), side)
        met = met.where((F.col("ca") != F.col("cb")) & ((F.col("k") + F.least("sa", "sb")) * both >= F.col("na") + F.col("nb"))).select("a", "b", F.lit(1).cast("long").alias("votes"))

        def size_class(n):
            return F.floor(F.log(n) / np.log(1.05)).cast("int")

        member = large.select("band", "node", "comp", "n", "odd").join(known.select("node", "common", "bands"), "node").withColumn("reach", F.col("common") * both - F.col("n"))
        member = staged(member.where(F.col("reach") >= (least - 1e-6) * F.col("n")).withColumn("class", size_class("n")).drop("common"), "near-members")
        first = member.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
        member = member.join(first, "band").withColumn("probe", F.col("comp") != F.col("main")).drop("main")
        cells = member.groupBy("band", "class").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("parts"))
        y = member.join(cells, ["band", "class"]).select("band", "class", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("reach").alias("rb"), F.col("probe").alias("pb"), F.col("bands").alias("bb"), F.col("odd").alias("ob"))
        fits = F.sequence(size_class(F.col("n") * least), F.greatest(size_class(F.col("n") * least), size_class(F.least(F.col("n") / least, "reach"))))
        x = member.where("probe").withColumn("class", F.explode(fits)).join(cells, ["band", "class"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x = x.select("band", "class", "part", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("reach").alias("ra"), F.col("bands").alias("ba"), F.col("odd").alias("oa"))
        allowed = x.join(y, ["band", "class", "part"]).where("ca <> cb and nb <= ra and na <= rb and (a < b or not pb)").where(room).where(F.array_min(F.array_intersect("ba", "bb")) == F.col("band"))
        return near.union(met).union(voted(allowed)).groupBy("a", "b").agg(F.sum("votes").alias("votes"))

    def voted(pairs: DataFrame) -> DataFrame:
        near = pairs.where(F.least("na", "nb") >= (least - 1e-6) * F.greatest("na", "nb"))  # else the sizes alone rule it out
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))

    many = placed.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("node", "a")
    comp = absorbed(None, placed.join(many, "node").select("a", F.col("rep").alias("b")).where("a <> b"))  # texts of one id
    tested = None
    for k in range(rounds + 1):
        now = keyed.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = now.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("band", "c")
        now = staged(now.join(open_, "band"), "near-open")  # buckets of several classes only
        if now.isEmpty():
            break
        pairs = led(now, k) if k < rounds else crossed(now)
        if tested is not None:
            pairs = pairs.join(tested, (pairs["a"] == tested["p"]) & (pairs["b"] == tested["q"]), "left_anti")
        pairs = staged(pairs, "near-pairs")
        if pairs.isEmpty():
            continue
        best = pairs.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
        first = verified(best, "near-links")  # each document with its likeliest partner; most other pairs then lie within a class
        comp = absorbed(comp, first)
        rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            rest = rest.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")), side, "left")
        rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        comp = absorbed(comp, verified(rest, "near-links"))
        new = pairs.select(F.col("a").alias("p"), F.col("b").alias("q"))
        tested = new if tested is None else tested.union(new)
    comp = placed.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("node", F.coalesce("comp", "rep").alias("comp")).distinct()
    kind = docs.schema[id_col].dataType
    ids = docs.select(F.col(id_col).alias("__id"), _node(docs, id_col).alias("node")).distinct()
    if isinstance(kind, T.IntegralType):
        joined = ids.join(comp, "node", "left").select(F.col("__id").alias(id_col), F.coalesce("comp", "node").cast(kind).alias("class_id"))
        return joined.withColumn("kept", F.coalesce(F.col("class_id") == F.col(id_col), F.lit(True)))
    joined = ids.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = joined.where(F.col("__id").isNotNull()).groupBy("comp").agg(F.min("__id").alias("class_id"))
    out = joined.join(names, "comp", "left").select(F.col("__id").alias(id_col), F.when(F.col("__id").isNotNull(), F.col("class_id")).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col(id_col), F.lit(True)))
