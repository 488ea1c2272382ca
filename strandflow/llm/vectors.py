"""Near-duplicate vectors of one label: int8 tile products with error bounds, full precision where they leave room.

Equal vectors of a label are collapsed first, with their number.  Distinct vectors are scaled to unit length u and
quantised: q = rint(u / s), s = max|u| / 127, e = u - s q.  Then

    u·v  <=  s t q·p + |s q| |f| + |e|        (v = t p + f, |v| = 1)

and q·p is an integer that float32 BLAS sums exactly up to 1040 components (float64 beyond).  The bound uses each vector's
own |e|, so it rules a pair out without error; only pairs whose bound reaches ``least`` are computed in double precision,
within the same task, and only those are ever listed, in pieces of bounded size.

Tiles.  Vectors of a label are dealt to the nearest of a few pivots and these cells to tiles of about ``tile`` vectors.
A tile keeps the range of its distances to each pivot.  Two unit vectors of cosine ``least`` are sqrt(2 - 2 least) apart
and so are their distances to any pivot at most: pairs of tiles with a wider gap at some pivot aren't compared.  A pair of
tiles is one row of work; it gives a row for each vector that has a link there (how many, and the least member it hangs
together with), never a row a link, so copies cost no more rows than other vectors.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component, and one with a null label, links
with nothing, so it is a component of its own; vectors of different length aren't compared; rows of one id are vectors of
their own that count each other if linked; a null id is never a component's id where there is another; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .neardup import components

PIVOTS = 16
#: Slack for rounding in double precision.
SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; exact, and cosines stay the same."""
    _, power = np.frexp(np.abs(x).max(1, initial=0))
    return np.ldexp(x, -power[:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their steps, and what each row is off in length."""
    step = np.abs(u).max(1) / 127
    q = np.rint(u / step[:, None])
    off = u - step[:, None] * q
    return q.astype(np.int8), step, np.sqrt(np.einsum("ij,ij->i", off, off)) + 1e-15


def upper_bounds(a: tuple, b: tuple) -> np.ndarray:
    """At least the cosine of each pair of rows of two quantised blocks."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64  # 1040 * 127² < 2^24
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    length = sa * np.sqrt(np.einsum("ij,ij->i", qa.astype(np.float64), qa.astype(np.float64)))
    product *= sa[:, None]
    product *= sb[None, :]
    product += length[:, None] * eb[None, :] + ea[:, None]
    return product


def linked(xa: np.ndarray, xb: np.ndarray, a: tuple, b: tuple, least: float, same: bool, piece: int = 1 << 15):
    """(i, j) of the pairs of cosine ``least`` or more, in pieces; within one block only i < j."""
    na, nb = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (xa, xb))
    for lo in range(0, len(xa), 256):  # a strip of the tile at a time
        rows = slice(lo, lo + 256)
        i, j = np.nonzero(upper_bounds(tuple(x[rows] for x in a), b) >= least - SLACK)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), piece):
            p, q = i[at : at + piece], j[at : at + piece]
            cosine = np.einsum("ij,ij->i", xa[p], xb[q]) / (na[p] * nb[q])
            on = cosine >= least
            if on.any():
                yield p[on], q[on]


class Forest:
    """Components of few numbered nodes, joined by arrays of links; labels are least members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            x, y = self.label[p], self.label[q]
            apart = x != y
            if not apart.any():
                return
            p, q = p[apart], q[apart]
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def _tile_rows(df: DataFrame, name: str, rows: int = 8) -> DataFrame:
    """Staged with few rows in an Arrow batch: a row is a tile or two."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        return staged(df, name)
    finally:
        spark.conf.set(key, before)


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, tile: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    ``n_links``: other rows of cosine ``least`` or more; ``component_id``: the least id that links reach."""
    fine = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0) & F.col(label).isNotNull(), F.lit(False))
    rows = df.select(F.col(id_col).alias("__id"), F.col(label).alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("x"), fine.alias("fine"))
    content = ["label", "dims", "k1", "k2"]
    keyed = rows.where("fine").select("__id", "label", "x", F.size("x").alias("dims"), F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"))
    distinct = keyed.groupBy(*content).agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")  # ids are fixed by the writing

    head = distinct.orderBy("k1", "k2").limit(PIVOTS).select("x").collect()
    pivots: dict[int, list] = {}
    for r in head:
        pivots.setdefault(len(r.x), []).append(units(scaled(np.array([r.x])))[0])

    def pivots_of(dims: int) -> np.ndarray:
        return np.array(pivots.get(dims) or [units(np.random.default_rng(dims).standard_normal((1, dims)))[0]])

    def distances(u: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * u @ pivots_of(u.shape[1]).T, 0))

    sizes = distinct.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    sized = distinct.join(sizes, ["label", "dims"]).select("node", "copies", "label", "dims", "x", F.least(F.ceil(F.col("n") / tile), F.lit(PIVOTS)).cast("int").alias("cells"))

    def dealt(batches):
        for batch in batches:
            dims, cells = (np.asarray(batch.column(i)) for i in (3, 5))
            lists = batch.column(4)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                away = distances(units(scaled(flat[starts[own][:, None] + np.arange(d)])))
                away[np.arange(away.shape[1])[None, :] >= cells[own][:, None]] = np.inf
                cell[own] = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cell)], names=[*batch.schema.names[:5], "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    celled = staged(sized.mapInArrow(dealt, f"node long, copies long, label {kinds['label']}, dims int, x array<double>, cell int"), "vector-cells")
    parts = celled.groupBy("label", "dims", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    placed = celled.join(parts, ["label", "dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = scaled(np.array(pdf["x"].tolist(), dtype=np.float64))
        u = units(x)
        q, step, off = quantised(u)
        away = distances(u)
        one = pdf.iloc[0]
        return pd.DataFrame({"label": [one.label], "dims": [one.dims], "tile": [f"{one.cell}:{one.part}"], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "q": [q.tobytes()], "step": [step.tobytes()], "off": [off.tobytes()], "near": [away.min(0).tolist()], "far": [away.max(0).tolist()]})

    body = ["nodes", "copies", "x", "q", "step", "off"]
    tiles = _tile_rows(placed.groupBy("label", "dims", "cell", "part").applyInPandas(packed, f"label {kinds['label']}, dims int, tile string, " + ", ".join(f"{c} binary" for c in body) + ", near array<double>, far array<double>"), "vector-tiles", 1000)

    reach = float(np.sqrt(2 - 2 * least)) + 1e-6
    a, b = (tiles.select("label", "dims", F.col("tile").alias(f"tile_{s}"), F.col("near").alias(f"near_{s}"), F.col("far").alias(f"far_{s}")) for s in "ab")
    gap = F.zip_with("near_a", "far_b", lambda p, q: p - q), F.zip_with("near_b", "far_a", lambda p, q: p - q)
    pairs = a.join(b, ["label", "dims"]).where("tile_a <= tile_b").where((F.array_max(gap[0]) <= reach) & (F.array_max(gap[1]) <= reach)).select("label", "dims", "tile_a", "tile_b")
    for s in "ab":
        pairs = pairs.join(tiles.select("label", "dims", F.col("tile").alias(f"tile_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in body)), ["label", "dims", f"tile_{s}"])

    def compared(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dims, same = r["dims"], r["tile_a"] == r["tile_b"]
                side = {s: {c: np.frombuffer(r[f"{c}_{s}"], {"x": np.float64, "q": np.int8, "step": np.float64, "off": np.float64}.get(c, np.int64)) for c in body} for s in "ab"}
                xa, xb = (side[s]["x"].reshape(-1, dims) for s in "ab")
                qa, qb = ((side[s]["q"].reshape(-1, dims), side[s]["step"], side[s]["off"]) for s in "ab")
                nodes = side["a"]["nodes"] if same else np.concatenate((side["a"]["nodes"], side["b"]["nodes"]))
                copies = side["a"]["copies"] if same else np.concatenate((side["a"]["copies"], side["b"]["copies"]))
                shift = 0 if same else len(xa)
                forest, links = Forest(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
                for i, j in linked(xa, xb, qa, qb, least, same):
                    j = j + shift
                    forest.join(i, j)
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(links[on]), pa.array(nodes[forest.label[on]])], names=["node", "links", "root"])

    found = _tile_rows(pairs.mapInArrow(compared, "node long, links long, root long"), "vector-links")
    comp = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = distinct.select("node", *content, "first_id", "copies").join(links, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_id = each.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    each = each.join(least_id, "comp").select(*content, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = keyed.drop("x").join(each, content).select("__id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
