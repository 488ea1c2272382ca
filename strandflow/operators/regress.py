"""Haplotype frequencies by sparse constrained regression.

Reads that fit the same set of haplotypes are one row of the match matrix P, weighted by their number, so PᵀP costs the
distinct sets times the haplotypes squared, however many reads there are.  The normal equations of a region are one row
(haplotypes are capped); every fit runs in numpy within a task: one task a region, or a few fits of a grid."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import staged

#: Fixed values of the two solvers and of the grid.
STEP, OUTER, INNER, TOLERANCE = 1e-5, 500, 1000, 1e-4
RHOS = (0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064)
LEAST = 0.001

Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _with_region(df: DataFrame) -> DataFrame:
    return df if "region" in df.columns else df.withColumn("region", F.lit(0))


def haplotype_sets(matrix: DataFrame, y: DataFrame) -> DataFrame:
    """(region, haps, n, sy, syy): reads by the set of haplotypes that they fit, with the sums of y and of its square.

    ``matrix`` (cstart, cseq, hap_id) and ``y`` (cstart, cseq, y) may have a column ``region``; else all is region 0.
    A read without y has 0."""
    key = ["region", "cstart", "cseq"]
    of_read = _with_region(matrix).groupBy(*key).agg(F.sort_array(F.collect_set("hap_id")).alias("haps"))  # capped haplotypes
    own = F.coalesce("y", F.lit(0.0))
    joined = of_read.join(_with_region(y).select(*key, "y"), key, "left")
    return joined.groupBy("region", "haps").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("sy"), F.sum(own * own).alias("syy"))


def gram(sets: DataFrame) -> DataFrame:
    """(region, a, b, g): PᵀP, the number of reads that fit both haplotypes; pairs that no read fits are left out.

    Each Arrow batch of sets makes one product in BLAS; batches are summed after."""
    kinds = {f.name: f.dataType for f in sets.schema.fields}
    of, region = kinds["haps"].elementType.simpleString(), kinds["region"].simpleString()

    def products(batches):
        for batch in batches:
            regions = batch.column(0).to_numpy(zero_copy_only=False)
            lists, weight = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            flat = lists.flatten().dictionary_encode()
            ids, at = flat.dictionary, np.asarray(flat.indices)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            for r in np.unique(regions):
                on = np.flatnonzero(regions == r)
                here = np.isin(row, on)
                own, column = np.unique(at[here], return_inverse=True)
                m = np.zeros((len(on), len(own)))
                m[np.searchsorted(on, row[here]), column] = 1
                g = m.T @ (m * weight[on][:, None])
                i, j = np.nonzero(g)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r)), ids.take(pa.array(own[i])), ids.take(pa.array(own[j])), pa.array(g[i, j])], names=["region", "a", "b", "g"])

    parts = sets.select("region", "haps", "n").mapInArrow(products, f"region {region}, a {of}, b {of}, g double")
    return parts.groupBy("region", "a", "b").agg(F.sum("g").cast("long").alias("g"))


def normal_equations(matrix: DataFrame, y: DataFrame) -> DataFrame:
    """(region, ids, g, r, yy): of each region the haplotypes that fit a read, PᵀP and Pᵀy as float64 bytes, and yᵀy."""
    sets = staged(haplotype_sets(matrix, y), "haplotype-sets")
    right = sets.select("region", F.explode("haps").alias("a"), "sy").groupBy("region", "a").agg(F.sum("sy").alias("v"))
    square = sets.groupBy("region").agg(F.sum("syy").alias("v"))
    kind = sets.schema["haps"].dataType.elementType.simpleString()
    none = F.lit(None).cast(kind)
    rows = gram(sets).select("region", "a", "b", F.col("g").cast("double").alias("v"))
    rows = rows.unionByName(right.select("region", "a", none.alias("b"), "v")).unionByName(square.select("region", none.alias("a"), none.alias("b"), "v"))

    def packed(table: pa.Table) -> pa.Table:
        a, b, v = (table.column(c).combine_chunks() for c in "abv")
        value = v.to_numpy(zero_copy_only=False)
        lone = b.is_null().to_numpy(zero_copy_only=False)
        total = lone & a.is_null().to_numpy(zero_copy_only=False)
        ids = a.filter(pa.array(lone & ~total))
        ids = ids.take(pa.array(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")))
        at = {x: i for i, x in enumerate(ids.to_pylist())}
        g, r = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        place = np.array([at.get(x, -1) for x in a.to_pylist()]), np.array([at.get(x, -1) for x in b.to_pylist()])
        g[place[0][~lone], place[1][~lone]] = value[~lone]
        r[place[0][lone & ~total]] = value[lone & ~total]
        columns = [table.column("region").combine_chunks()[:1], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([g.tobytes()]), pa.array([r.tobytes()]), pa.array([float(value[total].sum())])]
        return pa.table(columns, names=["region", "ids", "g", "r", "yy"])

    return rows.groupBy("region").applyInArrow(packed, f"region {sets.schema['region'].dataType.simpleString()}, ids array<{kind}>, g binary, r binary, yy double")


def _opened(row) -> tuple[list, np.ndarray, np.ndarray]:
    ids = list(row.ids)
    return ids, np.frombuffer(row.g).reshape(len(ids), len(ids)), np.frombuffer(row.r)


def fitted(normal: DataFrame, solve: Solver) -> DataFrame:
    """(region, hap_id, h): ``solve(PᵀP, Pᵀy)`` of each region, in a task a region."""
    kinds = {f.name: f.dataType.simpleString() for f in normal.schema.fields}

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                ids, g, r = _opened(row)
                yield pd.DataFrame({"region": row.region, "hap_id": ids, "h": np.asarray(solve(g, r), dtype=float)})

    return normal.mapInPandas(run, f"region {kinds['region']}, hap_id {kinds['ids'][6:-1]}, h double")


def stagewise(g: np.ndarray, r: np.ndarray, rho: float = 0.0, step: float = STEP) -> np.ndarray:
    """Forward stagewise: the coordinate of the steepest fall of |y - Ph|² + rho h'(J - I)h grows by a step until the sum is 1."""
    h = np.zeros(len(r))
    if not len(r):
        return h
    grad = 2 * r
    for _ in range(int(round(1 / step))):
        k = int(grad.argmax())
        h[k] += step
        grad = grad - 2 * step * g[:, k] - 2 * rho * step
        grad[k] += 2 * rho * step
    return h


def largest_eigenvalue(m: np.ndarray, tolerance: float = 1e-3, most: int = 1000) -> float:
    """By power iteration, to a relative tolerance."""
    v, last = np.ones(len(m)) / np.sqrt(max(len(m), 1)), 0.0
    for _ in range(most):
        w = m @ v
        size = float(np.linalg.norm(w))
        if size == 0:
            return 0.0
        v = w / size
        if abs(size - last) <= tolerance * size:
            return size
        last = size
    return last


def lagrangian(g: np.ndarray, r: np.ndarray, rho: float, seed: int, *, outer: int = OUTER, inner: int = INNER, tolerance: float = TOLERANCE, penalty: float = 1.0, growth: float = 1.2, multiplier: float = 0.0) -> np.ndarray:
    """Augmented Lagrangian with an accelerated projected gradient: h in [0, 1], sum 1; the start is random by ``seed``.

    The penalty of the sum's distance from 1 grows by ``growth`` after each outer round; inner rounds end when no share
    moves by more than ``tolerance`` steps."""
    n = len(r)
    if not n:
        return np.zeros(0)
    h = np.random.default_rng(seed).random(n)
    h /= h.sum()
    pull = np.ones((n, n)) - np.eye(n)
    for _ in range(outer):
        before = h.copy()
        rate = 1 / max(2 * largest_eigenvalue(g) + (2 * rho + penalty) * n, 1e-12)
        z, t = h.copy(), 1.0
        for _ in range(inner):
            grad = -2 * (r - g @ z) + 2 * rho * (pull @ z) - multiplier + penalty * (z.sum() - 1)
            new = np.clip(z - rate * grad, 0, 1)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z = new + (t - 1) / t_new * (new - h)
            moved = np.abs(new - h).max()
            h, t = new, t_new
            if moved < tolerance * rate:
                break
        multiplier -= penalty * (h.sum() - 1)
        penalty = min(penalty * growth, 1e4)
        if abs(h.sum() - 1) < tolerance and np.abs(h - before).max() < tolerance:
            break
    return h / h.sum() if h.sum() > 0 else np.full(n, 1 / n)


def refit(g: np.ndarray, r: np.ndarray, rho: float, seed: int, least: float = LEAST) -> np.ndarray:
    """A fit with ``rho``, and a second without it on the haplotypes that the first left above ``least``."""
    first = lagrangian(g, r, rho, seed)
    on = np.flatnonzero(first > least)
    out = np.zeros(len(r))
    out[on] = lagrangian(g[np.ix_(on, on)], r[on], 0.0, seed)
    return out


def fit_grid(matrix: DataFrame, y: DataFrame, *, rhos: tuple[float, ...] = RHOS, repeats: int = 100, two_stage: bool = True, fits_a_task: int = 25) -> DataFrame:
    """(region, fit_id, rho, rep, hap_id, h, cost, k) of all fits of the grid; costs from the normal equations.

    A fit is numbered by rho and repetition, which seeds it; a task takes a few fits of a region."""
    normal, total = normal_equations(matrix, y), len(rhos) * repeats
    kinds = {f.name: f.dataType.simpleString() for f in normal.schema.fields}
    parts = max(1, -(-total // fits_a_task))
    solve = refit if two_stage else lagrangian

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                ids, g, r = _opened(row)
                for fit in range(row.part * fits_a_task, min(total, (row.part + 1) * fits_a_task)):
                    rho = float(rhos[fit // repeats])
                    h = solve(g, r, rho, fit)
                    cost = float(h @ g @ h - 2 * r @ h + row.yy)
                    yield pd.DataFrame({"region": row.region, "fit_id": fit, "rho": rho, "rep": fit % repeats, "hap_id": ids, "h": h, "cost": cost, "k": int((h > LEAST).sum())})

    dealt = normal.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "region", "part")
    return dealt.mapInPandas(run, f"region {kinds['region']}, fit_id int, rho double, rep int, hap_id {kinds['ids'][6:-1]}, h double, cost double, k int")


def solution(fits: DataFrame, haps: DataFrame, least: float = LEAST) -> DataFrame:
    """(hap_id, h, cseq) of the fit that the elbow of bucket bests picks, haplotypes above ``least`` only; fits of one region."""
    from .support import bucket_best, elbow_pick

    heads = fits.select("fit_id", "k", F.round("cost", 9).alias("cost")).distinct()
    chosen = elbow_pick(bucket_best(heads)).select("fit_id")
    return fits.join(F.broadcast(chosen), "fit_id").where(F.col("h") > least).join(haps, "hap_id").select("hap_id", F.round("h", 6).alias("h"), "cseq")


def local_prune(normal: DataFrame, *, most: int = 1000, rho: float = 0.001, rounds: int = 30, step: float = STEP) -> DataFrame:
    """(region, hap_id) left in each region after stagewise fits with rho doubled until the product of their numbers is
    below ``most``; a region keeps one haplotype at least.  Raises if ``rounds`` are not enough.

    ``normal``: normal equations, a row a region.  Each round is written; only the product comes to the driver."""

    def pruned(weight: float):
        def run(frames):
            for pdf in frames:
                left = []
                for row in pdf.itertuples():
                    ids, g, r = _opened(row)
                    at = {x: i for i, x in enumerate(ids)}
                    on = [at[x] for x in row.kept]
                    h = stagewise(g[np.ix_(on, on)], r[on], weight, step)
                    left.append([x for x, v in zip(row.kept, h, strict=True) if v >= LEAST] or list(row.kept)[:1])
                yield pdf.assign(kept=left)

        return run

    now = staged(normal.withColumn("kept", F.col("ids")), "prune")
    for _ in range(rounds):
        if (now.agg(F.product(F.size("kept").cast("double"))).first()[0] or 0) < most:
            return now.select("region", F.explode("kept").alias("hap_id"))
        now = staged(now.mapInPandas(pruned(rho), now.schema), "prune")
        rho *= 2
    raise RuntimeError(f"more than {most} global haplotypes after {rounds} rounds of pruning")
