"""The sampler of ``cluster`` for windows of many reads: bulk-synchronous sweeps over parts of a window.

A window's reads are dealt to parts.  What a read's class is drawn from are small tables of the window: the reads of each
class, their bases at each site, the haplotype drawn for it, and the two shares theta and gamma.  In a step every part takes
these as they stand, sweeps over its own reads ``sync`` times - its own reads taken out of the tables and put in again as
they move, the other parts' frozen - and gives back its classes and its share of the tables.  Then the shares are summed,
haplotypes are drawn for the whole window, and classes with equal haplotypes become one.  Both sides of a step are written.

A class that begins in a part has an id that no other part gives.  Everything drawn is seeded by window, part and step, so
reruns and retries agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import CLUSTER_ORDER
from ..functions.tables import sized, staged
from .sampling import ALPHA, BURN_IN, CLASSES, SWEEPS, SYMBOLS, TINY, compared, mode_of, new_class_log, pick

PART = "window_id int, part int, length int, n long, reads binary, codes binary, cnt binary, who binary, history binary, ids binary, seen binary, size binary, matched long"
STATE = "window_id int, ids binary, seen binary, size binary, haps binary, theta double, gamma double, matched long, n_reads long, was binary, becomes binary"


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def class_bases(codes: np.ndarray, cnt: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """[class, site, symbol]: the counted bases of the reads of each class."""
    n, sites = codes.shape
    read, site = np.nonzero(codes >= 0)
    cell = (at[read] * sites + site) * SYMBOLS + codes[read, site]
    return np.bincount(cell, weights=cnt[read], minlength=k * sites * SYMBOLS).reshape(k, sites, SYMBOLS)


def drawn(seen: np.ndarray, theta: float, rng: np.random.Generator | None) -> np.ndarray:
    """[class, site]: a base drawn by the class's bases, the most frequent one without ``rng``; -1 where none is known."""
    total = seen.sum(2)
    if rng is None:
        return np.where(total > 0, seen.argmax(2), -1)
    logs = seen * np.log(theta) + (total[..., None] - seen) * np.log((1 - theta) / (SYMBOLS - 1))
    out = np.full(total.shape, -1, dtype=np.int64)
    for k, s in zip(*np.nonzero(total > 0), strict=True):
        out[k, s] = pick(logs[k, s], rng)
    return out


def equal_classes(haps: np.ndarray) -> np.ndarray:
    """For each class the first class of an equal haplotype."""
    _, first, place = np.unique(haps, axis=0, return_index=True, return_inverse=True)
    return first[place.reshape(-1)]


def shares(matched: int, n: int, haps: np.ndarray, reference: np.ndarray, length: int) -> tuple[float, float]:
    """Theta and gamma: places where reads equal their class, and classes the reference; a place that is no site is equal."""
    sites = haps.shape[1]
    theta = (matched + (length - sites) * n) / max(length * n, 1)
    gamma = (((haps == reference) & (haps >= 0)).sum() + (length - sites) * len(haps)) / max(length * len(haps), 1)
    return tuple(float(min(max(x, TINY), 1 - TINY)) for x in (theta, gamma))


def part_sweeps(codes: np.ndarray, cnt: np.ndarray, reference: np.ndarray, length: int, at: np.ndarray, state: dict, *, sweeps: int, new_id: int, rng: np.random.Generator, alpha: float = ALPHA) -> tuple[list[np.ndarray], dict]:
    """The class ids of a part's reads after each of ``sweeps`` sweeps, and its share of the window's tables.

    ``at``: the reads' places in ``state["ids"]``; ``state``: ids, seen, size, haps, theta, gamma and n_reads of the whole
    window, and ``rest``, the equal sites of the other parts' reads (None before the first sweep: as many a read as here);
    ``new_id``: the id of the first class that begins here."""
    known, k = codes >= 0, len(state["ids"])
    ids, haps, theta, gamma = state["ids"].copy(), state["haps"].copy(), state["theta"], state["gamma"]
    who = at.copy()
    own_size = np.bincount(who, weights=cnt, minlength=k)
    rest_seen, rest_size = state["seen"] - class_bases(codes, cnt, who, k), np.maximum(state["size"] - own_size, 0)
    matched_of = lambda h, w: int(((codes == h[w]) & known & (h[w] >= 0)).sum())
    rest_matched, n_all = state["rest"], state["n_reads"]
    if rest_matched is None:
        rest_matched = matched_of(haps, who) * (n_all - len(codes)) // max(len(codes), 1)
    ref_m, ref_d = compared(codes, known, reference)
    out = []
    for _ in range(sweeps):
        size = rest_size + np.bincount(who, weights=cnt, minlength=len(ids))
        equal, unequal = np.log(theta), np.log((1 - theta) / (SYMBOLS - 1))
        fit = np.stack([m * equal + d * unequal for m, d in (compared(codes, known, h) for h in haps)], axis=1)
        as_reference = ref_m * equal + ref_d * unequal
        new = new_class_log(cnt, ref_m, ref_d, theta, gamma, alpha)
        for i in range(len(codes)):
            size[who[i]] -= cnt[i]
            live = np.flatnonzero(size > 0.5)
            j = pick(np.append(np.log(size[live]) + fit[i, live], new[i]), rng)
            if j < len(live):
                who[i] = live[j]
            elif size[who[i]] <= 0.5:  # alone in its class, which begins anew
                fit[:, who[i]] = as_reference
            else:
                who[i], new_id = len(ids), new_id + 1
                ids, size, fit = np.append(ids, new_id - 1), np.append(size, 0.0), np.column_stack((fit, as_reference))
                rest_size, rest_seen = np.append(rest_size, 0.0), np.concatenate((rest_seen, np.zeros((1, *rest_seen.shape[1:]))))
            size[who[i]] += cnt[i]
        live = np.flatnonzero(size > 0.5)
        place = np.searchsorted(live, who)
        seen = rest_seen[live] + class_bases(codes, cnt, place, len(live))
        haps = drawn(seen, theta, rng)
        same = equal_classes(haps)
        kept, index = np.unique(same, return_inverse=True)
        rest_seen = np.stack([rest_seen[live][index == x].sum(0) for x in range(len(kept))])
        rest_size = np.bincount(index, weights=rest_size[live], minlength=len(kept))
        ids, haps, who = ids[live[kept]], haps[kept], index[place]
        matched = rest_matched + matched_of(haps, who)
        theta, gamma = shares(matched, n_all, haps, reference, length)
        out.append(ids[who])
    own = np.unique(who)
    share = {"ids": ids[own], "seen": class_bases(codes, cnt, np.searchsorted(own, who), len(own)), "size": np.bincount(np.searchsorted(own, who), weights=cnt), "matched": matched_of(haps, who)}
    return out, share


def summed(parts: list[dict], n: int, theta: float, reference: np.ndarray, length: int, rng: np.random.Generator | None) -> dict:
    """The window's tables from its parts' shares, with haplotypes drawn and equal classes joined."""
    ids = np.unique(np.concatenate([p["ids"] for p in parts]))
    sites = len(reference)
    seen, size = np.zeros((len(ids), sites, SYMBOLS)), np.zeros(len(ids))
    for p in parts:
        place = np.searchsorted(ids, p["ids"])
        seen[place] += p["seen"]
        size[place] += p["size"]
    haps = drawn(seen, theta, rng)
    same = equal_classes(haps)
    kept, index = np.unique(same, return_inverse=True)
    theta, gamma = (1 - TINY, 1 - TINY) if rng is None else shares(sum(p["matched"] for p in parts), n, haps[kept], reference, length)
    together = np.stack([seen[index == x].sum(0) for x in range(len(kept))])
    return {"ids": ids[kept], "seen": together, "size": np.bincount(index, weights=size, minlength=len(kept)), "haps": haps[kept], "theta": theta, "gamma": gamma, "matched": sum(p["matched"] for p in parts), "n_reads": n, "was": ids, "becomes": ids[kept][index]}


def assigned_in_parts(bases: DataFrame, sites: DataFrame, reference: dict[int, str], *, seed: int, part_reads: int, sync: int, sweeps: int = SWEEPS, burn_in: int = BURN_IN, classes: int = CLASSES) -> DataFrame:
    """(window_id, read_id, class_id) of the reads of ``bases`` (window_id, read_id, cnt, vi, base); about ``part_reads``
    reads a part, ``sync`` sweeps a step."""
    n = bases.groupBy("window_id").agg(F.countDistinct("read_id").alias("n"))
    of_window = staged(n.join(sites, "window_id"), "sampler-windows")  # one row a window
    own = bases.join(sized(of_window), "window_id").withColumn("part", F.pmod(F.xxhash64("read_id"), F.ceil(F.col("n") / part_reads)).cast("int"))

    def referenced(a: int, b: int) -> np.ndarray:
        return np.array([CLUSTER_ORDER.find(reference.get(v, "?")) for v in range(a, b + 1)])

    def opened(row, names: dict) -> dict:
        return {k: np.frombuffer(getattr(row, k), kind) for k, kind in names.items()}

    def begun(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        a, b = int(one.f_start), int(one.f_end)
        ids = np.sort(pdf.read_id.unique())
        codes, cnt = np.full((len(ids), b - a + 1), -1, dtype=np.int8), np.zeros(len(ids))
        at = np.searchsorted(ids, pdf.read_id)
        codes[at, pdf.vi.to_numpy() - a] = [CLUSTER_ORDER.find(x) for x in pdf.base]
        cnt[at] = pdf.cnt
        who = np.random.default_rng([seed, int(one.window_id), int(one.part)]).integers(0, max(1, min(classes, int(one.n))), len(ids))
        kept, place = np.unique(who, return_inverse=True)
        row = {"window_id": int(one.window_id), "part": int(one.part), "length": int(one.w_end - one.w_start), "n": int(one.n), "reads": _bytes(ids, np.int64), "codes": _bytes(codes, np.int8), "cnt": _bytes(cnt, float), "who": _bytes(who, np.int64), "history": b""}
        return pd.DataFrame([row | {"ids": _bytes(kept, np.int64), "seen": _bytes(class_bases(codes, cnt, place, len(kept)), float), "size": _bytes(np.bincount(place, weights=cnt), float), "matched": 0, "f_start": a, "f_end": b}])

    schema = f"{PART}, f_start int, f_end int"
    parts = staged(own.groupBy("window_id", "part").applyInPandas(begun, schema), "sampler-parts")

    def united(step: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            one = pdf.iloc[0]
            ref = referenced(int(one.f_start), int(one.f_end))
            shares_ = []
            for row in pdf.sort_values("part").itertuples():
                x = opened(row, {"ids": np.int64, "seen": float, "size": float})
                shares_.append(x | {"seen": x["seen"].reshape(len(x["ids"]), len(ref), SYMBOLS), "matched": row.matched})
            theta = float(one.theta) if step else 1 - TINY
            rng = np.random.default_rng([seed, int(one.window_id), step, 7]) if step else None
            s = summed(shares_, int(one.n), theta, ref, int(one.length), rng)
            kinds = {"ids": np.int64, "seen": float, "size": float, "haps": np.int64, "was": np.int64, "becomes": np.int64}
            return pd.DataFrame([{"window_id": int(one.window_id)} | {k: _bytes(v, kinds[k]) if k in kinds else v for k, v in s.items()}])[[c.split(" ")[0] for c in STATE.split(", ")]]

        return run

    def stepped(step: int, count: int, first: int):
        def run(frames):
            for pdf in frames:
                out = []
                for row in pdf.itertuples():
                    ref = referenced(row.f_start, row.f_end)
                    x = opened(row, {"reads": np.int64, "codes": np.int8, "cnt": float, "who": np.int64, "history": np.int64, "s_ids": np.int64, "s_seen": float, "s_size": float, "s_haps": np.int64, "was": np.int64, "becomes": np.int64})
                    k, m = len(x["s_ids"]), len(x["reads"])
                    codes = x["codes"].reshape(m, len(ref)).astype(np.int64)
                    state = {"ids": x["s_ids"], "seen": x["s_seen"].reshape(k, len(ref), SYMBOLS), "size": x["s_size"], "haps": x["s_haps"].reshape(k, len(ref)), "theta": row.theta, "gamma": row.gamma, "n_reads": row.n_reads}
                    at = np.searchsorted(x["s_ids"], x["becomes"][np.searchsorted(x["was"], x["who"])])
                    state["rest"] = row.s_matched - row.matched if step else None
                    rng = np.random.default_rng([seed, row.window_id, row.part, step])
                    new_id = 1 << 20 | (step << 40) | (row.part << 21)
                    who, share = part_sweeps(codes, x["cnt"], ref, row.length, at, state, sweeps=count, new_id=new_id, rng=rng)
                    kept = [w for i, w in enumerate(who) if first + i >= burn_in]
                    history = np.column_stack([x["history"].reshape(m, -1), *kept]) if kept else x["history"].reshape(m, -1)
                    out.append({c: getattr(row, c) for c in ("window_id", "part", "length", "n", "reads", "codes", "cnt")} | {"who": _bytes(who[-1], np.int64), "history": _bytes(history, np.int64), "ids": _bytes(share["ids"], np.int64), "seen": _bytes(share["seen"], float), "size": _bytes(share["size"], float), "matched": share["matched"], "f_start": row.f_start, "f_end": row.f_end})
                yield pd.DataFrame(out)

        return run

    state, done, step, n_parts = None, 0, 0, max(1, parts.count())
    small = ["window_id", "part", "length", "n", "ids", "seen", "size", "matched", "f_start", "f_end"]
    while done < sweeps:
        before = parts.select(*small) if state is None else parts.select(*small).join(state.select("window_id", "theta"), "window_id")
        state = staged(before.groupBy("window_id").applyInPandas(united(step), STATE), "sampler-tables")
        now = state.select("window_id", *(F.col(c).alias(f"s_{c}") for c in ("ids", "seen", "size", "haps", "matched")), "theta", "gamma", "n_reads", "was", "becomes")
        count = min(sync, sweeps - done)
        dealt = parts.drop("ids", "seen", "size").join(now, "window_id")
        parts = staged(dealt.repartition(n_parts, "window_id", "part").mapInPandas(stepped(step, count, done + 1), schema), "sampler-parts")
        done, step = done + count, step + 1

    def final(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                reads = np.frombuffer(row.reads, np.int64)
                history = np.frombuffer(row.history, np.int64).reshape(len(reads), -1)
                own = mode_of(history.T) if history.shape[1] else np.frombuffer(row.who, np.int64)
                yield pd.DataFrame({"window_id": row.window_id, "read_id": reads, "own": own})

    found = staged(parts.select("window_id", "reads", "who", "history").mapInPandas(final, "window_id int, read_id long, own long"), "sampler-classes")
    number = (F.row_number().over(Window.partitionBy("window_id").orderBy("own")) - 1).cast("int")
    names = found.select("window_id", "own").distinct().withColumn("class_id", number)  # the classes of a window
    return found.join(names, ["window_id", "own"]).select("window_id", "read_id", "class_id")
