"""The Dirichlet-process sampler of a window in numpy: what a task runs, for a whole window or for a part of one."""

from __future__ import annotations

import numpy as np

#: Concentration, sweeps, first sweep of the history, classes at first, symbols.
ALPHA, SWEEPS, BURN_IN, CLASSES, SYMBOLS = 0.04, 149, 100, 10, 5
TINY = 1e-9


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum()))


def pick(logs: np.ndarray, rng: np.random.Generator) -> int:
    """An index drawn by log weights: the inverse of the distribution in order of descending weight."""
    p = np.exp(logs - _log_sum(logs))
    order = np.argsort(-p, kind="stable")
    return int(order[min(np.searchsorted(np.cumsum(p[order]), rng.random() * p.sum(), side="right"), len(p) - 1)])


def compared(codes: np.ndarray, known: np.ndarray, haplotype: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal and different sites of every read and a haplotype."""
    both = known & (haplotype >= 0)
    same = ((codes == haplotype) & both).sum(1)
    return same, both.sum(1) - same


def new_class_log(cnt: np.ndarray, ref_m: np.ndarray, ref_d: np.ndarray, theta: float, gamma: float, alpha: float) -> np.ndarray:
    """The log weight of a class of its own for every read, which begins with the reference."""
    b = SYMBOLS
    same = theta * gamma + (1 - gamma) * (1 - theta) / (b - 1)
    other = max((theta + gamma + b * (1 - gamma * theta) - 2) / (b - 1) ** 2, 1e-300)
    return np.log(alpha) + np.log(cnt) + ref_m * np.log(same) + ref_d * np.log(other)


def mode_of(history: np.ndarray) -> np.ndarray:
    """Of each column of [sweep, read] the most frequent class, the one met first on a tie."""
    out = np.zeros(history.shape[1], dtype=np.int64)
    for i in range(history.shape[1]):
        values, first, seen = np.unique(history[:, i], return_index=True, return_counts=True)
        out[i] = values[np.lexsort((first, -seen))[0]]
    return out


def sample_window(codes: np.ndarray, cnt: np.ndarray, reference: np.ndarray, length: int, seed: int, *, sweeps: int = SWEEPS, burn_in: int = BURN_IN, classes: int = CLASSES, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a window's reads and the haplotype of each class.

    ``codes``: reads x sites, rank of the base in A, C, T, G, -, or -1 where unknown; ``reference`` likewise, with which a
    new class begins."""
    rng = np.random.default_rng(seed)
    n, sites = codes.shape
    known = codes >= 0
    cell = np.arange(sites) * SYMBOLS + codes
    theta, gamma = 1 - TINY, 1 - TINY
    history: list[np.ndarray] = []

    def consensus(group: np.ndarray, draw: bool) -> np.ndarray:
        at, weight = known[group], np.broadcast_to(cnt[group][:, None], (len(group), sites))
        seen = np.bincount(cell[group][at], weights=weight[at], minlength=sites * SYMBOLS).reshape(sites, SYMBOLS)
        total = seen.sum(1, keepdims=True)
        if not draw:
            return np.where(total[:, 0] > 0, seen.argmax(1), -1)
        logs = seen * np.log(theta) + (total - seen) * np.log((1 - theta) / (SYMBOLS - 1))
        return np.array([pick(logs[s], rng) if total[s, 0] else -1 for s in range(sites)], dtype=np.int64)

    ref_m, ref_d = compared(codes, known, reference)
    # ``who`` has rows of ``haps``; ``ids`` are the rows' classes, ascending, and ``size`` their reads
    ids, who = np.unique(rng.integers(0, max(1, min(classes, n)), n), return_inverse=True)
    haps = np.stack([consensus(np.flatnonzero(who == k), False) for k in range(len(ids))])
    for sweep in range(1, sweeps + 1):
        size = np.bincount(who, weights=cnt, minlength=len(ids))
        equal, unequal = np.log(theta), np.log((1 - theta) / (SYMBOLS - 1))
        fit = np.stack([m * equal + d * unequal for m, d in (compared(codes, known, h) for h in haps)], axis=1)  # [read, class], as are the haplotypes
        as_reference = ref_m * equal + ref_d * unequal
        new = new_class_log(cnt, ref_m, ref_d, theta, gamma, alpha)
        for i in range(n):
            size[who[i]] -= cnt[i]
            live = np.flatnonzero(size > 0)
            k = pick(np.append(np.log(size[live]) + fit[i, live], new[i]), rng)
            if k < len(live):
                who[i] = live[k]
            elif size[who[i]] == 0:  # a read that was alone keeps its class, which begins anew
                fit[:, who[i]] = as_reference
            else:
                who[i] = len(ids)
                ids, size, fit = np.append(ids, ids[-1] + 1), np.append(size, 0.0), np.column_stack((fit, as_reference))
            size[who[i]] += cnt[i]
        live = np.unique(who)
        drawn = np.stack([consensus(np.flatnonzero(who == k), True) for k in live])
        _, first, place = np.unique(drawn, axis=0, return_index=True, return_inverse=True)  # equal haplotypes become one class
        kept = np.sort(first)
        who = np.searchsorted(kept, first[place.reshape(-1)])[np.searchsorted(live, who)]
        ids, haps = ids[live[kept]], drawn[kept]
        own = haps[who]
        both = known & (own >= 0)
        theta = float(np.clip(((codes == own) & both).sum() + (length - sites) * n, 0, None)) / max(length * n, 1)
        theta = min(max(theta, TINY), 1 - TINY)
        gamma = ((haps == reference) & (haps >= 0)).sum() + (length - sites) * len(haps)
        gamma = min(max(float(gamma) / max(length * len(haps), 1), TINY), 1 - TINY)
        if sweep >= burn_in:
            history.append(ids[who])
    last = np.stack(history) if history else ids[who][None]
    final = mode_of(last)
    return final, np.stack([consensus(np.flatnonzero(final == final[i]), False) for i in range(n)])
