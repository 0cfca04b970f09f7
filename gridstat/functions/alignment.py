"""Pairwise alignment of many pairs at once, with a substitution table, affine gaps and free ends.

All pairs of a batch go through the recurrences together, one anti-diagonal at a time: the cells of an anti-diagonal
depend on the two before it only, so each is a few array operations over (pairs, places), whatever the lengths.  The way
back is taken for all pairs at once too.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the way back that a batch holds; a single pair of n x m symbols needs (n + m) x n.
CELLS = 1 << 26
LOW = -1e18
MATCH, MISMATCH, OPEN, EXTEND = 5.0, -4.0, -12.0, -1.0


def _coded(texts: list[str], symbols: np.ndarray) -> np.ndarray:
    """Texts as rows of places in ``symbols``, padded with 0."""
    out = np.zeros((len(texts), max(map(len, texts), default=0)), np.intp)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.searchsorted(symbols, np.frombuffer(t.encode("utf-32-le"), "<u4"))
    return out


def table_of(symbols: np.ndarray, scores: dict[tuple[str, str], float] | None) -> np.ndarray:
    """Scores of all pairs of symbols: those of ``scores`` in either order, else match or mismatch."""
    out = np.full((len(symbols), len(symbols)), MISMATCH)
    np.fill_diagonal(out, MATCH)
    at = {chr(c): i for i, c in enumerate(symbols)}
    for (a, b), v in (scores or {}).items():
        if a in at and b in at:
            out[at[a], at[b]] = out[at[b], at[a]] = v
    return out


def _batch(a: list[str], b: list[str], scores: dict[tuple[str, str], float] | None, gap_open: float, gap_extend: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    symbols = np.unique(np.frombuffer("".join([*a, *b]).encode("utf-32-le"), "<u4"))
    x, y, table = _coded(a, symbols), _coded(b, symbols), table_of(symbols, scores)
    pairs, n, m = len(a), x.shape[1], y.shape[1]
    own_n, own_m = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    every = np.arange(pairs)
    border = lambda v: np.full((pairs, n + 1), v)
    best, before, up, left = border(0.0), border(0.0), border(LOW), border(LOW)
    way = np.zeros((n + m + 1, pairs, n + 1), np.uint8)
    top, end_i, end_j = np.zeros(pairs), np.zeros(pairs, np.intp), np.zeros(pairs, np.intp)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        here, prev = slice(lo, hi + 1), slice(lo - 1, hi)
        diag = before[:, prev] + table[x[:, prev], y[:, d - hi - 1 : d - lo][:, ::-1]]
        down_open, down = best[:, prev] + gap_open, up[:, prev] + gap_extend
        side_open, side = best[:, here] + gap_open, left[:, here] + gap_extend
        new_up, new_left, new = border(LOW), border(LOW), border(0.0)
        new_up[:, here], new_left[:, here] = np.maximum(down_open, down), np.maximum(side_open, side)
        value = np.maximum(diag, np.maximum(new_up[:, here], new_left[:, here]))
        new[:, here] = value
        # ties: a pair of symbols, then a gap in b, then one in a; a gap goes on rather than opens
        source = np.where(value == diag, 0, np.where(value == new_up[:, here], 1, 2))
        way[d, :, here] = (source | (down_open > down) << 2 | (side_open > side) << 3).astype(np.uint8)
        best, before, up, left = new, best, new_up, new_left
        # ends are free: the best cell where one side is used up, the first such
        for i, j in ((own_n, d - own_n), (d - own_m, own_m)):
            ok = (i >= 1) & (j >= 1) & (i <= own_n) & (j <= own_m)
            v = np.where(ok, best[every, np.clip(i, 0, n)], -np.inf)
            better = v > top
            top[better], end_i[better], end_j[better] = v[better], i[better], j[better]
    out: list[np.ndarray] = []
    i, j, state = end_i.copy(), end_j.copy(), np.zeros(pairs, np.intp)
    while len(go := np.flatnonzero((i > 0) & (j > 0))):
        f, s = way[i[go] + j[go], go, i[go]], state[go]
        step = (s == 0) & (f & 3 == 0)
        out.append(np.stack([go, i[go] - 1, j[go] - 1])[:, step])
        i[go] -= step | (s == 1)
        j[go] -= step | (s == 2)
        opened = ((s == 1) & (f >> 2 & 1 == 1)) | ((s == 2) & (f >> 3 & 1 == 1))
        state[go] = np.where(s == 0, f & 3, np.where(opened, 0, s))
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.intp)
    found = found[:, np.lexsort((found[1], found[0]))]
    return top, *found


def align_many(a: list[str], b: list[str], scores: dict[tuple[str, str], float] | None = None, gap_open: float = OPEN, gap_extend: float = EXTEND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The score of each pair (a[k], b[k]), and (k, i, j) of all places that face one another, in order.

    A gap of g places costs ``gap_open`` + (g - 1) x ``gap_extend``; before the first and after the last pair of symbols
    it costs nothing.  A pair whose best score is not above 0 has no places.  Pairs are batched by length, ``CELLS`` bytes at once.
    """
    n, m = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
    total, found = np.zeros(len(a)), []
    order = [int(k) for k in np.lexsort((m, n)) if n[k] and m[k]]
    at = 0
    while at < len(order):
        end, widest = at, 0
        while end < len(order):
            widest = max(widest, int(m[order[end]]))
            long = int(n[order[end]])
            if end > at and (end - at + 1) * (long + widest + 1) * (long + 1) > CELLS:
                break
            end += 1
        some = order[at:end]
        top, k, i, j = _batch([a[x] for x in some], [b[x] for x in some], scores, gap_open, gap_extend)
        total[some] = top
        found.append(np.stack([np.array(some, np.intp)[k], i, j]))
        at = end
    f = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.intp)
    f = f[:, np.argsort(f[0], kind="stable")]
    return total, *f
