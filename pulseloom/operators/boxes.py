"""How many weighted points lie within a tolerance of others in every coordinate, without a row or a step per pair."""

from __future__ import annotations

import numpy as np

#: Up to this many comparisons are made directly.
DIRECT = 1 << 22


def reach(values: np.ndarray, at: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the sorted values with abs(value - at) <= tol, by that comparison itself."""
    top = len(values) - 1
    lo, hi = np.searchsorted(values, at - tol), np.searchsorted(values, at + tol, "right")
    for _ in range(3):  # at - tol and at + tol are rounded
        lo = lo - ((lo > 0) & (np.abs(values[np.maximum(lo - 1, 0)] - at) <= tol))
        lo = lo + ((lo <= top) & (values[np.minimum(lo, top)] < at) & (np.abs(values[np.minimum(lo, top)] - at) > tol))
        hi = hi + ((hi <= top) & (np.abs(values[np.minimum(hi, top)] - at) <= tol))
        hi = hi - ((hi > 0) & (values[np.maximum(hi - 1, 0)] > at) & (np.abs(values[np.maximum(hi - 1, 0)] - at) > tol))
    return lo, hi


def _below(keys: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, tops: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of tops: the weight at places left to right - 1 whose key is less than the top; a wavelet matrix over the keys' bits."""
    bits = max(1, int(keys.max()).bit_length()) if len(keys) else 1
    out = [np.zeros(len(left), np.int64) for _ in tops]
    spans = [(left.copy(), right.copy()) for _ in tops]
    tops = [np.minimum(t, 1 << bits) for t in tops]
    for t, o in zip(tops, out, strict=True):
        whole = np.concatenate([[0], np.cumsum(weight)])
        every = t == 1 << bits
        o[every] = (whole[right] - whole[left])[every]
    live = [t < 1 << bits for t in tops]
    for b in reversed(range(bits)):
        one = (keys >> b & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        keys, weight = keys[order], weight[order]
        sums = np.concatenate([[0], np.cumsum(weight)])
        for k, t in enumerate(tops):
            lo, hi = spans[k]
            zlo, zhi = zeros[lo], zeros[hi]
            up = (t >> b & 1).astype(bool)
            out[k] += np.where(up & live[k], sums[zhi] - sums[zlo], 0)
            spans[k] = np.where(up, zeros[-1] + lo - zlo, zlo), np.where(up, zeros[-1] + hi - zhi, zhi)
    return out


def _two(x: np.ndarray, y: np.ndarray, weight: np.ndarray, xs: tuple[np.ndarray, np.ndarray], ys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The weight of points of keys x, sorted, and ranks y in the ranges xs, of keys, and ys, of ranks."""
    left, right = np.searchsorted(x, xs[0]), np.searchsorted(x, xs[1])
    low, high = _below(y, weight, left, np.maximum(left, right), [ys[0], ys[1]])
    return high - low


def within(points: np.ndarray, weight: np.ndarray, at: np.ndarray, tol: float) -> np.ndarray:
    """For each row of `at`, the weight of the points with abs(point - at) <= tol in every column; a missing value is near nothing.

    Two columns take the order of the first and a wavelet matrix over the second. Three do so within blocks of 2 ** b ranks of the
    third, for each b: a range of ranks is at most two blocks of each size. Further columns, as few points, are compared directly.
    """
    known, asked = ~np.isnan(points).any(1), ~np.isnan(at).any(1)
    out = np.zeros(len(at), np.int64)
    points, weight, at = points[known], weight[known], at[asked]
    width = points.shape[1]
    if not len(points) or not len(at):
        return out
    if len(points) * len(at) <= DIRECT or width > 3:
        step = max(1, DIRECT // len(points))
        got = [(np.all([np.abs(points[None, :, c] - at[a : a + step, None, c]) <= tol for c in range(width)], 0) @ weight) for a in range(0, len(at), step)]
        out[asked] = np.concatenate(got)
        return out
    ranks, ranges = [], []
    for c in range(width):
        values, rank = np.unique(points[:, c], return_inverse=True)
        ranks.append(rank.ravel().astype(np.int64))
        ranges.append(reach(values, at[:, c], tol))
    order = np.argsort(ranks[0], kind="stable")
    ranks, weight = [r[order] for r in ranks], weight[order]
    if width == 1:
        sums = np.concatenate([[0], np.cumsum(weight)])
        out[asked] = sums[np.searchsorted(ranks[0], ranges[0][1])] - sums[np.searchsorted(ranks[0], ranges[0][0])]
        return out
    if width == 2:
        out[asked] = _two(ranks[0], ranks[1], weight, ranges[0], ranges[1])
        return out
    got, (low, high) = np.zeros(len(at), np.int64), ranges[2]
    low, high, size = low.copy(), np.maximum(low, high), int(ranks[0].max()) + 2
    for b in range(int(ranks[2].max() + 1).bit_length() + 1):
        # The blocks at both ends that no larger block of the range takes.
        first, last = (low & 1).astype(bool) & (low < high), (high & 1).astype(bool) & (low < high)
        who = np.concatenate([np.flatnonzero(first), np.flatnonzero(last)])
        block = np.concatenate([low[first], high[last] - 1])
        if len(who):
            key = (ranks[2] >> b) * size + ranks[0]
            place = np.argsort(key, kind="stable")
            more = _two(key[place], ranks[1][place], weight[place], (block * size + ranges[0][0][who], block * size + ranges[0][1][who]), (ranges[1][0][who], ranges[1][1][who]))
            np.add.at(got, who, more)
        low, high = low + first >> 1, high - last >> 1
    out[asked] = got
    return out
