"""4x4 colour blocks: two 565 endpoints and sixteen 2-bit selectors, vectorised over many blocks.

Arrays: source pixels (n, 16, 3), endpoints (n,), selectors (n, 16); a selector word has pixel 0 in its lowest bits.
"""

from __future__ import annotations

import numpy as np

FLIP = 0x55555555
LOOKBACK, ERROR_LIMIT = 127, 35
NO_WORD = np.iinfo(np.int64).max
#: A selector's place between the endpoints.
ORDER = np.array([0, 3, 1, 2])
E5 = np.array([(i << 3) | (i >> 2) for i in range(32)])
E6 = np.array([(i << 2) | (i >> 4) for i in range(64)])


def _level(x: np.ndarray, top: int) -> np.ndarray:
    t = x * top + 128
    return (t + (t >> 8)) >> 8


def to565(rgb: np.ndarray) -> np.ndarray:
    """Rounded to the nearest levels."""
    return (_level(rgb[..., 0], 31) << 11) + (_level(rgb[..., 1], 63) << 5) + _level(rgb[..., 2], 31)


def truncate565(rgb: np.ndarray) -> np.ndarray:
    return ((rgb[..., 0] & 0xF8) << 8) | ((rgb[..., 1] & 0xFC) << 3) | (rgb[..., 2] >> 3)


def from565(word: np.ndarray) -> np.ndarray:
    return np.stack([E5[word >> 11], E6[(word >> 5) & 63], E5[word & 31]], axis=-1)


def word_of(selectors: np.ndarray) -> np.ndarray:
    return (selectors.astype(np.int64) << (2 * np.arange(16))).sum(axis=-1)


def selectors_of(word: np.ndarray) -> np.ndarray:
    return (np.asarray(word, dtype=np.int64)[..., None] >> (2 * np.arange(16))) & 3


def palette(ep1: np.ndarray, ep2: np.ndarray) -> np.ndarray:
    """(n, 4, 3): four colours if ep1 > ep2, else three and black."""
    a, b = from565(ep1), from565(ep2)
    four = (ep1 > ep2)[:, None]
    third = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    return np.stack([a, b, third, np.where(four, (a + 2 * b) // 3, 0)], axis=1)


def decode(ep1: np.ndarray, ep2: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(n, 16, 3) pixels."""
    return np.take_along_axis(palette(ep1, ep2), selectors_of(word)[..., None], axis=1)


def block_error(source: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Mean squared difference of the 48 bytes, an integer."""
    return ((source - pixels) ** 2).sum(axis=(-1, -2)) // 48


def _single_colour(expand: np.ndarray) -> np.ndarray:
    """(256, 2): the levels whose two-thirds mix shows each byte best; of equal ones the first by lower, then upper."""
    n = len(expand)
    low, high = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    mixed = (2 * expand[high] + expand[low]) // 3
    cost = np.abs(mixed[None, :] - np.arange(256)[:, None]) + np.abs(expand[high] - expand[low])[None, :] * 3 // 100
    best = cost.argmin(axis=1)
    return np.stack([high[best], low[best]], axis=1)


ONE5, ONE6 = _single_colour(E5), _single_colour(E6)


def _one_colour(rgb: np.ndarray) -> list[np.ndarray]:
    return [(ONE5[rgb[:, 0], k] << 11) | (ONE6[rgb[:, 1], k] << 5) | ONE5[rgb[:, 2], k] for k in (0, 1)]


def _extremes(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """565 colours of the pixels that lie furthest out along the principal axis."""
    f32 = np.float32
    centred = px - ((px.sum(axis=1) + 8) >> 4)[:, None, :]
    cov = (np.einsum("nij,nik->njk", centred, centred).astype(f32) / f32(255)).astype(f32)
    v = (px.max(axis=1) - px.min(axis=1)).astype(f32)
    for _ in range(4):
        v = (v[:, 0:1] * cov[:, 0] + v[:, 1:2] * cov[:, 1]) + v[:, 2:3] * cov[:, 2]
    size = np.abs(v).max(axis=1).astype(np.float64)
    scale = 512.0 / np.where(size < 4, 1, size)
    axis = np.where((size < 4)[:, None], np.array([299, 587, 114]), np.trunc(v.astype(np.float64) * scale[:, None]).astype(np.int64))
    along = (px * axis[:, None, :]).sum(axis=2)
    rows = np.arange(len(px))
    return to565(px[rows, along.argmax(axis=1)]), to565(px[rows, along.argmin(axis=1)])


def _match(px: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Selectors by three thresholds along the line between the endpoints."""
    a, b = from565(high), from565(low)
    colours = np.stack([a, b, (2 * a + b) // 3, (2 * b + a) // 3], axis=1)
    line = a - b
    at = (px * line[:, None, :]).sum(axis=2)
    stop = (colours * line[:, None, :]).sum(axis=2)
    outer, middle, inner = (stop[:, 1] + stop[:, 3]) >> 1, (stop[:, 3] + stop[:, 2]) >> 1, (stop[:, 2] + stop[:, 0]) >> 1
    return np.where(at < middle[:, None], np.where(at < outer[:, None], 1, 3), np.where(at < inner[:, None], 2, 0))


def _refine(px: np.ndarray, sel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Endpoints by least squares for the selectors; of one selector only, by the mean colour."""
    f32 = np.float32
    w = np.array([3, 0, 2, 1])[sel]
    xx, yy, xy = (w * w).sum(axis=1), ((3 - w) ** 2).sum(axis=1), (w * (3 - w)).sum(axis=1)
    first = (w[:, :, None] * px).sum(axis=1)
    second = 3 * px.sum(axis=1) - first
    same = (sel == sel[:, :1]).all(axis=1)
    det = np.where(same, 1, xx * yy - xy * xy).astype(f32)
    rb = f32(3) * f32(31) / f32(255) / det
    scale = np.stack([rb, rb * f32(63) / f32(31), rb], axis=1)
    top = np.array([31, 63, 31])

    def solved(a: np.ndarray) -> np.ndarray:
        x = np.clip(np.trunc(a.astype(f32) * scale + f32(0.5)).astype(np.int64), 0, top)
        return (x[:, 0] << 11) | (x[:, 1] << 5) | x[:, 2]

    high = solved(first * yy[:, None] - second * xy[:, None])
    low = solved(second * xx[:, None] - first * xy[:, None])
    flat_high, flat_low = _one_colour((px.sum(axis=1) + 8) >> 4)
    return np.where(same, flat_high, high), np.where(same, flat_low, low)


def compress(px: np.ndarray, refinements: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ep1, ep2 and selector word of each block."""
    px = np.asarray(px, dtype=np.int64)
    n = len(px)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    high, low = _extremes(px)
    sel = np.where((high != low)[:, None], _match(px, high, low), 0)
    active = np.ones(n, bool)
    for _ in range(refinements):
        new_high, new_low = _refine(px, sel)
        changed = active & ((new_high != high) | (new_low != low))
        high, low = np.where(active, new_high, high), np.where(active, new_low, low)
        flat = changed & (high == low)
        again = changed & ~flat
        before = sel
        sel = np.where(again[:, None], _match(px, high, low), np.where(flat[:, None], 0, sel))
        active &= ~flat & (sel != before).any(axis=1)
    constant = (px == px[:, :1]).all(axis=(1, 2))
    one = _one_colour(px[:, 0])
    high, low = np.where(constant, one[0], high), np.where(constant, one[1], low)
    word = np.where(constant, 0xAAAAAAAA, word_of(sel))
    swap = high < low
    return np.where(swap, low, high), np.where(swap, high, low), np.where(swap, word ^ FLIP, word)


def _snap(x: np.ndarray, bits: int) -> np.ndarray:
    step = 1 << (7 - bits)
    base = x & (256 - (1 << (8 - bits)))
    low, high = np.where(base == 0, base, base - step), base + step
    base, low, high = (c | (c >> bits) for c in (base, low, high))
    d, below, above = np.abs(x - base), np.abs(x - low), np.abs(x - high)
    return np.where(d <= above, np.where(d < below, base, low), high)


def refit(px: np.ndarray, sel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit endpoints (k, 3) by least squares of px, (16, 3) or (k, 16, 3), for each of k selector sets; which are solvable."""
    f32 = np.float32
    order = ORDER[sel].astype(f32)
    a, b = (f32(3) - order) / f32(3), order / f32(3)
    one = lambda x: np.cumsum(x, axis=1, dtype=f32)[:, -1]  # noqa: E731  added up in order, in single precision
    sums = [one(a * a), one(b * b), one(a * b)]
    ax, bx = (one(px.astype(f32) * w[:, :, None]) for w in (a, b))
    aa, bb, ab = (s[:, None] for s in sums)
    det = aa * bb - ab * ab
    good = (sel != sel[:, :1]).any(axis=1)
    f = f32(1) / np.where(good[:, None], det, f32(1))
    ends = []
    for p in (f * (ax * bb - bx * ab), f * (bx * aa - ax * ab)):
        x = np.clip(np.trunc(p + f32(0.5)).astype(np.int64), 0, 255)
        ends.append(np.stack([_snap(x[:, 0], 5), _snap(x[:, 1], 6), _snap(x[:, 2], 5)], axis=1))
    return ends[0], ends[1], good


def dictionary_pass(px: np.ndarray, ep1: np.ndarray, ep2: np.ndarray, word: np.ndarray, limit: int = ERROR_LIMIT, lookback: int = LOOKBACK):
    """Selector words replaced by earlier ones where that costs little, in raster order.

    Returns 565 endpoints, the palette of words in first-use order, and each block's palette number. The newest
    `lookback` words are tried, newest first, up to one that costs nothing; what an image's blocks have added is
    state, so an image is one fold, and images are independent.
    """
    ep1, ep2 = np.array(ep1, dtype=np.int64), np.array(ep2, dtype=np.int64)
    known: list[int] = []
    known_sel = np.zeros((0, 16), np.int64)
    number = np.zeros(len(px), np.int64)
    plain = block_error(px, decode(ep1, ep2, word))
    for i in range(len(px)):
        take = min(lookback, len(known))
        chosen = -1
        if take:
            sel = known_sel[len(known) - take : len(known)][::-1]
            a, b, good = refit(px[i], sel)
            good = good & (truncate565(a) > truncate565(b))
            colours = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], axis=1)
            cost = block_error(px[i][None], np.take_along_axis(colours, sel[..., None], axis=1)) - plain[i]
            cost = np.where(good, cost, np.iinfo(np.int64).max)
            free = np.flatnonzero(cost <= 0)
            best = int(free[0]) if len(free) else int(cost.argmin())
            if cost[best] < limit:
                chosen = len(known) - 1 - best
                ep1[i], ep2[i] = truncate565(a[best]), truncate565(b[best])
        if chosen < 0:
            chosen = len(known)
            if chosen >= len(known_sel):
                known_sel = np.concatenate([known_sel, np.zeros((max(256, len(known_sel)), 16), np.int64)])
            known_sel[chosen] = selectors_of(np.array(word[i]))
            known.append(int(word[i]))
        number[i] = chosen
    return ep1, ep2, np.array(known, dtype=np.int64), number


def reassign(px: np.ndarray, ep1: np.ndarray, ep2: np.ndarray, word: np.ndarray, candidates: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selector words replaced by the best of a small set of candidates where the added error stays below the limit.

    Blocks do not depend on one another: a candidate's use by other blocks does not count.
    """
    ep1, ep2, word = (np.array(x, dtype=np.int64) for x in (ep1, ep2, word))
    plain, sel = block_error(px, decode(ep1, ep2, word)), selectors_of(np.asarray(candidates))
    for i in range(len(px)):
        a, b, good = refit(px[i], sel)
        good &= truncate565(a) > truncate565(b)
        colours = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], axis=1)
        cost = np.where(good, block_error(px[i][None], np.take_along_axis(colours, sel[..., None], axis=1)) - plain[i], np.iinfo(np.int64).max)
        best = int(cost.argmin())
        if cost[best] < limit:
            ep1[i], ep2[i], word[i] = truncate565(a[best]), truncate565(b[best]), candidates[best]
    return ep1, ep2, word


def best_words(px: np.ndarray, ep1: np.ndarray, ep2: np.ndarray, word: np.ndarray, candidates: np.ndarray, uses: np.ndarray, limit: float, step: int = 64):
    """Of each block the candidate, not its own word, that adds the least error below the limit; also its added error and uses.

    Returns endpoints, words, added errors and uses; a block that none suits keeps its own at NO_WORD. Of equal errors
    the most used word wins, then the smallest. No candidate is left out but by a bound: what least squares with
    endpoints of any precision would leave, which is the block's variance less the squares of its product with the
    word's direction. The rounding of the 48 bytes between the endpoints takes off less than sqrt(48) of a residual's
    length. The bounds of some blocks and all words are one product of matrices in single precision, with a margin for
    it; the best of them gives a first limit, what is within it is refitted, `step` a block at once, best bounds first.
    """
    ep1, ep2, out = (np.array(x, dtype=np.int64) for x in (ep1, ep2, word))
    cost, used = np.full(len(px), NO_WORD), np.zeros(len(px), np.int64)
    order = np.lexsort((candidates, -uses))
    candidates, uses, sel = candidates[order], uses[order], selectors_of(candidates[order])
    solvable = (sel != sel[:, :1]).any(axis=1)
    candidates, uses, sel = candidates[solvable], uses[solvable], sel[solvable]
    if not len(candidates) or not len(px):
        return ep1, ep2, out, cost, used
    lean = ORDER[sel] / 3
    lean -= lean.mean(axis=1, keepdims=True)
    lean = np.ascontiguousarray((lean / np.sqrt((lean * lean).sum(axis=1, keepdims=True))).T, dtype=np.float32)  # (16, words)
    plain = block_error(px, decode(ep1, ep2, word))
    by_word = np.argsort(candidates)
    place = by_word[np.minimum(np.searchsorted(candidates, word, sorter=by_word), len(by_word) - 1)]
    own = np.where(candidates[place] == word, place, -1)
    centred = px - px.mean(axis=1, keepdims=True)
    spread = (centred * centred).sum(axis=(1, 2))
    bound = np.full(len(px), float(limit))

    def needed(i: np.ndarray) -> np.ndarray:
        return spread[i] * (1 - 1e-4) - (np.sqrt(48 * np.maximum(bound[i] + 1 + plain[i], 0)) + 7) ** 2 - 1

    def refitted(i: np.ndarray, j: np.ndarray) -> None:
        a, b, good = refit(px[i], sel[j])
        low, high = truncate565(a), truncate565(b)
        colours = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], axis=1)
        added = block_error(px[i], np.take_along_axis(colours, sel[j][..., None], axis=1)) - plain[i]
        fits = np.flatnonzero(good & (low > high) & (added < limit))
        fits = fits[np.lexsort((j[fits], added[fits], i[fits]))]
        fits = fits[np.diff(i[fits], prepend=-1) > 0]  # the best of each block; candidates lie in order of use
        rows, best = i[fits], j[fits]
        better = (added[fits] < cost[rows]) | ((added[fits] == cost[rows]) & (best < number[rows]))
        fits, rows, best = fits[better], rows[better], best[better]
        number[rows], cost[rows], bound[rows] = best, added[fits], added[fits]
        ep1[rows], ep2[rows], out[rows], used[rows] = low[fits], high[fits], candidates[best], uses[best]

    number = np.full(len(px), NO_WORD)
    some = max(1, (1 << 19) // len(candidates))
    for k in range(0, len(px), some):
        rows = np.arange(k, min(k + some, len(px)))
        got = centred[rows].transpose(0, 2, 1).astype(np.float32).reshape(-1, 16) @ lean
        np.multiply(got, got, out=got)
        got = got.reshape(len(rows), 3, -1)
        got = got[:, 0] + got[:, 1] + got[:, 2]
        had = np.flatnonzero(own[rows] >= 0)
        got[had, own[rows[had]]] = -np.inf
        first = got.argmax(axis=1)
        known = got[np.arange(len(rows)), first] > -np.inf
        refitted(rows[known], first[known])
        i, j = np.nonzero(got >= np.maximum(needed(rows), np.finfo(np.float32).min).astype(np.float32)[:, None])
        turn = np.lexsort((-got[i, j], i))
        i, j = i[turn], j[turn]
        turn = np.argsort(np.arange(len(i)) - np.searchsorted(i, i), kind="stable")
        i, j = i[turn], j[turn]
        while len(i):
            refitted(rows[i[: step * some]], j[: step * some])
            i, j = i[step * some :], j[step * some :]
            left = got[i, j] >= needed(rows[i])
            i, j = i[left], j[left]
    return ep1, ep2, out, cost, used
