"""Signatures of weighted sets from hierarchical Poisson processes over discretised weights."""

from __future__ import annotations

import math

import numpy as np

from .common import U, mix

_UNIT = 2.0**-64


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.float64) + 0.5) * _UNIT


def signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, m: int, seed: int = 0) -> np.ndarray:
    """A (rows, m) array of float64; rows agree in a place with the probability of their weighted Jaccard similarity.

    The weights' axis is split into [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each element has over each of these a
    Poisson process in time of a rate as its width. A point falls on one of m places and on one unit of the width, and
    counts for a set if that unit lies below the element's weight. A place keeps the time of its first point. Points
    are made in order of time, up to a time by which all places of a row are likely to have one; rows that lack some go
    further, so the bound changes the work, never the outcome. A row without elements has infinity everywhere.
    """
    sig = np.full((rows, m), np.inf)
    if not element.size:
        return sig
    total = np.bincount(row, weight, minlength=rows)
    todo = np.flatnonzero(total > 0)
    spread = m * (math.log(m) + 3)
    while todo.size:
        until = np.full(rows, -1.0)
        until[todo] = spread / total[todo]
        use = until[row] > 0
        _points(element[use], weight[use], row[use], until, sig, m, seed)
        late = sig[todo].max(axis=1) > until[todo]  # a place whose first point may lie beyond the bound
        todo, spread = todo[late], spread * 1.7
        sig[todo] = np.inf
    return sig


def _points(element, weight, row, until, sig, m, seed) -> None:
    low, width, k, flat = 0, 1, 0, sig.reshape(-1)
    while True:
        on = np.flatnonzero(weight > low)
        if not on.size:
            return
        base = mix(element[on] ^ U((seed * 0x632BE59BD9B4E019 + k * 0x9E3779B97F4A7C15) % 2**64))
        _process(base, weight[on], row[on], low, width, until, flat, m)
        low, width, k = (1, 1, 1) if k == 0 else (2 * low, 2 * width if k > 1 else 2, k + 1)


def _process(base, weight, row, low, width, until, flat, m) -> None:
    end, time, nth = until[row], np.zeros(base.size), 0
    # Most first points of a long row lie beyond its bound: one comparison of integers tells.
    first = mix(base + U(0x9E3779B97F4A7C15))
    alive = np.flatnonzero(_uniform(first) > np.exp(-end * width))
    base, weight, row, end, time = base[alive], weight[alive], row[alive], end[alive], time[alive]
    while base.size:
        block = int(np.clip(np.median((end - time) * width) + 1, 1, max(1, min(256, 400_000 // base.size))))
        count = (np.arange(nth, nth + block, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
        h = mix(base[:, None] + count[None, :])
        # From the carried time on, one by one: sums are the same to the last bit however points are dealt to blocks.
        at = np.cumsum(np.concatenate([time[:, None], -np.log(_uniform(h)) / width], axis=1), axis=1)[:, 1:]
        ok = at <= end[:, None]
        i, j = np.nonzero(ok)
        h2 = mix(h[i, j] ^ U(0xA0761D6478BD642F))
        if width > 1 or low:
            unit = low + ((h2 >> U(32)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
            keep = unit < weight[i]
            i, j, h2 = i[keep], j[keep], h2[keep]
        place = ((h2 & U(0xFFFFFFFF)) * U(m)) >> U(32)
        np.minimum.at(flat, row[i] * m + place.astype(np.int64), at[i, j])
        on = ok[:, -1]
        base, weight, row, end, time, nth = base[on], weight[on], row[on], end[on], at[on, -1], nth + block


def bands(sig: np.ndarray, per_band: int) -> np.ndarray:
    """(rows, m // per_band) 64-bit keys; a key covers the band's number and its places."""
    rows, m = sig.shape
    bits = sig[:, : m // per_band * per_band].view(np.uint64).reshape(rows, m // per_band, per_band)
    h = np.broadcast_to(mix(np.arange(bits.shape[1], dtype=np.uint64) + U(77)), bits.shape[:2]).copy()
    for k in range(per_band):
        h = mix((h * U(0x9E3779B97F4A7C15)) ^ bits[:, :, k])
    return h.view(np.int64)
