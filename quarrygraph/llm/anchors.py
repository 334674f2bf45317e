"""Anchors of fixed-size windows: a content-defined way to name where equal windows may be.

Each window of SIZE bytes within a row has an anchor: the place of its least K-gram, the first of equals.
Equal windows have their anchors at the same offset and with the same K-gram, so they can only be found
among windows whose anchors have the same K-gram hash. Consecutive windows that share an anchor are
a run; its segment is the bytes that they cover.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import Hasher

SIZE, K = 400, 96
_POSITION_BITS = 30


class Runs(NamedTuple):
    start: np.ndarray  # the first window of each run
    count: np.ndarray  # its number of windows
    anchor: np.ndarray  # how far behind the first window's start the anchor is
    gram: np.ndarray  # hash of the anchor's K-gram
    segment: np.ndarray  # hash of the segment's bytes


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of the given width, by block-wise running minima."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, off: np.ndarray, size: int = SIZE, k: int = K) -> Runs:
    """Runs of all windows that lie within a row."""
    none = np.empty(0, np.int64)
    n = len(data) - k + 1
    if len(data) < size:
        return Runs(none, none, none, none.view(np.uint64), none.view(np.uint64))
    hasher = Hasher(data)
    place = np.arange(n)
    gram = hasher(place, place + k)
    width = size - k + 1
    low = np.uint64((1 << _POSITION_BITS) - 1)
    anchor = (sliding_least((gram & ~low) | place.astype(np.uint64), width) & low).astype(np.int64)
    whole = np.zeros(len(anchor) + 1, np.int8)  # windows that lie within a row
    long = np.flatnonzero(np.diff(off) >= size)
    np.add.at(whole, off[long], 1)
    np.add.at(whole, off[long + 1] - size + 1, -1)
    inside = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = off[long]
    new[first] = True  # a row's first window begins a run
    start = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    count = np.flatnonzero(last) - start + 1
    return Runs(start, count, anchor[start] - start, gram[anchor[start]], hasher(start, start + count + size - 1))
