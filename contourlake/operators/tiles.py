"""What a task does with one tile of a mask: numpy on a bounded square of pixels."""

from __future__ import annotations

import numpy as np

#: Side of a tile in pixels.
TILE = 256


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pixel of a tile the index of the first one, by rows, that it is connected to by sides."""
    spots, first, which = np.unique((y.astype(np.int64) << 32) | x, return_index=True, return_inverse=True)
    ends = []
    for step in (1, 1 << 32):
        at = np.minimum(np.searchsorted(spots, spots + step), len(spots) - 1)
        hit = spots[at] == spots + step
        ends.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    label = np.arange(len(spots))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return first[label][which]
        label = new


def chained(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, head, place, closed) of elements that each have one that follows, as far as it is in the tile.

    order sorts by id; for the elements in this order: the index of the first
    element of the chain, or of the smallest one of a ring, how many stand before
    it, and whether it is in a ring. following: ids, -1 for none.
    """
    n = len(ids)
    order = np.argsort(ids)
    own, to = ids[order], following[order]
    at = np.minimum(np.searchsorted(own, to), n - 1)
    inside = own[at] == to
    ptr = np.full(n, -1)
    ptr[at[inside]] = np.flatnonzero(inside)
    low, far, gap = np.where(ptr < 0, np.arange(n) - n, np.arange(n)), np.zeros(n, np.int64), np.ones(n, np.int64)
    while True:
        has = np.flatnonzero(ptr >= 0)
        p = ptr[has]
        less = low[p] < low[has]
        if not less.any():
            break
        far_, gap_, low_, ptr_ = np.where(less, gap[has] + far[p], far[has]), gap[has] + gap[p], np.where(less, low[p], low[has]), ptr[p]
        far[has], gap[has], low[has], ptr[has] = far_, gap_, low_, ptr_
    return order, np.where(low < 0, low + n, low), far, low >= 0


class Strand:
    """A chain of edges between two corners at which outlines touch: its first edge, how many it has, where it starts and ends, and its smallest edge but the first with its place."""

    __slots__ = ("end", "first", "low", "low_at", "n", "start")

    def __init__(self, first: int, n: int, start: int, end: int, low: int | None, low_at: int | None):
        self.first, self.n, self.start, self.end, self.low, self.low_at = first, n, start, end, low, low_at


def walked(strands: list[Strand]) -> list[tuple[int, int, int, int]]:
    """(first edge, path, base, total) for each strand: outlines through corners, where the edge that came last goes first.

    Outlines begin at the first vertex in order of edges that still has one to
    leave by. base + place, modulo total, is an edge's place in its outline; path
    is the outline's first edge. Only corners are visited, not edges.
    """
    leaving: dict[int, list[Strand]] = {}
    for s in sorted(strands, key=lambda s: s.first):
        leaving.setdefault(s.start, []).append(s)
    begins: list[tuple[int, int | None, Strand | None]] = [(own[0].first, corner, None) for corner, own in leaving.items()]
    begins += [(s.low, None, s) for s in strands if s.low is not None]
    done: set[int] = set()
    out: list[tuple[int, int, int, int]] = []

    def outline(s: Strand, place: int, path: int, stop: int | None) -> None:
        whole, seen = [(s, -place)], s.n - place
        done.add(s.first)
        at = s.end
        while at != stop:
            nxt = leaving[at].pop()
            if nxt is s:
                break
            done.add(nxt.first)
            whole.append((nxt, seen))
            seen += nxt.n
            at = nxt.end
        total = sum(x.n for x, _ in whole)
        out.extend((x.first, path, base, total) for x, base in whole)

    for _, corner, strand in sorted(begins, key=lambda b: b[0]):
        if strand is not None:
            if strand.first not in done:
                outline(strand, strand.low_at, strand.low, None)
            continue
        while leaving[corner]:
            s = leaving[corner].pop()
            outline(s, 0, s.first, corner)
    return out


def clusters(strands: list[Strand]) -> list[list[Strand]]:
    """Strands that corners connect."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for s in strands:
        root[find(s.start)] = find(s.end)
    held: dict[int, list[Strand]] = {}
    for s in strands:
        held.setdefault(find(s.start), []).append(s)
    return list(held.values())
