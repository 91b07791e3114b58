"""Regions of one row of cells that arrive in any order."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

GAP = 2


def greedy(number: np.ndarray, x: np.ndarray, ch) -> list[tuple[int, int, int, str]]:
    """(x, width, region_id, text) of one row's regions: a seed sweeps the open cells again and again, growing by whatever is near.

    What a region can take next is at one of ten places around its ends; a sweep goes
    on with the first of these that comes after the last one it took, found by halving among the
    cells of that place.  Cells that arrive side by side are taken as a run: behind a
    region's right end the next to arrive is the next to be taken.
    """
    n, ch = len(x), ch if isinstance(ch, str) else list(ch)
    if not n:
        return []
    step = np.diff(x)
    if (step >= 0).all():  # in order of x: cut where a gap is too wide
        cuts = [0, *(np.flatnonzero(step - 1 > GAP) + 1).tolist(), n]
        return [(int(x[a]), int(x[b - 1]) + 1 - int(x[a]), int(number[a]), "".join(ch[a:b])) for a, b in zip(cuts, cuts[1:])]
    breaks = np.append(np.flatnonzero((step < 0) | (step > GAP + 1)) + 1, n)
    stop = breaks[np.searchsorted(breaks, np.arange(n), side="right")].tolist()  # the end of each cell's run
    order = np.argsort(x, kind="stable")
    at = x[order]
    edges = np.append(np.flatnonzero(np.diff(at, prepend=at[0] - 1)), n)
    places = {p: (a, b) for p, a, b in zip(at[edges[:-1]].tolist(), edges.tolist(), edges[1:].tolist())}
    same = np.full(n, n)  # the next cell of the same place, n if none
    same[order[:-1]] = np.where(at[1:] == at[:-1], order[1:], n)
    same, order, places_of = same.tolist(), order.tolist(), x.tolist()
    taken, out, seed = bytearray(n), [], 0

    def open_from(i: int) -> int:
        path = []
        while i < n and taken[i]:
            path.append(i)
            i = same[i]
        for p in path:
            same[p] = i
        return i

    while seed >= 0:
        start, end, letters, last, grew = places_of[seed], places_of[seed] + 1, [], seed, False
        taken[seed] = 1
        letters += ch[seed : seed + 1]
        while True:
            if last >= 0 and places_of[last] + 1 == end:
                until = taken.find(1, last + 1, stop[last])
                until = stop[last] if until < 0 else until
                if until > last + 1:
                    taken[last + 1 : until] = b"\x01" * (until - last - 1)
                    letters += ch[last + 1 : until]
                    last, end, grew = until - 1, places_of[until - 1] + 1, True
            best = n
            for place in {*range(end - GAP, end + GAP + 1), *range(start - 1 - GAP, start - 1 + GAP + 1)}:
                if place in places:
                    a, b = places[place]
                    k = bisect_right(order, last, a, b)
                    if k < b:
                        best = min(best, open_from(order[k]))
            if best == n:
                if not grew:
                    break
                last, grew = -1, False
                continue
            taken[best], last, grew = 1, best, True
            start, end = min(start, places_of[best]), max(end, places_of[best] + 1)
            letters += ch[best : best + 1]
        out.append((start, end - start, int(number[seed]), "".join(letters)))
        seed = taken.find(0, seed + 1)
    return out
