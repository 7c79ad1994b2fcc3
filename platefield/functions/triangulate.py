"""Delaunay triangulation of one bounded tile, used inside tasks.

Incremental insertion over a map from directed edge to the apex on its left. A
ghost vertex closes the hull. Signs are exact (floating point with an error
bound, rationals where that cannot decide), and a tie of four cocircular points
is broken by point id as if the smallest id were lifted a little: every tile
that sees the four points splits them the same way.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1
ORIENT_BOUND = 4e-16
CIRCLE_BOUND = 1.2e-15


def orient(a, b, c) -> float:
    """Positive when a, b, c turn left; the sign is exact."""
    left = (b[0] - a[0]) * (c[1] - a[1])
    right = (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) > ORIENT_BOUND * (abs(left) + abs(right)):
        return det
    ax, ay, bx, by, cx, cy = map(Fraction, (a[0], a[1], b[0], b[1], c[0], c[1]))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def _circle_det(a, b, c, d, number=float):
    ax, ay, bx, by, cx, cy, dx, dy = (number(v) for p in (a, b, c, d) for v in p[:2])
    ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = la * (bc - cb) + lb * (ca - ac) + lc * (ab - ba)
    size = la * (abs(bc) + abs(cb)) + lb * (abs(ca) + abs(ac)) + lc * (abs(ab) + abs(ba))
    return det, size


def in_circle(a, b, c, d) -> bool:
    """Is d inside the circle of the left-turning a, b, c? Points are (x, y, id)."""
    det, size = _circle_det(a, b, c, d)
    if abs(det) > CIRCLE_BOUND * size:
        return det > 0
    det, _ = _circle_det(a, b, c, d, Fraction)
    if det != 0:
        return det > 0
    lifted = min((a, b, c, d), key=lambda p: p[2])
    if lifted is a:
        return orient(b, c, d) > 0
    if lifted is b:
        return orient(a, c, d) < 0
    if lifted is c:
        return orient(a, b, d) > 0
    return False


def _insertion_order(xy: np.ndarray) -> np.ndarray:
    """Rounds of doubling size, each walked along a Z curve."""
    n = len(xy)
    low = xy.min(axis=0)
    span = max(float((xy.max(axis=0) - low).max()), 1e-300)
    cell = np.minimum((xy - low) / span * 1024, 1023).astype(np.int64)
    code = np.zeros(n, dtype=np.int64)
    for bit in range(10):
        code |= ((cell[:, 0] >> bit) & 1) << (2 * bit) | ((cell[:, 1] >> bit) & 1) << (2 * bit + 1)
    rank = np.random.default_rng(n).permutation(n) + 1
    return np.lexsort((code, np.floor(np.log2(rank))))


def triangulate(ids: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int]]:
    """Left-turning index triples; empty when all points are collinear.

    The points must be distinct.
    """
    n = len(ids)
    if n < 3:
        return []
    points = list(zip(xs.tolist(), ys.tolist(), ids.tolist()))
    order = _insertion_order(np.column_stack([xs, ys])).tolist()
    i, j = order[0], order[1]
    third = next((k for k in order[2:] if orient(points[i], points[j], points[k]) != 0), None)
    if third is None:
        return []
    if orient(points[i], points[j], points[third]) < 0:
        i, j = j, i
    apex: dict[tuple[int, int], int] = {}

    def add(a, b, c):
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    for a, b, c in ((i, j, third), (j, i, GHOST), (third, j, GHOST), (i, third, GHOST)):
        add(a, b, c)

    def conflict(a, b, c, d) -> bool:
        if GHOST not in (a, b, c):
            return in_circle(points[a], points[b], points[c], points[d])
        while c != GHOST:
            a, b, c = b, c, a
        p, q, r = points[a], points[b], points[d]
        side = orient(p, q, r)
        if side == 0:  # on the hull line: only strictly between the two ends
            return min(p[:2], q[:2]) < r[:2] < max(p[:2], q[:2])
        return side > 0

    edge = (i, j)
    placed = {i, j, third}
    for k in order:
        if k in placed:
            continue
        # Walk towards the point, turning over each edge that has it on the far side.
        a, b = edge
        if GHOST in (a, b, apex[a, b]):
            while apex[a, b] != GHOST:
                a, b = b, apex[a, b]
            a, b = b, a
        c = apex[a, b]
        while c != GHOST:
            if orient(points[a], points[b], points[k]) < 0:
                a, b = b, a
            elif orient(points[b], points[c], points[k]) < 0:
                a, b = c, b
            elif orient(points[c], points[a], points[k]) < 0:
                a, b = a, c
            else:
                break
            c = apex[a, b]
        # Remove every triangle whose circle holds the point; keep the rim.
        rim, todo, seen = [], [(a, b, c)], set()
        while todo:
            a, b, c = todo.pop()
            if (a, b) in seen:
                continue
            seen.update(((a, b), (b, c), (c, a)))
            for p, q in ((a, b), (b, c), (c, a)):
                if (q, p) in seen:
                    continue
                r = apex[q, p]
                if conflict(q, p, r, k):
                    todo.append((q, p, r))
                else:
                    rim.append((p, q))
        for pq in seen:
            del apex[pq]
        for p, q in rim:
            add(p, q, k)
        edge = next((p, q) for p, q in rim if GHOST not in (p, q))
    return [(a, b, c) for (a, b), c in apex.items() if a < b and a < c and c != GHOST and a != GHOST]
