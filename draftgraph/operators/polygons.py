"""Faces of a drawing's line work, minimal rectangles and hulls, for one drawing at a time."""

from __future__ import annotations

import math

import numpy as np

SNAP = 1e-6


def _split(lines: list[tuple[float, float, float, float]]) -> list[tuple[tuple, tuple]]:
    """The lines cut at all their meeting points, each piece once."""
    n = len(lines)
    a = np.array(lines, np.float64).reshape(-1, 4)
    cuts: list[list[float]] = [[0.0, 1.0] for _ in range(n)]
    low, high = np.minimum(a[:, :2], a[:, 2:]) - SNAP, np.maximum(a[:, :2], a[:, 2:]) + SNAP
    by_x = np.argsort(low[:, 0], kind="stable")
    starts = low[by_x, 0]
    for k, i in enumerate(by_x):
        last = np.searchsorted(starts, high[i, 0], side="right")
        near = by_x[k + 1 : last]
        near = near[(low[near, 1] <= high[i, 1]) & (high[near, 1] >= low[i, 1])]
        for j in near.tolist():
            _meet(a[i], a[j], cuts[i], cuts[j])
    place: dict[tuple[int, int], tuple[float, float]] = {}

    def node(x: float, y: float) -> tuple[float, float]:
        key = (round(x / SNAP), round(y / SNAP))
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                if (found := place.get((key[0] + dx, key[1] + dy))) is not None:
                    return found
        return place.setdefault(key, (x, y))

    out = {}
    for i in range(n):
        x0, y0, x1, y1 = a[i].tolist()
        points = [node(x1 if t == 1.0 else x0 + t * (x1 - x0), y1 if t == 1.0 else y0 + t * (y1 - y0)) for t in sorted(set(cuts[i]))]
        for p, q in zip(points, points[1:]):
            if p != q:
                out[(min(p, q), max(p, q))] = None
    return list(out)


def _meet(p, q, cut_p: list[float], cut_q: list[float]) -> None:
    dx, dy, ex, ey = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    cross = dx * ey - dy * ex
    fx, fy = q[0] - p[0], q[1] - p[1]
    size = math.hypot(dx, dy) * math.hypot(ex, ey)
    if abs(cross) > 1e-12 * size:
        t, u = (fx * ey - fy * ex) / cross, (fx * dy - fy * dx) / cross
        et, eu = SNAP / max(math.hypot(dx, dy), SNAP), SNAP / max(math.hypot(ex, ey), SNAP)
        if -et <= t <= 1 + et and -eu <= u <= 1 + eu:
            cut_p.append(min(1.0, max(0.0, t)))
            cut_q.append(min(1.0, max(0.0, u)))
        return
    if size == 0 or abs(fx * dy - fy * dx) > SNAP * math.hypot(dx, dy):
        return
    for line, x, y, cut in ((p, q[0], q[1], cut_p), (p, q[2], q[3], cut_p), (q, p[0], p[1], cut_q), (q, p[2], p[3], cut_q)):
        gx, gy = line[2] - line[0], line[3] - line[1]
        t = ((x - line[0]) * gx + (y - line[1]) * gy) / (gx * gx + gy * gy)
        if 0.0 < t < 1.0:
            cut.append(t)


def ring_area(ring) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:])) / 2.0


def inside(ring, x: float, y: float) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def polygonize(lines) -> list[tuple[list[tuple[float, float]], list[list[tuple[float, float]]]]]:
    """The bounded faces of the line work: (closed outer ring, closed rings of holes); dangling lines
    bound nothing."""
    edges = _split([tuple(map(float, x)) for x in lines])
    links: dict[tuple, set[tuple]] = {}
    for p, q in edges:
        links.setdefault(p, set()).add(q)
        links.setdefault(q, set()).add(p)
    loose = [p for p, near in links.items() if len(near) == 1]
    while loose:
        p = loose.pop()
        for q in links.pop(p, ()):
            links[q].discard(p)
            if len(links[q]) == 1:
                loose.append(q)
    around = {p: sorted(near, key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0])) for p, near in links.items() if near}
    index = {p: {q: k for k, q in enumerate(near)} for p, near in around.items()}
    seen: set[tuple] = set()
    faces, outsides = [], []
    for p, near in around.items():
        for q in near:
            if (p, q) in seen:
                continue
            ring, a, b = [p], p, q
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(b)
                a, b = b, around[b][index[b][a] - 1]  # the next edge clockwise keeps the face on the left
            for loop in _loops(ring):
                area = ring_area(loop)
                (faces if area > 1e-9 else outsides).append((abs(area), loop))
    faces.sort(key=lambda f: f[0])
    holes: list[list] = [[] for _ in faces]
    for area, ring in outsides:
        if area <= 1e-9:
            continue
        x, y = ring[0]
        for k, (size, face) in enumerate(faces):
            if size > area and (x, y) not in face and inside(face, x, y):
                holes[k].append(ring[::-1])
                break
    return [(face, h) for (_, face), h in zip(faces, holes)]


def _loops(ring: list[tuple]) -> list[list[tuple]]:
    """A face's walk cut where it visits a point again."""
    out, path, at = [], [], {}
    for p in ring:
        if p in at:
            k = at[p]
            out.append([*path[k:], p])
            for gone in path[k + 1 :]:
                at.pop(gone, None)
            del path[k + 1 :]
        else:
            at[p] = len(path)
            path.append(p)
    return [x for x in out if len(x) > 3]


def hull(points) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise and not closed; fewer than three corners if all lie in line."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    return lower[:-1] + upper[:-1]


def rectangle_sides(points) -> tuple[float, float]:
    """(short, long) sides of the rectangle of least area, at any angle, around the points."""
    corners = hull(points)
    if len(corners) < 3:
        d = math.dist(corners[0], corners[-1]) if len(corners) == 2 else 0.0
        return 0.0, d
    p = np.array(corners)
    best = None
    for d in np.roll(p, -1, axis=0) - p:
        u = d / np.hypot(*d)
        along, across = p @ u, p @ np.array([-u[1], u[0]])
        w, h = np.ptp(along), np.ptp(across)
        if best is None or w * h < best[0] - 1e-12:
            best = (w * h, min(w, h), max(w, h))
    return float(best[1]), float(best[2])


def area_and_center(outer, holes) -> tuple[float, float, float]:
    """Net area and centre of mass of a ring without its holes."""
    total = cx = cy = 0.0
    for ring, sign in [(outer, 1.0), *((h, -1.0) for h in holes)]:
        x0, y0 = outer[0]
        r = [(x - x0, y - y0) for x, y in ring]
        a = ring_area(r)
        s = sign if a >= 0 else -sign
        total += s * a
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            c = ax * by - bx * ay
            cx += s * (ax + bx) * c
            cy += s * (ay + by) * c
    return total, outer[0][0] + cx / (6 * total), outer[0][1] + cy / (6 * total)
