"""Plane geometry as column expressions; coordinates are in points, angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lightness(rgb) -> Column:
    """Perceived lightness, 0 black to 1 white; a null colour is black."""
    c = col(rgb)
    part = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(0.299 * part(0) + 0.587 * part(1) + 0.114 * part(2))


def angle(dx, dy) -> Column:
    """Direction without sense, from 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(col(dy), col(dx))), F.lit(180.0))


def angle_difference(a, b) -> Column:
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(180.0))
    return F.least(d, 180.0 - d)


def length(x0, y0, x1, y1) -> Column:
    return F.sqrt((col(x1) - col(x0)) * (col(x1) - col(x0)) + (col(y1) - col(y0)) * (col(y1) - col(y0)))


def line_distance(ax, ay, bx, by, px, py) -> Column:
    """From a point to the endless line through a and b; to a itself where they coincide."""
    n = length(ax, ay, bx, by)
    across = F.abs((col(px) - col(ax)) * (col(ay) - col(by)) + (col(py) - col(ay)) * (col(bx) - col(ax)))
    return F.when(n < 1e-9, length(ax, ay, px, py)).otherwise(across / n)


def projection(px, py, ox, oy, ux, uy) -> Column:
    """Of the vector from o to p on the direction u."""
    return (col(px) - col(ox)) * col(ux) + (col(py) - col(oy)) * col(uy)


def is_orthogonal(degrees, tolerance: float) -> Column:
    return F.least(angle_difference(degrees, 0.0), angle_difference(degrees, 90.0)) <= tolerance


def foot_parameter(px, py, ax, ay, bx, by) -> Column:
    """Where p's foot lies on a..b, 0 at a and 1 at b, not clamped; 0 where a and b coincide."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    n = dx * dx + dy * dy
    return F.when(n < 1e-18, F.lit(0.0)).otherwise(((col(px) - col(ax)) * dx + (col(py) - col(ay)) * dy) / n)


def foot_distance(px, py, ax, ay, bx, by) -> Column:
    t = foot_parameter(px, py, ax, ay, bx, by)
    return length(px, py, col(ax) + t * (col(bx) - col(ax)), col(ay) + t * (col(by) - col(ay)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """From a point to a segment; null where the segment has no length."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    n = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((col(px) - col(ax)) * dx + (col(py) - col(ay)) * dy) / n))
    return F.when(n >= 1e-9, length(px, py, col(ax) + t * dx, col(ay) + t * dy))


def on_strip(px, py, ax, ay, bx, by, tolerance: float, slack: float = 0.05) -> Column:
    """Near the segment's line and beside it, up to a fraction ``slack`` of its length past the ends."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    t = foot_parameter(px, py, ax, ay, bx, by)
    return (dx * dx + dy * dy >= 1e-9) & (t >= -slack) & (t <= 1 + slack) & (foot_distance(px, py, ax, ay, bx, by) <= tolerance)


def midpoint(a, b) -> Column:
    return (col(a) + col(b)) / 2.0


def axis(dx, dy, tolerance: float) -> Column:
    a = angle(dx, dy)
    return (
        F.when((col(dx) == 0) & (col(dy) == 0), F.lit(None).cast("string"))
        .when((a <= tolerance) | (a >= 180.0 - tolerance), F.lit("horizontal"))
        .when(F.abs(a - 90.0) <= tolerance, F.lit("vertical"))
    )


def box_distance(px, py, x0, y0, x1, y1) -> Column:
    dx = F.greatest(col(x0) - col(px), F.lit(0.0), col(px) - col(x1))
    dy = F.greatest(col(y0) - col(py), F.lit(0.0), col(py) - col(y1))
    return F.sqrt(dx * dx + dy * dy)


def junction_type(directions) -> Column:
    """By the unit vectors (array of x, y) of the walls that meet."""
    d = col(directions)
    n = F.size(d)
    straight = F.get(d, F.lit(0))["x"] * F.get(d, F.lit(1))["x"] + F.get(d, F.lit(0))["y"] * F.get(d, F.lit(1))["y"]
    return (
        F.when(n == 1, F.lit("endpoint"))
        .when((n == 2) & (straight < -0.99), F.lit("endpoint"))
        .when(n == 2, F.lit("corner"))
        .when(n == 3, F.lit("t-junction"))
        .otherwise(F.lit("x-junction"))
    )


def ring_edges(ring) -> Column:
    """An array of (x0, y0, x1, y1) from a closed ring of (x, y)."""
    r = col(ring)
    return F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(r, i + 1)["x"].alias("x1"), F.get(r, i + 1)["y"].alias("y1")))


def ring_distance(ring, px, py) -> Column:
    return F.array_min(F.transform(ring_edges(ring), lambda e: segment_distance(px, py, e["x0"], e["y0"], e["x1"], e["y1"])))


def in_ring(ring, px, py) -> Column:
    """Strictly inside: a point on the ring is outside."""
    x, y = col(px), col(py)

    def crosses(e):
        return ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.when(e["y1"] != e["y0"], e["y1"] - e["y0"]).otherwise(F.lit(1.0)) + e["x0"])

    inside = F.size(F.filter(ring_edges(ring), crosses)) % 2 == 1
    return inside & (F.coalesce(ring_distance(ring, x, y), F.lit(1.0)) > 1e-12)


def in_polygon(ring, holes, px, py) -> Column:
    """Strictly inside the outer ring and in none of the holes, whose rings are outside too."""
    inside = in_ring(ring, px, py)
    out = F.forall(col(holes), lambda h: ~in_ring(h, px, py) & (F.coalesce(ring_distance(h, px, py), F.lit(1.0)) > 1e-12))
    return inside & F.coalesce(out, F.lit(True))


def ring_area(ring) -> Column:
    """With its sign: positive if the ring runs counter-clockwise."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["x0"] * e["y1"] - e["x1"] * e["y0"])) / 2.0


def ring_centroid(ring) -> Column:
    a = ring_area(ring) * 6.0
    sx = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["x0"] + e["x1"]) * (e["x0"] * e["y1"] - e["x1"] * e["y0"]))
    sy = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["y0"] + e["y1"]) * (e["x0"] * e["y1"] - e["x1"] * e["y0"]))
    return F.struct((sx / a).alias("x"), (sy / a).alias("y"))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the closed segments a..b and c..d share a point."""
    ax, ay, bx, by, cx, cy, dx, dy = (col(v) for v in (ax, ay, bx, by, cx, cy, dx, dy))
    o1, o2 = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    o3, o4 = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    within = lambda px, py, qx, qy, rx, ry: (rx >= F.least(px, qx)) & (rx <= F.greatest(px, qx)) & (ry >= F.least(py, qy)) & (ry <= F.greatest(py, qy))
    touch = ((o1 == 0) & within(ax, ay, bx, by, cx, cy)) | ((o2 == 0) & within(ax, ay, bx, by, dx, dy)) | ((o3 == 0) & within(cx, cy, dx, dy, ax, ay)) | ((o4 == 0) & within(cx, cy, dx, dy, bx, by))
    return ((o1 != o2) & (o3 != o4)) | touch


def ring_meets(ring, ax, ay, bx, by) -> Column:
    return F.exists(ring_edges(ring), lambda e: segments_meet(ax, ay, bx, by, e["x0"], e["y0"], e["x1"], e["y1"]))


def to_pixel(x, y, media_width, media_height, page_height, rotation, scale_x, scale_y) -> Column:
    """Page coordinates (origin below left, flipped at the shown page's height, before rotation) to
    pixels (origin above left); other rotations than quarter turns give nulls."""
    x, y, w, h, r = (col(v) for v in (x, y, media_width, media_height, rotation))
    up = col(page_height) - y
    px = F.when(r == 0, x).when(r == 90, h - up).when(r == 180, w - x).when(r == 270, up)
    py = F.when(r == 0, up).when(r == 90, x).when(r == 180, h - up).when(r == 270, w - x)
    return F.struct((px * col(scale_x)).alias("x"), (py * col(scale_y)).alias("y"))


def from_pixel(px, py, media_width, media_height, page_height, rotation, scale_x, scale_y) -> Column:
    """The inverse of ``to_pixel``."""
    w, h, r = (col(v) for v in (media_width, media_height, rotation))
    u, v = col(px) / col(scale_x), col(py) / col(scale_y)
    x = F.when(r == 0, u).when(r == 90, v).when(r == 180, w - u).when(r == 270, w - v)
    up = F.when(r == 0, v).when(r == 90, h - u).when(r == 180, h - v).when(r == 270, u)
    return F.struct(x.alias("x"), (col(page_height) - up).alias("y"))
