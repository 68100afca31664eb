"""Points within regions, and points near other points, anywhere on the globe.

Places are unit vectors, region edges are great circles, so poles and the
180th meridian need no care.  Polygons are triangulated by ear clipping.  The
triangles go to the cells of a grid whose levels fit their sizes, points to the
cells that hold them; a bounding-volume hierarchy over a task's triangles finds
the candidates, which are tested exactly.  A point on a boundary that several
triangles of a region share is assigned to the region once.

For points near others each point's region is the hexagon around its circle,
and an exact distance test follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
#: Grid levels: cells of level n are 2 / 2**n wide.
MAX_LEVEL = 19
#: Triangles and points of one cell that meet in one block; a cell with more is cut into blocks.
BLOCK = 4_096
#: Rows that a task holds at once, in whole blocks.
ROWS_HELD = 50_000
LEAF = 4
#: Candidate pairs that are held at once.
PAIRS_HELD = 1_000_000
#: Corners up to which polygons of one size are clipped together; larger ones are clipped one by one.
CORNERS_TOGETHER = 16
#: Slack of the exact test, far below a millimetre.
EDGE_SLACK = 1e-13


def has_place(lat: Column, lon: Column) -> Column:
    """Whether the coordinates are in range and not both zero; null and NaN are no place."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points on the unit sphere, shape (n, 3), of degrees."""
    phi, lam = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=-1)


def distance(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres along the great circle."""
    phi1, phi2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((phi2 - phi1) / 2) ** 2 + np.cos(phi1) * np.cos(phi2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1, a)))


def _tangents(centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors across each centre, at right angles."""
    helper = np.where((np.abs(centre[:, 2:]) < 0.9), [[0.0, 0, 1]], [[1.0, 0, 0]])
    east = np.cross(helper, centre)
    east /= np.linalg.norm(east, axis=1, keepdims=True)
    return east, np.cross(centre, east)


def hexagons(centre: np.ndarray, metres: float) -> np.ndarray:
    """Corners (n, 6, 3) of hexagons that hold the circles around ``centre``."""
    east, north = _tangents(centre)
    reach = np.tan(metres / EARTH_RADIUS) / np.cos(np.pi / 6) * (1 + 1e-6)
    turn = np.arange(6) * np.pi / 3
    corner = centre[:, None] + reach * (np.cos(turn)[:, None] * east[:, None] + np.sin(turn)[:, None] * north[:, None])
    return corner / np.linalg.norm(corner, axis=2, keepdims=True)


def ear_clip(corners: np.ndarray) -> np.ndarray:
    """Triangles (n, k - 2, 3) as corner numbers of n simple polygons (n, k, 3) of k corners.

    Each polygon must lie within a half sphere.  In the plane that touches the
    sphere at its middle its edges are straight; there, ear by ear is cut, of
    small polygons all at once.  Of a polygon that crosses itself some triangles
    are arbitrary.
    """
    n, k, _ = corners.shape
    x, y = _in_plane(corners)
    if k > CORNERS_TOGETHER:
        return np.stack([clip_one(x[i], y[i], list(range(k))) for i in range(n)])
    area = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(axis=1)
    order = np.where((area < 0)[:, None], np.arange(k)[::-1], np.arange(k))  # counter-clockwise
    out = np.empty((n, k - 2, 3), np.int64)
    each = np.arange(n)
    for step in range(k - 3):
        left = k - step
        px, py = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
        ax, ay, cx, cy = np.roll(px, 1, 1), np.roll(py, 1, 1), np.roll(px, -1, 1), np.roll(py, -1, 1)
        side = _side
        turn = side(ax, ay, px, py, cx, cy)
        # is another corner in the triangle of (before, corner, after)?
        qx, qy = px[:, None, :], py[:, None, :]
        wrap = lambda v: v[:, :, None]
        within = (
            (side(wrap(ax), wrap(ay), wrap(px), wrap(py), qx, qy) >= 0)
            & (side(wrap(px), wrap(py), wrap(cx), wrap(cy), qx, qy) >= 0)
            & (side(wrap(cx), wrap(cy), wrap(ax), wrap(ay), qx, qy) >= 0)
        )
        i = np.arange(left)
        own = np.zeros((left, left), bool)
        own[i, i] = own[i, (i - 1) % left] = own[i, (i + 1) % left] = True
        same = (qx == wrap(ax)) & (qy == wrap(ay)) | (qx == wrap(px)) & (qy == wrap(py)) | (qx == wrap(cx)) & (qy == wrap(cy))
        free = ~(within & ~own & ~same).any(axis=2)
        score = np.where(free & (turn > 0), 2, np.where(free & (turn == 0), 1, 0))
        ear = score.argmax(axis=1)
        out[:, step] = np.stack([order[each, (ear - 1) % left], order[each, ear], order[each, (ear + 1) % left]], axis=1)
        order = order[np.arange(left) != ear[:, None]].reshape(n, left - 1)
    out[:, k - 3] = order
    return out


def _in_plane(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of n polygons (n, k, 3) in the planes that touch the sphere at their middles."""
    middle = corners.mean(axis=1)
    middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-300)
    east, north = _tangents(middle)
    depth = np.maximum(np.einsum("nkj,nj->nk", corners, middle), 1e-9)
    return np.einsum("nkj,nj->nk", corners, east) / depth, np.einsum("nkj,nj->nk", corners, north) / depth


def _side(x1, y1, x2, y2, x3, y3):
    """Above 0 where the third point is to the left of the way from the first to the second."""
    return (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)


def clip_one(x: np.ndarray, y: np.ndarray, ring: list[int]) -> np.ndarray:
    """Triangles (corner numbers) of one polygon in the plane, whose corners ``ring`` lists in order.

    Corners may be listed twice, as where a hole is bridged.  Ears are sought
    around a linked list; only corners where the polygon turns inwards can be in
    an ear, so a corner costs one pass over those.
    """
    ring = np.asarray(ring)
    if (x[ring] * y[np.roll(ring, -1)] - x[np.roll(ring, -1)] * y[ring]).sum() < 0:
        ring = ring[::-1]
    n = len(ring)
    px, py = x[ring], y[ring]
    before, after = np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)
    inward = _side(px[before], py[before], px, py, px[after], py[after]) <= 0
    live = np.ones(n, bool)
    triangles, at, missed, left = [], 0, 0, n
    while left > 3:
        a, c = before[at], after[at]
        turn = _side(px[a], py[a], px[at], py[at], px[c], py[c])
        # corners in line are cut when a round finds no ear, and of a polygon that crosses itself any corner when two do
        ear = turn > 0 or (turn == 0 and missed > left) or missed > 2 * left
        if ear and missed <= 2 * left:
            q = np.flatnonzero(inward & live)
            q = q[(ring[q] != ring[a]) & (ring[q] != ring[at]) & (ring[q] != ring[c])]
            q = q[~(((px[q] == px[a]) & (py[q] == py[a])) | ((px[q] == px[at]) & (py[q] == py[at])) | ((px[q] == px[c]) & (py[q] == py[c])))]
            within = (_side(px[a], py[a], px[at], py[at], px[q], py[q]) >= 0) & (_side(px[at], py[at], px[c], py[c], px[q], py[q]) >= 0) & (_side(px[c], py[c], px[a], py[a], px[q], py[q]) >= 0)
            ear = not within.any()
        if not ear:
            at, missed = c, missed + 1
            continue
        triangles.append((ring[a], ring[at], ring[c]))
        live[at] = False
        after[a], before[c] = c, a
        for near in (a, c):
            inward[near] = _side(px[before[near]], py[before[near]], px[near], py[near], px[after[near]], py[after[near]]) <= 0
        at, missed, left = c, 0, left - 1
    a = int(np.flatnonzero(live)[0])
    triangles.append((ring[a], ring[after[a]], ring[after[after[a]]]))
    return np.array(triangles, np.int64)


def bridged(x: np.ndarray, y: np.ndarray, rings: list[list[int]]) -> list[int]:
    """One ring of a polygon's outer ring and its holes, each joined by a bridge from its rightmost corner.

    The bridge goes to the nearest edge that is met to the right, and to the
    corner in sight of it; holes further to the right are joined first.
    """
    area = lambda r: (x[r] * y[np.roll(r, -1)] - x[np.roll(r, -1)] * y[r]).sum()
    outer = np.array(rings[0] if area(np.array(rings[0])) > 0 else rings[0][::-1])
    holes = [np.array(r if area(np.array(r)) < 0 else r[::-1]) for r in rings[1:]]
    for hole in sorted(holes, key=lambda r: -x[r].max()):
        start = int(x[hole].argmax())
        hx, hy = x[hole[start]], y[hole[start]]
        ax, ay, bx, by = x[outer], y[outer], x[np.roll(outer, -1)], y[np.roll(outer, -1)]
        crosses = (np.minimum(ay, by) <= hy) & (np.maximum(ay, by) >= hy) & (ay != by)
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.where(crosses, ax + (hy - ay) / np.where(ay == by, 1, by - ay) * (bx - ax), np.inf)
        meets[meets < hx] = np.inf
        edge = int(meets.argmin())
        if not np.isfinite(meets[edge]):
            continue  # the hole lies outside
        ends = (edge, (edge + 1) % len(outer))
        best = max(ends, key=lambda i: x[outer[i]])
        # a corner within the triangle of the hole's corner, the meeting point and that end hides it
        qx, qy, mx = x[outer], y[outer], meets[edge]
        tri = [(hx, hy), (mx, hy), (x[outer[best]], y[outer[best]])]
        sign = 1 if _side(*tri[0], *tri[1], *tri[2]) >= 0 else -1
        within = np.ones(len(outer), bool)
        for (x1, y1), (x2, y2) in zip(tri, [*tri[1:], tri[0]], strict=True):
            within &= sign * _side(x1, y1, x2, y2, qx, qy) >= 0
        within &= ~((qx == tri[2][0]) & (qy == tri[2][1]))
        if within.any():
            hidden = np.flatnonzero(within)
            slope = np.abs(qy[hidden] - hy) / np.maximum(qx[hidden] - hx, 1e-300)
            best = int(hidden[np.lexsort((qx[hidden], slope))[0]])
        turned = np.r_[hole[start:], hole[: start + 1]]
        outer = np.r_[outer[: best + 1], turned, outer[best:]]
    return outer.tolist()


def _boxes(triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounding boxes of spherical triangles (n, 3, 3): low and high corners."""
    edge = np.linalg.norm(triangles - np.roll(triangles, 1, axis=1), axis=2).max(axis=1)
    bulge = (edge**2 / 2 + 1e-12)[:, None]  # the sphere rises less than this above the flat triangle
    return triangles.min(axis=1) - bulge, triangles.max(axis=1) + bulge


def _cell_codes(level: np.ndarray, index: np.ndarray) -> np.ndarray:
    return (level.astype(np.int64) << 57) | (index[:, 0] << 38) | (index[:, 1] << 19) | index[:, 2]


def _cell_index(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    side = (1 << level.astype(np.int64))[:, None]
    return np.clip(np.floor((x + 1) / 2 * side).astype(np.int64), 0, np.minimum(side - 1, (1 << MAX_LEVEL) - 1))


def triangle_cells(triangles: np.ndarray, per_region: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cell codes: each triangle in the cells that its box meets.

    The level is the finest whose cells are four times the size of the largest
    box of the region, of ``per_region`` triangles in a row.  With one level for
    all of its triangles a point meets a region in one cell only.
    """
    low, high = _boxes(triangles)
    size = np.maximum((high - low).max(axis=1), 1e-12)
    size = np.repeat(size.reshape(-1, per_region).max(axis=1), per_region)
    level = np.clip(np.floor(np.log2(2 / size)).astype(np.int64) - 2, 0, MAX_LEVEL)
    first, last = _cell_index(low, level), _cell_index(high, level)
    rows, codes = [], []
    span = (last - first + 1).max(axis=0) if len(first) else (0, 0, 0)
    for dx in range(span[0]):
        for dy in range(span[1]):
            for dz in range(span[2]):
                index = first + (dx, dy, dz)
                row = np.flatnonzero((index <= last).all(axis=1))
                # a cell that the sphere doesn't pass through holds no point
                width = (2.0 / (1 << level[row]))[:, None]
                a = index[row] * width - 1
                b = a + width
                nearest = np.where((a <= 0) & (b >= 0), 0, np.minimum(abs(a), abs(b)))
                on = (np.linalg.norm(nearest, axis=1) <= 1 + 1e-9) & (np.linalg.norm(np.maximum(abs(a), abs(b)), axis=1) >= 1 - 1e-9)
                rows.append(row[on])
                codes.append(_cell_codes(level[row][on], index[row][on]))
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Hierarchy:
    """A bounding-volume hierarchy over the boxes of triangles.

    The triangles are ordered along a space-filling curve and taken as the
    leaves of a binary tree; all points of a query descend together, a level at
    a time.
    """

    def __init__(self, triangles: np.ndarray) -> None:
        low, high = _boxes(triangles)
        grid = np.clip(((low + high) / 2 + 1) / 2 * (1 << 20), 0, (1 << 20) - 1).astype(np.uint64)
        code = np.zeros(len(grid), np.uint64)
        for axis in range(3):
            v = grid[:, axis]
            for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
                v = (v | (v << np.uint64(shift))) & np.uint64(mask)
            code |= v << np.uint64(axis)
        self.order = np.argsort(code, kind="stable")
        leaves = 1 << max(0, int(np.ceil(np.log2(max(1, -(-len(self.order) // LEAF))))))
        lows, highs = np.full((leaves * LEAF, 3), np.inf), np.full((leaves * LEAF, 3), -np.inf)
        lows[: len(self.order)], highs[: len(self.order)] = low[self.order], high[self.order]
        self.tree = [(lows, highs)]
        width = LEAF
        while len(self.tree[-1][0]) > 1:
            self.tree.append((self.tree[-1][0].reshape(-1, width, 3).min(axis=1), self.tree[-1][1].reshape(-1, width, 3).max(axis=1)))
            width = 2

    def _descend(self, points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for depth in range(len(self.tree) - 1, -1, -1):
            lows, highs = self.tree[depth]
            fits = ((points[who] >= lows[node]) & (points[who] <= highs[node])).all(axis=1)
            who, node = who[fits], node[fits]
            if len(who) > most and len(points) > 1:
                return None
            if depth:
                children = LEAF if depth == 1 else 2
                who = np.repeat(who, children)
                node = (node[:, None] * children + np.arange(children)).ravel()
        return who, self.order[node]

    def candidates(self, points: np.ndarray, most: int = PAIRS_HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (point, triangle) where the point is in the triangle's box, of some points after others.

        Where points have more than ``most`` pairs on any level they are halved,
        so that what is held doesn't grow with how crowded a place is.
        """
        todo = [(0, len(points))] if len(points) else []
        while todo:
            first, after = todo.pop()
            found = self._descend(points[first:after], most)
            if found is None:
                middle = (first + after) // 2
                todo += [(middle, after), (first, middle)]
            else:
                yield found[0] + first, found[1]


def candidates(points: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All candidates of the hierarchy at once."""
    none = np.zeros(0, np.int64)
    if not len(points) or not len(triangles):
        return none, none
    parts = list(Hierarchy(triangles).candidates(points))
    return np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts])


def contains(triangles: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact test, row by row; the boundary counts as inside."""
    a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]
    det = lambda u, v: np.einsum("nj,nj->n", np.cross(u, v), points)
    one, two, three = det(a, b), det(b, c), det(c, a)
    ccw = np.einsum("nj,nj->n", np.cross(a, b), c)
    sign = np.where(ccw < 0, -1.0, 1.0)
    return (sign * one >= -EDGE_SLACK) & (sign * two >= -EDGE_SLACK) & (sign * three >= -EDGE_SLACK) & (np.einsum("nj,nj->n", a + b + c, points) > 0)


_TRIANGLES = "region_id string, cell bigint, shape array<double>"
_MEETING = "cell bigint, point_block int, region_block int, id string, shape array<double>"


def _as_shapes(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def _from_shapes(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _corners(ring: list | None) -> list[tuple[float, float]] | None:
    """Of a ring the corners without repetitions in a row; none if one is unusable."""
    corners = [(p["lat"], p["lon"]) for p in ring or [] if p]
    if not all(a is not None and b is not None and -90 <= a <= 90 and -180 <= b <= 180 for a, b in corners):
        return None
    corners = [p for p, before in zip(corners, [None, *corners], strict=False) if p != before]
    return corners[:-1] if len(corners) > 1 and corners[0] == corners[-1] else corners


def region_triangles(regions: DataFrame) -> DataFrame:
    """Triangles by cell of ``region_id string, ring array<struct<lat, lon>>`` and, if there, ``holes``, an array of such rings.

    A ring may repeat its first corner at the end; corners in a row that are
    equal count once.  Rings of under 3 corners, null rings and rings with a
    corner out of range give nothing; such a hole is no hole.  A region of
    several parts has a row for each.
    """
    with_holes = "holes" in regions.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[tuple[str, np.ndarray]]] = {}
            for row in batch.to_pylist():
                name, corners = row["region_id"], _corners(row["ring"])
                if name is None or not corners or len(corners) < 3:
                    continue
                holes = [h for h in map(_corners, row.get("holes") or []) if h and len(h) > 2]
                if holes:
                    yield _with_holes(name, [corners, *holes])
                else:
                    by_size.setdefault(len(corners), []).append((name, unit_vectors(*np.array(corners, float).T)))
            for k, group in by_size.items():
                at_once = max(1, 1_000_000 // k**2)
                for start in range(0, len(group), at_once):
                    some = group[start : start + at_once]
                    corners = np.stack([c for _, c in some])
                    yield _placed([name for name, _ in some], corners, ear_clip(corners))

    return regions.select(F.col("region_id").cast("string"), "ring", *(["holes"] if with_holes else [])).mapInArrow(cut, _TRIANGLES)


def _with_holes(name: str, rings: list[list[tuple[float, float]]]) -> pa.RecordBatch:
    corners = unit_vectors(*np.array([p for ring in rings for p in ring], float).T)
    x, y = (v[0] for v in _in_plane(corners[None]))
    ends = np.cumsum([0, *map(len, rings)])
    ring = bridged(x, y, [list(range(a, b)) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return _placed([name], corners[None], clip_one(x, y, ring)[None])


def _placed(names: list | pa.Array, corners: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Triangles ``parts`` of equally large polygons, with the cells they go to."""
    triangles = corners[np.arange(len(corners))[:, None, None], parts].reshape(-1, 3, 3)
    rows, cells = triangle_cells(triangles, parts.shape[1])
    ids = pa.array(names, pa.string()).take(pa.array(rows // parts.shape[1]))
    return pa.RecordBatch.from_arrays([ids, pa.array(cells), _as_shapes(triangles[rows].reshape(-1, 9))], names=["region_id", "cell", "shape"])


def circle_triangles(places: DataFrame, metres: float) -> DataFrame:
    """Triangles by cell of the hexagons around ``id string, lat, lon``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 5_000):
                some = batch.slice(start, 5_000)
                centre = unit_vectors(some.column(1).to_numpy(), some.column(2).to_numpy())
                corners = hexagons(centre, metres)
                yield _placed(some.column(0), corners, ear_clip(corners))

    return places.select("id", "lat", "lon").mapInArrow(cut, _TRIANGLES)


def point_cells(places: DataFrame, levels: list[int]) -> DataFrame:
    """``id, cell, shape``: each place in its cell of each level."""
    phi, lam = F.radians("lat"), F.radians("lon")
    placed = places.select("id", F.array(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)).alias("shape"))

    def index(axis: int, level: int) -> Column:
        side = float(1 << level)
        return F.greatest(F.lit(0), F.least(F.lit(int(side) - 1), F.floor((F.col("shape")[axis] + 1) / 2 * side))).cast("bigint")

    code = lambda n: F.lit(n << 57).bitwiseOR(F.shiftleft(index(0, n), 38)).bitwiseOR(F.shiftleft(index(1, n), 19)).bitwiseOR(index(2, n))
    return placed.select("id", F.explode(F.array(*map(code, levels))).alias("cell"), "shape")


def _join_blocks(batches: Iterator[pa.RecordBatch], ascending: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs within each block, of rows sorted by block; several blocks at a time share one hierarchy.

    With ``ascending`` only pairs whose region has the lesser name count, which
    is settled before they are tested.
    """
    names = ["region_id", "id"]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        sizes = table["shape"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        is_region = sizes == 9
        flat = table["shape"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        start = np.r_[0, np.cumsum(sizes)[:-1]]
        block = np.cumsum(_changes(table))
        t, p = np.flatnonzero(is_region), np.flatnonzero(~is_region)
        if not len(t) or not len(p):
            return
        triangles = flat[start[t][:, None] + np.arange(9)].reshape(-1, 3, 3)
        points = flat[start[p][:, None] + np.arange(3)]
        ids = table["id"].combine_chunks()
        coded = ids.dictionary_encode()
        number = pc.rank(coded.dictionary, "ascending").to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        for who, which in Hierarchy(triangles).candidates(points):
            same = block[p[who]] == block[t[which]]
            if ascending:
                same &= number[t[which]] < number[p[who]]
            who, which = who[same], which[same]
            inside = contains(triangles[which], points[who])
            who, which = p[who[inside]], t[which[inside]]
            # triangles of one region share boundaries: a point counts once for the region
            _, once = np.unique(number[which] * len(number) + who, return_index=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which[once])), ids.take(pa.array(who[once]))], names=names)

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= ROWS_HELD:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(table))[-1])  # the last block may go on
            if last:
                yield from found(table.slice(0, last))
            held = table.slice(last).to_batches()
            count = table.num_rows - last
    if count:
        yield from found(pa.Table.from_batches(held))


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row begins a new block."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("cell", "point_block", "region_block"):
        values = table[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def within_regions(triangles: DataFrame, places: DataFrame, materialize: Callable[[DataFrame], DataFrame], *, ascending: bool = False) -> DataFrame:
    """``region_id, id``: the places in each region, each pair once for each part of the region.

    ``places``: ``id string, lat, lon``, distinct ids and usable places.  A
    cell with many places or triangles is cut into blocks of each, and every
    block of places meets every block of triangles, so that no task holds an
    unbounded cell; a region's triangles stay together.  ``ascending`` leaves
    only pairs with ``region_id < id``.
    """
    triangles = materialize(triangles)
    levels = sorted(r[0] for r in triangles.select(F.shiftright("cell", 57)).distinct().collect())  # at most MAX_LEVEL + 1 numbers
    if not levels:
        return triangles.select("region_id", F.col("region_id").alias("id"))  # no rows
    points = point_cells(places, levels)
    sizes = (
        points.select("cell", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(triangles.select("cell", F.lit(0).alias("p"), F.lit(1).alias("t")))
        .groupBy("cell").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
        .where((F.col("p") > BLOCK) | (F.col("t") > BLOCK))
        .select("cell", F.ceil(F.col("p") / BLOCK).cast("int").alias("point_blocks"), F.ceil(F.col("t") / BLOCK).cast("int").alias("region_blocks"))
    )
    sizes = materialize(sizes)
    blocks = lambda name: F.greatest(F.lit(1), F.coalesce(name, F.lit(1)))
    pick = lambda key, name: F.pmod(F.xxhash64(key), blocks(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), blocks(name) - 1))
    points = points.join(sizes, "cell", "left").select("cell", pick("id", "point_blocks").alias("point_block"), every("region_blocks").alias("region_block"), "id", "shape")
    areas = triangles.join(sizes, "cell", "left").select("cell", every("point_blocks").alias("point_block"), pick("region_id", "region_blocks").alias("region_block"), F.col("region_id").alias("id"), "shape")
    key = ["cell", "point_block", "region_block"]
    return points.unionByName(areas).repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: _join_blocks(batches, ascending), "region_id string, id string")


def assign_regions(regions: DataFrame, places: DataFrame, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, region_id``: the region of each place that lies in one; of several, as on a shared boundary, the least."""
    usable = places.where(has_place(F.col("lat"), F.col("lon")) & F.col("id").isNotNull()).select("id", "lat", "lon")
    return within_regions(region_triangles(regions), materialize(usable), materialize).groupBy("id").agg(F.min("region_id").alias("region_id"))


def near_pairs(places: DataFrame, metres: float, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id_1, id_2``, ``id_1 < id_2``: the pairs of places at most ``metres`` apart.

    ``places``: ``id string, lat, lon``; ids must be distinct, rows without a
    usable place or id are left out.  Places of equal coordinates are one spot:
    spots are joined, and their places paired at the end.  At most a quarter of
    the globe is a sensible distance.
    """
    places = places.where(has_place(F.col("lat"), F.col("lon")) & F.col("id").isNotNull())
    # the coordinates ride along in the spot's name, so that the distance test needs no join
    spot = F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string"))
    places = materialize(places.select("id", "lat", "lon", spot.alias("spot")))
    spots = places.groupBy("spot").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).select(F.col("spot").alias("id"), "lat", "lon")
    spots = materialize(spots)
    pairs = within_regions(circle_triangles(spots, metres), spots, materialize, ascending=True)
    radians = lambda c, k: F.radians(F.substring_index(c, " ", k).cast("double"))
    parts = pairs.select(F.col("region_id").alias("one"), F.col("id").alias("two"), *(radians(c, k).alias(n + i) for c, i in (("region_id", "1"), ("id", "2")) for n, k in (("a", 1), ("o", -1))))
    h = F.pow(F.sin((F.col("a2") - F.col("a1")) / 2), 2) + F.cos("a1") * F.cos("a2") * F.pow(F.sin((F.col("o2") - F.col("o1")) / 2), 2)
    near = parts.where(2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h))) <= metres).select("one", "two")
    of = lambda name, key: places.select(F.col("id").alias(name), F.col("spot").alias(key))
    across = near.join(of("x", "one"), "one").join(of("y", "two"), "two").select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))
    shared = places.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("spot")
    same = places.join(shared, "spot", "left_semi").select("spot", "id")
    within = same.select("spot", F.col("id").alias("id_1")).join(same.select("spot", F.col("id").alias("id_2")), "spot").where(F.col("id_1") < F.col("id_2"))
    return across.unionByName(within.select("id_1", "id_2"))
