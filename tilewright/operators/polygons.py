"""Components to polygons.

The border of a component is a closed walk along the free sides of its cells. Where the walk goes after a side depends
on two more cells only, so the sides are linked inside bands of grid rows, each with one row of its neighbours as a
halo. What lies in one band is a chain: its cells in walking order, and its share of area and length. Chains of
different bands are put in order by ranking the list that their ends form (``pointers.chain_ranks``), never by walking a
component in one task. The outline itself, at last, is one row.

The walk runs through cell centres, as contour tracers do, so a polygon's area is smaller than its component's cell
count. Vertices and the start of the ring may differ from other tracers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilewright.operators.components import BAND, _merge_edges, _numbered, cell_runs, touching, whole_groups
from tilewright.operators.pointers import chain_ranks
from tilewright.operators.raster import spans
from tilewright.session import pin

#: Sides in clockwise order (top, right, bottom, left): the cell beyond a side, and the way along it, as (dy, dx).
BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))
ALONG = ((0, 1), (1, 0), (0, -1), (-1, 0))
POINT = "struct<x:double,y:double>"
MASK_CELLS = 1_000_000  # cells of masks that are outlined at once


def next_sides(code: np.ndarray, width: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Free sides of the ``own`` cells (cell, side), and the side that follows each (cell, side).

    ``code`` numbers the cells in row order, ``width`` apart from row to row. At a corner where two cells meet
    diagonally the walk crosses over to the other one, so that eight-neighbours belong together.
    """
    def found(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return np.where(code[at] == wanted, at, -1)

    cells, sides = [], []
    for side, (dy, dx) in enumerate(BEYOND):
        free = own[found(code[own] + dy * width + dx) < 0]
        cells.append(free)
        sides.append(np.full(len(free), side))
    cell, side = np.concatenate(cells), np.concatenate(sides)
    order = np.lexsort((side, cell))
    cell, side = cell[order], side[order]
    along = np.array([dy * width + dx for dy, dx in ALONG])[side]
    beyond = np.array([dy * width + dx for dy, dx in BEYOND])[side]
    across, ahead = found(code[cell] + along + beyond), found(code[cell] + along)
    to_cell = np.where(across >= 0, across, np.where(ahead >= 0, ahead, cell))
    to_side = np.where(across >= 0, side + 3, np.where(ahead >= 0, side, side + 1)) % 4
    return cell, side, to_cell, to_side


def chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the elements, chain by chain from head to end, and the chain number of each; loops are left out.

    ``following`` is the next element, or -1 at the end of a chain.
    """
    n = len(following)
    jump = np.append(np.where(following < 0, n, following), n)
    count = np.append(np.ones(n, np.int64), 0)
    end = np.append(np.where(following < 0, np.arange(n), -1), -1)
    left = None
    while (open_ := int((jump[:n] < n).sum())) not in (0, left):
        left = open_
        end = np.where(end >= 0, end, end[jump])
        count = count + count[jump]
        jump = jump[jump]
    done = np.flatnonzero(jump[:n] == n)
    order = done[np.lexsort((-count[done], end[done]))]
    return order, np.cumsum(np.concatenate([[0], np.diff(end[order]) != 0])) if len(order) else order


def _steps(y: np.ndarray, x: np.ndarray, cell: np.ndarray, to_cell: np.ndarray, chain: np.ndarray, heads: np.ndarray,
           walked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Way from side to side of chains in walking order (dy, dx), whether it leaves the cell, and the sides whose cell is written down."""
    dy, dx = y[to_cell] - y[cell], x[to_cell] - x[cell]
    moves = (dy != 0) | (dx != 0)
    first = np.zeros(len(cell), bool)
    first[heads] = True
    entered = first.copy()
    entered[1:] |= moves[:-1]     # a cell is written down when the walk comes to it
    if not walked:                # and only where it turns, but for the ends of the chain
        at = np.flatnonzero(entered)
        last = np.append(np.diff(chain[at]) != 0, True)
        turn = np.ones(len(at), bool)
        step = np.stack([y[cell[at[1:]]] - y[cell[at[:-1]]], x[cell[at[1:]]] - x[cell[at[:-1]]]], axis=1)
        turn[1:-1] = (step[1:] != step[:-1]).any(axis=1)
        entered[at[~(turn | first[at] | last)]] = False
    return dy, dx, moves, entered


def _sides_of_bands(batch: pa.RecordBatch, group: np.ndarray, walked: bool, least: float) -> pa.RecordBatch | None:
    """The chains of whole bands; see :func:`border_chains`. None if there are none."""
    gy, xs, xe, band, cy, cx = (batch.column(c).to_numpy().astype(np.int64) for c in ("gy", "xs", "xe", "band", "comp_y", "comp_x"))
    halo = batch.column("halo").to_numpy(zero_copy_only=False)
    counts = xe - xs + 1
    run = np.repeat(np.arange(len(gy)), counts)
    x = xs[run] + np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    y = gy[run]
    width = int(xe.max()) + 3
    code = (group[run] * (BAND + 4) + y - band[run] * BAND + 1) * width + x + 1
    cell, side, to_cell, to_side = next_sides(code, width, np.flatnonzero(~halo[run]))
    number = np.full(4 * len(code), -1)
    number[cell * 4 + side] = np.arange(len(cell))
    following = number[to_cell * 4 + to_side]
    start = (to_side == 0) & (y[to_cell] == cy[run[to_cell]]) & (x[to_cell] == cx[run[to_cell]])  # a ring begins at its first cell
    order, chain = chains(np.where(start, -1, following))
    if not len(order):
        return None
    heads = np.flatnonzero(np.diff(chain, prepend=-1))
    cell, side, to_cell, to_side, start = (v[order] for v in (cell, side, to_cell, to_side, start))
    if least > 0:  # rings that are whole here and enclose less
        ends = np.append(heads[1:], len(order)) - 1
        first = (side[heads] == 0) & (y[cell[heads]] == cy[run[cell[heads]]]) & (x[cell[heads]] == cx[run[cell[heads]]])
        area2 = np.add.reduceat(x[cell] * y[to_cell] - x[to_cell] * y[cell], heads)
        kept = np.repeat(~(first & start[ends] & (np.abs(area2) < 2 * least)), ends - heads + 1)
        if not kept.any():
            return None
        cell, side, to_cell, to_side, start, chain = (v[kept] for v in (cell, side, to_cell, to_side, start, chain))
        chain = np.cumsum(np.diff(chain, prepend=chain[0]) != 0)
        heads = np.flatnonzero(np.diff(chain, prepend=-1))
    ends = np.append(heads[1:], len(cell)) - 1
    dy, dx, moves, entered = _steps(y, x, cell, to_cell, chain, heads, walked)

    def total(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, heads)

    def name(cells: np.ndarray, sides: np.ndarray) -> np.ndarray:
        return (y[cells] << 33) + (x[cells] << 2) + sides

    offsets = np.concatenate([[0], np.cumsum(total(entered.astype(np.int64)))])
    points = pa.StructArray.from_arrays([pa.array(v[cell[entered]].astype(np.float64)) for v in (x, y)], names=["x", "y"])
    whose = pa.array(run[cell[heads]])
    tall, wide = int(cy.max()) + 1, int(cx.max()) + 1
    of = np.unique((group.astype(np.int64) * tall + cy) * wide + cx, return_inverse=True)[1]
    n_cells = np.bincount(of, weights=np.where(halo, 0, counts)).astype(np.int64)[of[run[cell[heads]]]]
    return pa.RecordBatch.from_arrays(
        [batch.column("image_id").take(whose), batch.column("comp_y").take(whose), batch.column("comp_x").take(whose),
         pa.array(name(cell[heads], side[heads])), pa.array(name(to_cell[ends], to_side[ends]), mask=start[ends]),
         pa.array(total(x[cell] * y[to_cell] - x[to_cell] * y[cell])), pa.array(total((moves & ((dy == 0) | (dx == 0))).astype(np.int64))),
         pa.array(total(((dy != 0) & (dx != 0)).astype(np.int64))), pa.array(n_cells), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)],
        names=["image_id", "comp_y", "comp_x", "id", "to", "area2", "straight", "diagonal", "cells", "points"])


def border_chains(runs: DataFrame, walked: bool = False, least: float = 0.0) -> DataFrame:
    """Pieces of the borders in each band: ``image_id, comp_y, comp_x, id, to, area2, straight, diagonal, cells, points``.

    ``id`` names the first side of the chain and ``to`` that which follows its last one, null where a ring closes at the
    first cell of its component. Outer borders begin there; those of holes never come there. ``area2`` is the chain's
    share of twice the area, ``cells`` counts those of its component in this band, and ``points`` are the cells walked, all of
    them if ``walked``, else those at which it turns and both ends. Rings that lie in one band and enclose an area below
    ``least`` are left out.
    """
    image_type = runs.schema["image_id"].dataType.simpleString()
    band = F.expr(f"gy div {BAND}").cast("int")
    beside = F.filter(F.array(F.when((F.col("gy") % BAND == 0) & (F.col("gy") > 0), band - 1), F.when(F.col("gy") % BAND == BAND - 1, band + 1)), lambda b: b.isNotNull())
    copies = F.concat(F.array(F.struct(band.alias("band"), F.lit(False).alias("halo"))),
                      F.transform(beside, lambda b: F.struct(b.alias("band"), F.lit(True).alias("halo"))))
    dealt = (runs.select("image_id", "gy", "xs", "xe", "comp_y", "comp_x", F.explode(copies).alias("_b"))
             .select("image_id", "gy", "xs", "xe", "comp_y", "comp_x", "_b.band", "_b.halo")
             .repartition("image_id", "band").sortWithinPartitions("image_id", "band", "gy", "xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, ("image_id", "band")):
            found = _sides_of_bands(batch, group, walked, least)
            if found is not None:
                yield found

    return dealt.mapInArrow(run, f"image_id {image_type}, comp_y int, comp_x int, id bigint, to bigint, area2 bigint, straight bigint, "
                                 f"diagonal bigint, cells bigint, points array<{POINT}>")


def outlines(runs: DataFrame, walked: bool = False, least: float = 0.0) -> DataFrame:
    """Outer ring of each component of labelled runs: ``image_id, comp_y, comp_x, n_cells, area, perimeter, n_steps, ring``.

    Rings that enclose an area below ``least`` are left out.
    """
    keys = ["image_id", "comp_y", "comp_x"]
    pieces = pin(border_chains(runs, walked, least))
    start = F.col("comp_y").cast("bigint") * 2 ** 33 + F.col("comp_x").cast("bigint") * 4
    columns = [*keys, "n_cells", "area2", "straight", "diagonal", "points"]
    # a ring in one band is all of its component's outline, so all its cells are there
    rings = pieces.where((F.col("id") == start) & F.col("to").isNull()).withColumnRenamed("cells", "n_cells").select(columns)
    parted = pieces.where((F.col("id") != start) | F.col("to").isNotNull())
    if not parted.isEmpty():
        ranks = chain_ranks(parted, ["image_id"])
        sums = [F.sum(c).alias(c) for c in ("area2", "straight", "diagonal")]
        joined = (parted.join(ranks, ["image_id", "id"]).groupBy(*keys)
                  .agg(*sums, F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("at"), "points"))).alias("_p"))
                  .withColumn("points", F.flatten(F.transform("_p", lambda p: p["points"]))))
        sizes = (runs.join(parted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
                 .agg(F.sum(F.col("xe") - F.col("xs") + 1).alias("n_cells")))
        rings = rings.unionByName(joined.join(sizes, keys).where(F.abs("area2") >= 2 * least).select(columns))
    steps = F.col("straight") + F.col("diagonal")
    # the last side is the left one of the first cell, which is then there twice
    ring = F.when(F.size("points") > 1, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))
    return rings.select(
        *keys, "n_cells", (F.abs("area2") / 2.0).alias("area"), (F.col("straight") + F.col("diagonal") * F.sqrt(F.lit(2.0))).alias("perimeter"),
        steps.alias("n_steps"), ring.alias("ring"))


def _keep_far(points: np.ndarray, eps: float) -> np.ndarray:
    """Indices kept when an open line is thinned so that no dropped point is farther than ``eps`` from it."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1:b] - points[a]
        length = float(np.hypot(*base))
        if length == 0.0:
            dist = np.hypot(inner[:, 0], inner[:, 1])
        else:
            dist = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length
        far = int(dist.argmax())
        if dist[far] > eps:
            mid = a + 1 + far
            keep[mid] = True
            todo += [(a, mid), (mid, b)]
    return np.flatnonzero(keep)


def simplify_ring(ring: np.ndarray, eps: float) -> np.ndarray:
    """Thin a closed ring, split at its first point and the point farthest from it."""
    if len(ring) < 3:
        return ring
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    if far == 0:
        return ring[:1]
    closed = np.vstack([ring, ring[:1]])
    head, tail = _keep_far(closed[:far + 1], eps), _keep_far(closed[far:], eps) + far
    return closed[np.unique(np.concatenate([head, tail]))[:-1]]


def corners_only(ring: np.ndarray) -> np.ndarray:
    """Drop the vertices at which the walk goes straight on."""
    before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    return ring[(before != after).any(axis=1)]


def simplify_rings(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, eps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`corners_only` and :func:`simplify_ring` of many rings at once: points that stay, and their offsets.

    Rings of up to two points stay as they are. All open lines of a depth are split together.
    """
    sizes = np.diff(offsets)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    before, after = np.arange(len(x)) - 1, np.arange(len(x)) + 1
    some = sizes > 0
    before[offsets[:-1][some]] = offsets[1:][some] - 1
    after[offsets[1:][some] - 1] = offsets[:-1][some]
    corner = (x - x[before] != x[after] - x) | (y - y[before] != y[after] - y)
    at = np.flatnonzero(corner | (sizes <= 2)[ring])
    left = np.bincount(ring[at], minlength=len(sizes))
    start = np.cumsum(left) - left
    kept = np.ones(len(at), bool)
    long = np.flatnonzero((left >= 3) & (sizes > 2))
    if len(long):
        kept[(left >= 3)[ring[at]] & (sizes > 2)[ring[at]]] = False
        # the long rings, closed by their first point once more
        count = left[long] + 1
        first = np.cumsum(count) - count
        of = np.repeat(np.arange(len(long)), count)
        place = np.arange(len(of)) - first[of]
        src = start[long][of] + np.where(place == count[of] - 1, 0, place)
        px, py, limit = x[at[src]], y[at[src]], eps[long]
        far = np.hypot(px - px[first][of], py - py[first][of])
        top = np.maximum.reduceat(far, first)
        split = np.flatnonzero(far == top[of])
        split = split[np.diff(of[split], prepend=-1) != 0]
        stays = np.zeros(len(of), bool)
        stays[first] = True
        open_ = split > first
        stays[split[open_]] = True
        owner = np.flatnonzero(open_)
        a, b = np.concatenate([first[owner], split[owner]]), np.concatenate([split[owner], (first + count - 1)[owner]])
        owner = np.concatenate([owner, owner])
        while True:
            wide = b - a >= 2
            a, b, owner = a[wide], b[wide], owner[wide]
            if not len(a):
                break
            inner = b - a - 1
            head = np.cumsum(inner) - inner
            line = np.repeat(np.arange(len(a)), inner)
            point = a[line] + 1 + np.arange(len(line)) - head[line]
            bx, by = px[b] - px[a], py[b] - py[a]
            length = np.hypot(bx, by)
            ix, iy = px[point] - px[a][line], py[point] - py[a][line]
            flat = length == 0.0
            dist = np.abs(bx[line] * iy - by[line] * ix) / np.where(flat, 1.0, length)[line]
            dist = np.where(flat[line], np.hypot(ix, iy), dist)
            top = np.maximum.reduceat(dist, head)
            best = np.flatnonzero(dist == top[line])
            best = best[np.diff(line[best], prepend=-1) != 0]
            cut = top > limit[owner]
            mid = point[best][cut]
            stays[mid] = True
            a, b, owner = np.concatenate([a[cut], mid]), np.concatenate([mid, b[cut]]), np.concatenate([owner[cut], owner[cut]])
        kept[src[stays]] = True
    at, ring = at[kept], ring[at[kept]]
    return at, np.concatenate([[0], np.cumsum(np.bincount(ring, minlength=len(sizes)))])


def thinned(rings: DataFrame, epsilon_frac: float, min_epsilon: float) -> DataFrame:
    """Rings with ``points``: the ring thinned by ``epsilon_frac`` of its perimeter, ``min_epsilon`` at least."""
    schema = rings.schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, perimeter = batch.column("ring"), batch.column("perimeter").to_numpy()
            offsets = ring.offsets.to_numpy().astype(np.int64)
            flat = ring.flatten()
            x, y = (flat.field(c).to_numpy() for c in ("x", "y"))
            at, offsets = simplify_rings(x, y, offsets - offsets[0], np.maximum(min_epsilon, epsilon_frac * perimeter))
            points = pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at])], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)],
                                             names=[*batch.schema.names, "points"])

    return rings.mapInArrow(run, f"{schema}, points array<{POINT}>")


def components_to_polygons(cells: DataFrame, min_area: float = 20.0, epsilon_frac: float = 0.002,
                           min_epsilon: float = 1.0, external_only: bool = True) -> DataFrame:
    """Outer polygon of each component: ``image_id, comp_y, comp_x, n_cells, area, perimeter, points``.

    ``cells`` are labelled cells or, better, labelled runs. Contours below ``min_area`` or with fewer than three points
    after thinning are dropped. With ``epsilon_frac`` and ``min_epsilon`` 0 the ring is kept as walked. ``external_only``
    leaves out components inside a hole of another one.
    """
    keys = ["image_id", "comp_y", "comp_x"]
    runs = cells if "xs" in cells.columns else cell_runs(cells, ["comp_y", "comp_x"])
    walked = epsilon_frac <= 0 and min_epsilon <= 0
    # what encloses a cell that is not its own has an area of 1.5 at least, by Pick's theorem
    rings = outlines(runs, walked, min(min_area, 1.5) if external_only else min_area)
    rings = rings.withColumn("points", F.col("ring")) if walked else thinned(rings, epsilon_frac, min_epsilon)
    polygons = _without_enclosed(rings, keys) if external_only else rings
    return (polygons.where((F.col("area") >= min_area) & (F.size("points") >= 3))
            .select(*keys, "n_cells", "area", "perimeter", "points"))


def _without_enclosed(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Leave out components whose naming cell lies inside another one's ring.

    Only components with a hole, which hold fewer cells than their ring encloses (area, half the steps and one, by Pick's
    theorem), can enclose others. Their rings, not thinned, are rasterised and met with the naming cells row by row.
    """
    polygons = pin(polygons)
    enclosed = F.when(F.col("n_steps") > 0, F.col("area") + F.col("n_steps") / 2.0 + 1.0).otherwise(1.0)
    holed = polygons.where(enclosed > F.col("n_cells") + 0.5).select(
        F.col("image_id"), F.col("comp_y").alias("_oy"), F.col("comp_x").alias("_ox"),
        F.transform("ring", lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y"))).alias("points"))
    frame = F.array_max(F.transform("points", lambda p: F.greatest(p["x"], p["y"]))).cast("int") + 1
    inside = spans(holed.withColumn("_f", frame), ["image_id", "_oy", "_ox"], "points", "_f", "_f")
    found = (polygons.select(*keys).join(inside, (polygons["image_id"] == inside["image_id"]) & (F.col("comp_y") == F.col("y")))
             .where(F.col("comp_x").between(F.col("xs"), F.col("xe"))
                    & ((F.col("comp_y") != F.col("_oy")) | (F.col("comp_x") != F.col("_ox"))))
             .select(polygons["image_id"], "comp_y", "comp_x").distinct())
    return polygons.join(found, keys, "left_anti")


def mask_rings(mask: np.ndarray, y: np.ndarray, x: np.ndarray, min_area: float, epsilon_frac: float,
               min_epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The polygons of :func:`components_to_polygons` for masks that are at hand as cells, many masks at once.

    Returns mask, first row and column of the component for each polygon, and its points (offsets, x, y).
    """
    none = np.zeros(0, np.int64)
    if not len(mask):
        return none, none, none, np.zeros(1, np.int64), np.zeros(0), np.zeros(0)
    order = np.lexsort((x, y, mask))
    mask, y, x = mask[order], y[order], x[order]
    other, down, along = np.diff(mask) != 0, np.diff(y), np.diff(x)
    new = np.append(True, other | (down != 0) | (along != 0))  # repeated cells count once
    mask, y, x = mask[new], y[new], x[new]
    other, down, along = np.diff(mask) != 0, np.diff(y), np.diff(x)
    # rows that lie apart, or belong to different masks, are two apart
    row = np.cumsum(np.append(1, np.where(other, 2, np.minimum(down, 2))))
    width = int(x.max() - x.min()) + 4
    column = x - x.min() + 1
    begins = np.append(True, other | (down != 0) | (along != 1))
    run = np.cumsum(begins) - 1
    head = np.flatnonzero(begins)
    last = np.append(head[1:], len(x)) - 1
    root = _merge_edges(len(head), *touching(np.zeros(len(head), np.int64), row[head], column[head], column[last]))
    naming = head[root[run]]  # first cell of each cell's component
    cell, side, to_cell, to_side = next_sides(row * width + column, width, np.arange(len(x)))
    number = np.full(4 * len(x), -1)
    number[cell * 4 + side] = np.arange(len(cell))
    start = (to_side == 0) & (to_cell == naming[to_cell])
    order, chain = chains(np.where(start, -1, number[to_cell * 4 + to_side]))
    outer = np.zeros(len(cell), bool)
    outer[order] = True
    heads = np.flatnonzero(np.diff(chain, prepend=-1))
    # A component whose first cell has a run to its left lies where that run's right side lies: in a hole of that
    # component, or wherever that component is.
    beside = np.flatnonzero((root == np.arange(len(head))) & np.append(False, np.diff(row[head]) == 0))
    in_hole = np.zeros(len(head), bool)
    up = np.arange(len(head))
    in_hole[beside] = ~outer[number[last[beside - 1] * 4 + 1]]
    up[beside] = np.where(in_hole[beside], beside, root[beside - 1])
    while (up[up] != up).any():
        up = up[up]
    cell, to_cell = cell[order], to_cell[order]
    dy, dx, _, entered = _steps(y, x, cell, to_cell, chain, heads, epsilon_frac <= 0 and min_epsilon <= 0)
    area = np.abs(np.add.reduceat(x[cell] * y[to_cell] - x[to_cell] * y[cell], heads)) / 2.0
    diagonal = np.add.reduceat(((dy != 0) & (dx != 0)).astype(np.int64), heads)
    straight = np.add.reduceat(((dy != 0) ^ (dx != 0)).astype(np.int64), heads)
    sizes = np.add.reduceat(entered.astype(np.int64), heads)
    # the last side is the left one of the first cell, which is then there twice
    twice = np.cumsum(sizes) - 1
    points = cell[entered][np.delete(np.arange(sizes.sum()), twice[sizes > 1])]
    sizes = np.where(sizes > 1, sizes - 1, sizes)
    name = cell[heads]
    good = (area >= min_area) & ~in_hole[up[run[name]]]
    points, sizes, name = points[np.repeat(good, sizes)], sizes[good], name[good]
    offsets = np.append(0, np.cumsum(sizes))
    px, py = x[points].astype(np.float64), y[points].astype(np.float64)
    if epsilon_frac > 0 or min_epsilon > 0:
        perimeter = (straight + diagonal * np.sqrt(2.0))[good]
        at, offsets = simplify_rings(px, py, offsets, np.maximum(min_epsilon, epsilon_frac * perimeter))
        px, py = px[at], py[at]
    sizes = np.diff(offsets)
    px, py = px[np.repeat(sizes >= 3, sizes)], py[np.repeat(sizes >= 3, sizes)]
    name, sizes = name[sizes >= 3], sizes[sizes >= 3]
    return mask[name], y[name], x[name], np.append(0, np.cumsum(sizes)), px, py


def _best_of_neighbours(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose score is the best of the rows around them that have the same prompt; the first on a tie."""
    prompt = _numbered(batch, ("image_id", "shape_idx"))
    score, turn = batch.column("score"), batch.column("cand_idx")
    unscored = score.is_null().to_numpy(zero_copy_only=False)
    value = score.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    rank = np.where(unscored, 2, np.where(np.isnan(value), 0, 1))  # as Spark orders them, downwards
    numbered = turn.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((turn.fill_null(0).to_numpy(zero_copy_only=False), numbered, -np.nan_to_num(value, nan=0.0, posinf=np.inf, neginf=-np.inf), rank, prompt))
    return np.sort(order[np.diff(prompt[order], prepend=-1) != 0])


def best_mask_polygons(candidates: DataFrame, min_area: float = 20.0, epsilon_frac: float = 0.002, min_epsilon: float = 1.0) -> DataFrame:
    """``image_id, shape_idx, score, cand_idx, polygons`` of the best candidate of each prompt that is in one place.

    A mask comes as one row with all its cells, so it is outlined where it is: only outlines are shuffled, not cells. A
    prompt whose candidates lie in several places has a row for each. ``polygons`` holds ``poly_idx, points``.
    """
    kind = {c: candidates.schema[c].dataType.simpleString() for c in ("image_id", "shape_idx", "score", "cand_idx")}
    schema = ", ".join(f"{c} {t}" for c, t in kind.items()) + f", polygons array<struct<poly_idx:bigint,points:array<{POINT}>>>"
    rows = candidates.select(*kind, F.col("cells").cast("array<struct<gy:int,gx:int>>").alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = batch.take(pa.array(_best_of_neighbours(batch)))
            load = np.cumsum(best.column("cells").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // MASK_CELLS
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(load)) + 1, [best.num_rows]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = best.slice(lo, hi - lo)
                cells = part.column("cells")
                mask = np.repeat(np.arange(part.num_rows), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                gy, gx = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cells.flatten().flatten())
                of, cy, cx, offsets, px, py = mask_rings(mask, gy, gx, min_area, epsilon_frac, min_epsilon)
                points = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(px), pa.array(py)], names=["x", "y"]))
                order = np.lexsort((cx, cy, of))
                pieces = pa.StructArray.from_arrays([pa.array((cy << 32) + cx), points], names=["poly_idx", "points"]).take(pa.array(order))
                each = np.append(0, np.cumsum(np.bincount(of, minlength=part.num_rows)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kind], pa.ListArray.from_arrays(pa.array(each, pa.int32()), pieces)],
                                                 names=[*kind, "polygons"])

    return rows.mapInArrow(run, schema)
