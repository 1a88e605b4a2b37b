import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import components as C
from tilewright.operators import grids as GR
from tilewright.operators import polygons as PO
from tilewright.operators import raster as RA
from tilewright.operators.pointers import chain_ranks


def bfs(mask):
    """Label of each cell: its component's first cell in row order."""
    label, h, w = {}, *mask.shape
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in label:
            continue
        todo = [(y, x)]
        label[(y, x)] = (y, x)
        while todo:
            cy, cx = todo.pop()
            for ny in range(cy - 1, cy + 2):
                for nx in range(cx - 1, cx + 2):
                    if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and (ny, nx) not in label:
                        label[(ny, nx)] = (y, x)
                        todo.append((ny, nx))
    return label


def cells_of(spark, masks):
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "image_id bigint, gy int, gx int")


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    spiral = np.zeros((150, 150), dtype=bool)
    lo, hi = 0, 149
    while hi - lo > 3:  # one long corridor through many blocks
        spiral[lo, lo:hi] = spiral[lo:hi, hi] = spiral[hi, lo + 2:hi + 1] = spiral[lo + 2:hi, lo + 2] = True
        lo, hi = lo + 2, hi - 2
    return {0: rng.random((140, 200)) < 0.42, 1: rng.random((70, 70)) < 0.3, 2: spiral, 3: np.eye(130, dtype=bool), 4: np.ones((80, 80), dtype=bool)}


def test_components(spark, masks):
    got = C.connected_components(cells_of(spark, masks)).collect()
    assert len(got) == sum(int(m.sum()) for m in masks.values())
    want = {k: bfs(m) for k, m in masks.items()}
    for r in got:
        assert (r["comp_y"], r["comp_x"]) == want[r["image_id"]][(r["gy"], r["gx"])]


def test_merge_labels_random_graph(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, i) for i in range(2001, 2200)]
    got = {r["node"]: r["root"] for r in C.merge_labels(spark.createDataFrame(edges, "u int, v int")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


def test_polygons(spark):
    mask = np.zeros((40, 40), dtype=bool)
    mask[2:20, 2:20] = True
    mask[5:16, 5:16] = False
    mask[8:11, 8:12] = True            # island in the hole
    mask[30:34, 3:9] = True            # plain rectangle
    mask[36, 30] = True                # single cell
    comps = C.connected_components(cells_of(spark, {7: mask}))
    raw = PO.components_to_polygons(comps, 0.0, 0.0, 0.0).collect()
    assert {(r["comp_y"], r["comp_x"]) for r in raw} == {(2, 2), (30, 3)}
    by = {(r["comp_y"], r["comp_x"]): r for r in raw}
    assert by[(2, 2)]["area"] == 17 * 17 and by[(30, 3)]["area"] == 3 * 5 and by[(30, 3)]["n_cells"] == 24
    everything = PO.components_to_polygons(comps, 0.0, 0.0, 0.0, external_only=False)
    assert everything.count() == 3
    thin = {(r["comp_y"], r["comp_x"]): r for r in PO.components_to_polygons(comps, 10.0, 0.002).collect()}
    assert sorted((p["x"], p["y"]) for p in thin[(30, 3)]["points"]) == [(3, 30), (3, 33), (8, 30), (8, 33)]


def test_component_in_an_open_bay_stays_when_rings_are_thinned(spark):
    mask = np.zeros((90, 90), dtype=bool)
    mask[5:85, 5:85] = True
    mask[20:70, 12:78] = False         # hole
    mask[74:83, 44:46] = False         # bay, open to the outside below
    mask[83:90, 44:46] = False
    mask[76:80, 44:45] = False
    mask[10:14, 10:14] = False         # a second hole
    bay = np.zeros_like(mask)
    mask[72:90, 30:60] = False
    bay[76:88, 33:57] = True           # lies in the bay and touches nothing
    comps = C.connected_components(cells_of(spark, {7: mask | bay}))
    raw = {(r["comp_y"], r["comp_x"]) for r in PO.components_to_polygons(comps, 0.0, 0.0, 0.0).collect()}
    thin = {(r["comp_y"], r["comp_x"]) for r in PO.components_to_polygons(comps, 20.0, 0.05).collect()}
    assert (76, 33) in raw and (76, 33) in thin


def test_outer_ring_visits_the_whole_outline(spark):
    rng = np.random.default_rng(11)
    grids = {k: rng.random((9, 12)) < 0.55 for k in range(60)}
    found = PO.outlines(C.label_runs(C.cell_runs(cells_of(spark, grids))), walked=True).collect()
    rings = {(r["image_id"], r["comp_y"], r["comp_x"]): r for r in found}
    assert len(rings) == len(found)
    for k, mask in grids.items():
        labels = bfs(mask)
        for start in set(labels.values()):
            members = {c for c, s in labels.items() if s == start}
            row = rings.pop((k, *map(int, start)))
            ring = np.array([(p["x"], p["y"]) for p in row["ring"]])
            assert tuple(ring[0].astype(int)) == (start[1], start[0])
            assert {(int(y), int(x)) for x, y in ring} <= members
            steps = np.abs(np.roll(ring, -1, axis=0) - ring)
            assert len(ring) == max(1, row["n_steps"]) and (steps.max(axis=1) == (len(ring) > 1)).all()
            # outside cells reachable from the frame; the ring must be the members that touch them
            pad = np.zeros((11, 14), dtype=bool)
            for y, x in members:
                pad[y + 1, x + 1] = True
            seen, todo = {(0, 0)}, [(0, 0)]
            while todo:
                cy, cx = todo.pop()
                for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                    if 0 <= ny < 11 and 0 <= nx < 14 and not pad[ny, nx] and (ny, nx) not in seen:
                        seen.add((ny, nx))
                        todo.append((ny, nx))
            rim = {(y, x) for y, x in members if any((y + 1 + dy, x + 1 + dx) in seen for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
            assert {(int(y), int(x)) for x, y in ring} == rim
            if len(ring) > 1:
                nxt = np.roll(ring, -1, axis=0)
                assert row["area"] == 0.5 * abs(np.dot(ring[:, 0], nxt[:, 1]) - np.dot(ring[:, 1], nxt[:, 0]))
                assert row["perimeter"] == pytest.approx(np.hypot(*(nxt - ring).T).sum())
                holes = sum(1 for y in range(11) for x in range(14) if not pad[y, x] and (y, x) not in seen)
                assert row["area"] + len(ring) / 2 + 1 == len(members) + holes
    assert not rings


def test_one_component_is_spread_over_tasks(spark, masks):
    runs = C.label_runs(C.cell_runs(cells_of(spark, {2: masks[2]})))
    pieces = PO.border_chains(runs, walked=True)
    bands = pieces.select(F.shiftright("id", 33).alias("gy")).select(F.expr(f"gy div {C.BAND}").alias("band")).distinct()
    assert bands.count() == 3 and pieces.where("to is not null").count() > 10
    ring = PO.outlines(runs, walked=True).head()
    points = np.array([(p["x"], p["y"]) for p in ring["ring"]])
    assert (np.abs(np.roll(points, -1, axis=0) - points).max(axis=1) == 1).all()
    assert {(int(y), int(x)) for x, y in points} == set(zip(*(v.tolist() for v in np.nonzero(masks[2]))))
    turned = PO.outlines(runs).head()
    assert turned["area"] == ring["area"] and len(turned["ring"]) < len(points) / 10


def test_chain_ranks(spark):
    rng = np.random.default_rng(4)
    order = rng.permutation(300).tolist()
    links = [(1, a, b) for a, b in zip(order, order[1:])] + [(1, order[-1], None)]
    links += [(1, 1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(2, 5, None), (2, 6, 5), (2, 9, 9)]
    got = {(r["k"], r["id"]): r["rank"] for r in chain_ranks(spark.createDataFrame(links, "k int, id long, to long"), ["k"]).collect()}
    assert got == {(1, n): 300 - i for i, n in enumerate(order)} | {(2, 5): 1, (2, 6): 2}


def test_simplify_keeps_every_vertex_close():
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    ring = np.c_[50 + 40 * np.cos(t), 50 + 30 * np.sin(t)]
    out = PO.simplify_ring(ring, 1.0)
    assert 6 < len(out) < 60
    nxt = np.roll(out, -1, axis=0)
    for p in ring:
        d, e = nxt - out, p - out
        k = np.clip((d * e).sum(1) / (d ** 2).sum(1), 0, 1)[:, None]
        assert np.hypot(*(e - k * d).T).min() <= 1.0 + 1e-9


def test_spans_of_a_concave_polygon(spark):
    star = [(10.0, 0.0), (12.5, 7.5), (20.0, 8.0), (14.0, 12.0), (17.0, 20.0), (10.0, 15.0), (3.0, 20.0), (6.0, 12.0), (0.0, 8.0), (7.5, 7.5)]
    df = spark.createDataFrame([(1, star, 18, 19), (2, star[:2], 18, 19), (3, [(-5.0, 3.0), (50.0, 3.0), (50.0, 6.0), (-5.0, 6.0)], 18, 19)],
                               "id int, points array<struct<x:double,y:double>>, width int, height int")
    got = {(r["id"], r["y"], x) for r in RA.spans(df, ["id"]).collect() for x in range(r["xs"], r["xe"] + 1)}

    def inside(poly, px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
            if (ay <= py) != (by <= py) and ax + (py - ay) * (bx - ax) / (by - ay) <= px:
                odd = not odd
        return odd
    want = {(1, y, x) for y in range(19) for x in range(18) if inside(star, x + 0.5, y + 0.5)}
    want |= {(3, y, x) for y in range(3, 6) for x in range(18)}
    assert got == want


def test_merge_and_gate(spark):
    preds = spark.createDataFrame([(1, 0, 0, 2, 2, [1.0, 0.5, 0.25, 0.0], 0.4), (1, 4, 0, 2, 2, [0.0, 1.0, 1.0, 1.0], None)],
                                  "image_id int, x0 int, y0 int, gh int, gw int, seg array<double>, tile_cls double")
    rec = spark.createDataFrame([(1, 11, 8)], "image_id int, width int, height int")

    def grid(mode):
        return {(r["gy"], r["gx"]): (r["prob"], r["cls"]) for r in GR.merge_tiles(GR.gate_tiles(preds, mode, 0.5), rec, 4).collect()}
    assert grid("none") == {(0, 0): (1.0, 0.4), (0, 1): (0.25, 0.7), (1, 0): (0.25, 0.4), (1, 1): (0.5, 0.7)}
    assert grid("hard")[(0, 0)] == (0.0, 0.4) and grid("hard")[(1, 1)] == (0.5, 0.7)
    assert grid("multiply")[(0, 0)][0] == pytest.approx(0.4)


def test_upsampling(spark):
    rng = np.random.default_rng(2)
    g = rng.random((3, 4))
    cells = spark.createDataFrame([(1, y, x, float(g[y, x])) for y in range(3) for x in range(4)], "image_id int, gy int, gx int, prob double")
    sizes = spark.createDataFrame([(1, 3, 4, 13, 19)], "image_id int, gh int, gw int, out_h int, out_w int")
    got = np.array([r["vals"] for r in GR.upsample_bilinear(cells, sizes).orderBy("y").collect()])

    def axis(n_in, n_out):
        src = np.maximum((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0)
        lo = np.minimum(src.astype(int), n_in - 1)
        m = np.zeros((n_out, n_in))
        m[np.arange(n_out), lo] += 1 - (src - lo)
        m[np.arange(n_out), np.minimum(lo + 1, n_in - 1)] += src - lo
        return m
    assert got == pytest.approx(axis(3, 13) @ g @ axis(4, 19).T)
    rows = spark.createDataFrame([(1, 0, [0.9, 0.1, 0.8, 0.8]), (1, 1, [0.0, 0.0, 0.0, 0.0]), (1, 2, [0.5, 0.9, 0.9, 0.9])], "image_id int, y int, vals array<double>")
    assert sorted((r["y"], r["xs"], r["xe"]) for r in GR.row_spans_at(rows, 0.5).collect()) == [(0, 0, 0), (0, 2, 3), (2, 0, 3)]
    rec = spark.createDataFrame([(1, 19, 13)], "image_id int, width int, height int")
    near = {(r["y"], x) for r in GR.upsample_nearest(cells.where((F.col("gy") == 1) & (F.col("gx") == 2)), rec, 4).collect()
            for x in range(r["xs"], r["xe"] + 1)}
    assert near == {(y, x) for y in range(13) for x in range(19) if y * 3 // 13 == 1 and x * 4 // 19 == 2}


def test_masked_pool_falls_back_to_the_mean(spark):
    tokens = spark.createDataFrame([(1, 0, 0, [3.0, 0.0]), (1, 0, 1, [0.0, 4.0])], "object_id int, ty int, tx int, vec array<double>")
    none = spark.createDataFrame([], "object_id int, ty int, tx int, w double")
    assert GR.masked_pool(tokens, none, normalize=False).first()["embedding"] == [1.5, 2.0]
    half = spark.createDataFrame([(1, 0, 1, 0.5)], "object_id int, ty int, tx int, w double")
    assert GR.masked_pool(tokens, half).first()["embedding"] == [0.0, 1.0]


def test_boundary_over_block_edges_and_one_shuffle(spark):
    """Several blocks, a missing cell and nulls against a plain loop; the cells must travel once, not for each map."""
    rng = np.random.default_rng(8)
    a, b = rng.random((70, 131)), rng.random((70, 131)) < 0.3
    cells = {(y, x): (float(a[y, x]), None if (y + x) % 17 == 0 else float(b[y, x])) for y in range(70) for x in range(131) if (y, x) != (64, 64)}
    rows = [(k, y, x, v, t) for k in ("p", None) for (y, x), (v, t) in cells.items()]
    df = spark.createDataFrame(rows, "sample string, gy int, gx int, v double, t double").repartition(7)
    maps = GR.boundary_maps(df, ["sample"], {"bv": "v", "bt": "t"})
    got = {(r["sample"], r["gy"], r["gx"]): (r["bv"], r["bt"]) for r in maps.collect()}
    assert len(got) == len(rows)
    for (y, x) in cells:
        near = [cells[q] for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if q in cells]
        want = []
        for side in zip(*near):
            side = [v for v in side if v is not None]
            want.append(max(side) - min(side))
        assert got["p", y, x] == got[None, y, x] == pytest.approx(tuple(want), abs=1e-12)
    plan = GR.boundary_maps(df.coalesce(2), ["sample"], {"bv": "v", "bt": "t"})._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan


def test_tiles_with_sizes_are_not_joined(spark):
    """Tiles that know the size of their image give the same rows, and their grids are not moved for it."""
    rec = spark.createDataFrame([(1, 20, 12), (2, 9, 30)], "image_id bigint, width int, height int")
    rows = [(i, x, y, 4, 4, [float((x * 3 + y * 5 + i + c) % 7) for c in range(16)], 0.5) for i in (1, 2) for x in (0, 8, 16) for y in (0, 8, 16)]
    bare = spark.createDataFrame(rows, "image_id bigint, x0 int, y0 int, gh int, gw int, seg array<double>, tile_cls double")
    known = bare.join(rec, "image_id").localCheckpoint()
    want = sorted(map(str, GR.merge_rows(bare, rec, 4).collect()))
    with_sizes = GR.merge_rows(known, rec, 4)
    assert sorted(map(str, with_sizes.collect())) == want and want
    assert "Join" not in with_sizes._jdf.queryExecution().optimizedPlan().toString()


def test_dealt_tiles_merge_as_shuffled_ones_and_small_rings_are_left_out(spark):
    rng = np.random.default_rng(3)
    tiles = [(img, x, y, 4, 4, rng.integers(0, 64, 16).astype(float).tolist(), 0.5, 30, 26) for img in range(5) for x in (0, 4, 8) for y in (0, 4)]
    frame = spark.createDataFrame(tiles, "image_id long, x0 int, y0 int, gh int, gw int, seg array<double>, tile_cls double, width int, height int")
    rows = [sorted(tuple(map(str, r)) for r in GR.merge_rows(frame.coalesce(1), None, 2, dealt=d).collect()) for d in (False, True)]
    assert rows[0] == rows[1]
    runs = C.label_runs(GR.row_runs(GR.merge_rows(frame.coalesce(1), None, 2, dealt=True), 36.0), dealt=True)
    all_, some = ({(r.image_id, r.comp_y, r.comp_x): r for r in PO.outlines(runs, True, least).collect()} for least in (0.0, 1.5))
    assert some == {k: r for k, r in all_.items() if r.area >= 1.5} and len(some) < len(all_)
    sizes = {(r.image_id, r.comp_y, r.comp_x): r.n for r in runs.groupBy("image_id", "comp_y", "comp_x").agg(F.sum(F.expr("xe - xs + 1")).alias("n")).collect()}
    assert {k: r.n_cells for k, r in all_.items()} == sizes


def test_masks_are_outlined_in_their_task_like_components(spark):
    rng = np.random.default_rng(11)
    cells = [(m, int(y) - 3, int(x)) for m in range(60) for y, x in np.argwhere(rng.random((rng.integers(3, 90), rng.integers(3, 14))) < rng.choice([0.3, 0.5, 0.7, 0.85]))]
    ring = [(60, y, x) for y in range(9) for x in range(9) if max(abs(y - 4), abs(x - 4)) in (0, 2, 4)]  # one in a hole of one in a hole
    mask, y, x = (np.array(v) for v in zip(*cells, *ring))
    for min_area, frac, least in ((1.0, 0.002, 1.0), (0.0, 0.0, 0.0), (4.0, 0.05, 0.5)):
        frame = spark.createDataFrame([(int(a), int(b) + 3, int(c)) for a, b, c in zip(mask, y, x)], "image_id long, gy int, gx int")
        want = {(r["image_id"], r["comp_y"] - 3, r["comp_x"]): [(p["x"], p["y"] - 3) for p in r["points"]]
                for r in PO.components_to_polygons(C.label_runs(C.cell_runs(frame)), min_area, frac, least).collect()}
        order = rng.permutation(len(mask))
        of, cy, cx, offsets, px, py = PO.mask_rings(mask[order], y[order], x[order], min_area, frac, least)
        got = {(a, b, c): list(zip(px[i:j], py[i:j])) for a, b, c, i, j in zip(of.tolist(), cy.tolist(), cx.tolist(), offsets[:-1], offsets[1:])}
        assert set(got) == set(want) and len(got) == len(of) > 60
        assert all(sorted(got[k]) == sorted(want[k]) and got[k][0] == want[k][0] for k in got)


def test_best_mask_is_chosen_before_and_after_the_shuffle(spark):
    square = [(y, x) for y in range(3) for x in range(3)]
    rows = [(1, 1, 0, 0.2, square), (1, 1, 1, 0.9, [(y + 7, x) for y, x in square]), (1, 1, 2, 0.9, square), (1, 2, 0, None, square),
            (1, 2, 1, -5.0, []), (1, 3, 0, float("nan"), square), (1, 3, 1, 1.0, []), (1, 4, 0, None, None), (1, 1, 3, 0.95, [(9, 9)])]
    df = spark.createDataFrame(rows, "image_id long, shape_idx long, cand_idx int, score double, cells array<struct<gy:int,gx:int>>")
    for parts in (1, 4):
        best = PO.best_mask_polygons(df.coalesce(1) if parts == 1 else df.repartition(parts, "cand_idx"), 1.0)
        got = {r["shape_idx"]: (r["cand_idx"], len(r["polygons"])) for r in GR.pick_best_mask(best).collect()}
        assert got == {1: (3, 0), 2: (1, 0), 3: (0, 1), 4: (0, 0)}
    assert PO.best_mask_polygons(df.coalesce(1)).count() == 5  # one of neighbours, not one of each candidate


def test_rings_are_thinned_together_like_one_by_one():
    rng = np.random.default_rng(3)
    rings = [rng.integers(0, 6, (rng.integers(0, 20), 2)).astype(float) for _ in range(400)] + [np.ones((5, 2))]
    offsets, flat, eps = np.append(0, np.cumsum([len(r) for r in rings])), np.concatenate(rings), rng.random(len(rings)) * 2
    at, cut = PO.simplify_rings(flat[:, 0], flat[:, 1], offsets, eps)
    for ring, limit, lo, hi in zip(rings, eps, cut[:-1], cut[1:]):
        want = PO.simplify_ring(PO.corners_only(ring), limit) if len(ring) > 2 else ring
        assert flat[at[lo:hi]].tolist() == want.tolist()
