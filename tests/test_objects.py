import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import embeddings as V
from tilewright.operators import export as EX
from tilewright.operators import pasting as PA
from tilewright.operators import tiling as T
from tilewright.plans import jobs as J
from tilewright.plans.registry.jobs import masks


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_with_many_copies(spark, metric):
    """A third of the vectors are the same one."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float64)
    x[::3] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    got = {}
    for r in V.knn_graph(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5, metric).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["distance"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    for i in range(len(x)):
        d = 1 - u @ u[i] if metric == "cosine" else np.linalg.norm(u - u[i], axis=1)
        same = (x == x[i]).all(1)
        d[same] = 0.0
        order = sorted((round(float(d[j]), 9), j) for j in range(len(x)) if j != i)[:5]
        mine = sorted(got[i])
        assert [m[1] for m in mine] == [j for _, j in order]
        assert [m[2] for m in mine] == pytest.approx([v for v, _ in order], abs=1e-7)


def test_knn_lists_no_vector_for_each_cell(spark, monkeypatch):
    """Where nothing can be ruled out, what is kept must not be vectors times cells; many small blocks give the same."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    kept = []
    whole = V.pin
    monkeypatch.setattr(V, "pin", lambda df: kept.append(whole(df)) or kept[-1])
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in V.knn_graph(df, 4, "euclidean").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    for i in range(len(x)):
        d = np.linalg.norm(x - x[i], axis=1)
        assert [j for _, j in sorted(got[i])] == [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
    assert max(f.count() for f in kept if "v" in f.columns) <= len(x)


def test_cluster_count():
    assert [V.cluster_count(k, n) for k, n in ((0, 9), (12, 100), (12, 5), (12, 1), (20, 10))] == [2, 12, 5, 2, 8]


def tiles_of(spark, pos, fp, pure):
    rows = [("p", i, 1, 0) for i in range(pos)] + [("f", i, 0, 1) for i in range(fp)] + [("n", i, 0, 0) for i in range(pure)]
    return spark.createDataFrame([(k, 224, i, 0, o, f) for k, i, o, f in rows], "image_id string, src_tile_size int, x0 int, y0 int, is_object int, has_fp int")


@pytest.mark.parametrize("pos, fp, pure, ratio, want", [
    (10, 4, 50, 0.5, {"pos": 10, "fp_neg": 4, "pure_neg": 6}),       # more quota than tiles with false positives
    (10, 40, 50, 0.25, {"pos": 10, "fp_neg": 2, "pure_neg": 8}),     # round(2.5) is 2
    (10, 30, 3, 0.2, {"pos": 10, "fp_neg": 2, "pure_neg": 3, "fill": 5}),
    (10, 0, 0, 0.5, {"all": 10}), (0, 3, 3, 0.5, {"all": 6}),
    (9, 2, 2, 0.0, {"pos": 4, "pure_neg": 2, "fill": 2}),
])
def test_balance(spark, pos, fp, pure, ratio, want):
    got = T.balance_tiles(tiles_of(spark, pos, fp, pure), ratio).groupBy("draw").count().collect()
    assert {r["draw"]: r["count"] for r in got} == want


@pytest.mark.parametrize("pos, neg, ratio, frac, want", [
    (10, 100, 0.5, 0.2, {"pos": 10, "hard": 5, "rest": 5}), (10, 4, 0.5, 0.5, {"pos": 10, "hard": 2, "rest": 2, "fill": 6}),
    (10, 100, 1.0, 0.03, {"pos": 10, "hard": 3, "rest": 7}), (4, 6, 0.5, 1.0, {"pos": 4, "hard": 2, "rest": 2}),
    (0, 6, 0.5, 1.0, {"all": 6}),
])
def test_hard_negatives(spark, pos, neg, ratio, frac, want):
    tiles = tiles_of(spark, pos, 0, neg)
    scores = tiles.select(*T.TILE_KEY, (F.col("x0") / 100.0).cast("double").alias("score"))
    mined = T.mine_hard_negatives(tiles, scores, T.TILE_KEY, 1, hard_ratio=ratio, pool_fraction=frac).collect()
    counts = {}
    for r in mined:
        counts[r["draw"]] = counts.get(r["draw"], 0) + 1
        if r["draw"] == "hard":
            assert r["x0"] >= neg - max(1, int(neg * frac))
    assert counts == want


def test_tiles_cover_the_image_and_modes_nest(spark):
    rec = spark.createDataFrame([(1, 500, 224), (2, 100, 90), (3, 224, 448)], "image_id int, width int, height int")
    for r in rec.collect():
        tiles = [t for t in T.tile_origins(rec, [(224, 150)]).collect() if t["image_id"] == r["image_id"]]
        seen = np.zeros((r["height"], r["width"]), dtype=bool)
        for t in tiles:
            seen[t["y0"]:t["y0"] + 224, t["x0"]:t["x0"] + 224] = True
        assert seen.all() and len({(t["x0"], t["y0"]) for t in tiles}) == len(tiles)
    rng = np.random.default_rng(0)
    boxes = [(int(i % 3) + 1, i, float(a), float(b), float(a + c), float(b + e), False) for i, (a, b, c, e) in enumerate(rng.integers(0, 120, (90, 4)))]
    obj = spark.createDataFrame(boxes, "image_id int, shape_idx int, x0 double, y0 double, x1 double, y1 double, is_fp boolean")
    key = lambda df: {(r["image_id"], r["x0"], r["y0"], r["shape_idx"]) for r in df.collect()}
    inside, touch = (key(T.tile_objects(rec, obj, [(96, 40)], m)) for m in ("contained", "intersects"))
    origins = [(t["image_id"], t["x0"], t["y0"]) for t in T.tile_origins(rec, [(96, 40)]).collect()]
    assert inside <= touch
    assert inside == {(i, x, y, k) for i, x, y in origins for img, k, a, b, c, e, _ in boxes
                      if img == i and a >= x and b >= y and c <= x + 96 and e <= y + 96 and c > a and e > b}
    assert touch == {(i, x, y, k) for i, x, y in origins for img, k, a, b, c, e, _ in boxes
                     if img == i and not (c < x or a > x + 96 or e < y or b > y + 96)}


def test_no_positive_tiles(spark):
    shapes = spark.createDataFrame([("car",)], "label string")
    with pytest.raises(ValueError, match="car"):
        T.assert_positive_tiles(tiles_of(spark, 0, 1, 1), shapes, "vehicle")
    T.assert_positive_tiles(tiles_of(spark, 1, 0, 0), shapes, "vehicle")


def test_paste_plan_equals_sequential_loop(spark):
    rec = spark.createDataFrame([(i, 200 + i, 150 + i) for i in range(25)], "image_id int, width int, height int")
    donors = spark.createDataFrame([(900 + i, i, 300.0 + 50 * i, 20 + i, 25 + i, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]) for i in range(4)],
                                   "image_id int, shape_idx int, area double, bbox_h int, bbox_w int, outline array<struct<x:double,y:double>>")
    ratios = spark.createDataFrame([(0.02,), (0.05,), (0.08,)], "ratio double")
    have = [(i, float(x), 60.0, float(x + 50), 110.0) for i in range(25) for x in (10, 90)]
    existing = spark.createDataFrame(have, "image_id int, x0 double, y0 double, x1 double, y1 double")
    rules = PA.PasteRules(min_pastes=2, max_pastes=5, tries=9, horizon=0.3, max_iou=0.05)
    bright = spark.createDataFrame([(3, y, x, 255.0) for y in range(20) for x in range(20)], "image_id int, gy int, gx int, mean double")
    got = {(r["image_id"], r["paste"], r["try"]) for r in PA.plan_pastes(rec, existing, donors, ratios, rules, bright).collect()}

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        area = [max(1, (r[2] - r[0]) * (r[3] - r[1])) for r in (a, b)]
        return inter / (sum(area) - inter) if inter > 0 else 0.0
    want, placed = set(), {}
    for r in sorted(PA.paste_candidates(rec, donors, ratios, rules).collect(), key=lambda r: (r["image_id"], r["paste"], r["try"])):
        img, box = r["image_id"], (r["x0"], r["y0"], r["x1"], r["y1"])
        assert 0 <= box[0] and box[2] <= 200 + img and box[3] <= 150 + img and box[1] >= round(0.3 * (150 + img)) or box[3] == 150 + img
        taken = placed.setdefault(img, {})
        if img == 3 or r["paste"] in taken:
            continue
        others = [b[1:] for b in have if b[0] == img] + list(taken.values())
        if all(iou(box, o) <= 0.05 for o in others):
            taken[r["paste"]] = box
            want.add((img, r["paste"], r["try"]))
    assert got == want and len(want) > 25


def test_export_rules(spark):
    cols = "source_image_path string, source_json_path string, source_obj_idx bigint, tags array<string>, source_points array<struct<x:double,y:double>>, o int"
    tri = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    samples = spark.createDataFrame([
        ("/a.png", "/a.json", 0, ["Vehicle"], None, 1), ("/a.png", "/a.json", 0, ["vehicle", "fp"], None, 2),
        ("/a.png", "/a.json", 5, ["fp"], None, 3), ("/a.png", "/a.json", 5, ["fp"], tri, 4), ("/x.png", "/a.json", 0, ["fp"], tri, 5),
        ("", "/a.json", 0, ["fp"], tri, 6), ("/a.png", "/a.json", -1, ["fp"], tri, 7), ("/a.png", "/a.json", 0, ["car"], tri, 8)], cols)
    images = spark.createDataFrame([("/a.png",)], "path string")
    shapes = spark.createDataFrame([("/a.json", 0, "rectangle", [(4.0, 4.0), (1.0, 2.0)])], "json_path string, shape_idx int, shape_type string, points array<struct<x:double,y:double>>")
    c = EX.classify_samples(samples, images, shapes, ["vehicle", "fp"])
    assert {r["o"]: r["reason"] for r in c.collect()} == {1: "valid", 2: "valid", 3: "invalid", 4: "valid", 5: "invalid", 6: "invalid", 7: "invalid", 8: "unlabeled"}
    chosen = EX.selected_objects(c, ["o"])
    assert sorted(r["o"] for r in chosen.collect()) == [1, 4]
    assert EX.export_counts(c, chosen).first().asDict() == {"skipped_unlabeled": 1, "skipped_invalid": 4, "exported_shapes": 2, "exported_images": 1, "duplicates": 1}
    zero = EX.classify_samples(samples, images, shapes, ["vehicle", "fp"], skip_index_zero=True)
    assert {r["o"] for r in zero.where("reason = 'valid'").collect()} == {4}


def test_export_job_counts_what_it_writes(spark):
    cols = "source_image_path string, source_json_path string, source_obj_idx bigint, tags array<string>, source_points array<struct<x:double,y:double>>, o int"
    tri = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    samples = spark.createDataFrame([
        ("/a.png", "/a.json", 0, ["fp"], tri, 1), ("/b.png", "/a.json", 0, ["fp"], tri, 2), ("/a.png", "/empty.json", 3, ["fp"], tri, 3),
        ("/a.png", "/gone.json", 4, ["fp"], tri, 4)], cols)
    images = spark.createDataFrame([("/a.png",), ("/b.png",)], "path string")
    shapes = spark.createDataFrame([("/a.json", 0, "polygon", tri)], "json_path string, shape_idx int, shape_type string, points array<struct<x:double,y:double>>")
    sizes = spark.createDataFrame([("/a.png", 10, 20)], "path string, width int, height int")
    listed = spark.createDataFrame([("/a.json",), ("/empty.json",)], "path string")
    docs, manifest, counts = J.export_tagged(samples, images, shapes, sizes, ["fp"], ["o"], documents=listed)
    assert counts.head().asDict() == {"skipped_unlabeled": 0, "skipped_invalid": 1, "skipped_unsized": 1, "exported_shapes": 2,
                                      "exported_images": 1, "duplicates": 0}
    assert docs.count() == 1 and [r["source_image"] for r in manifest.collect()] == ["/a.png"]
    assert J.export_tagged(samples, images, shapes, sizes, ["fp"], ["o"])[2].head()["skipped_invalid"] == 2


@pytest.mark.parametrize("mode, want", [("bbox", (4, 2, 4, 1, 1)), ("point", (4, 1, 1, 1, 0))])
def test_conversion_counts_all_records_and_prompts(spark, mode, want):
    box, flat, three = [(5.0, 5.0), (30.0, 30.0)], [(5.0, 5.0), (5.0, 30.0)], [(9.0, 9.0), (30.0, 9.0), (9.0, 30.0)]
    rows = [(1, 5, "rectangle", box), (1, 6, "Rectangle", box), (1, 7, "rectangle", flat), (1, 9, "rectangle", box[:1]),
            (2, 8, "rectangle", flat), (3, 11, "polygon", three), (9, 5, "rectangle", box)]
    shapes = spark.createDataFrame(
        [(i, k, "car", t, p, None, {}) for i, k, t, p in rows], "image_id long, shape_idx long, label string, shape_type "
        "string, points array<struct<x double, y double>>, group_id bigint, flags map<string,string>")
    records = spark.createDataFrame([(i, 100, 100) for i in (1, 2, 3, 4)], "image_id long, width int, height int")
    got = J.box_to_polygon_dataset(records, shapes, masks, mode, 4, min_area=4.0)[1].head()
    assert (got["records_total"], got["records"], got["prompts_total"], got["prompts_converted"], got["prompts_fallback"]) == want


def test_pastes_are_stored_without_their_tries(spark):
    records = spark.createDataFrame([(i, 640, 480) for i in range(6)], "image_id long, width int, height int")
    donors = spark.createDataFrame([(9, 1, 900.0, 30, 30)], "image_id long, shape_idx long, area double, bbox_h int, bbox_w int")
    ratios = spark.createDataFrame([(0.004,)], "ratio double")
    rules = PA.PasteRules(min_pastes=2, max_pastes=2, tries=7)
    sizes = PA.paste_sizes(records, donors, ratios, rules)
    assert sizes.count() == 12 and PA.paste_tries(sizes, rules).count() == 84
