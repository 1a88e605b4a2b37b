import json
import struct
import tempfile
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright import scoring
from tilewright.operators.embeddings import write_projection_run
from tilewright.sources import readers as RD
from tilewright.sources import writers as WR


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder():
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    shape = {"label": " Vehicle ", "points": [[5, 7], [1, 2]], "group_id": None, "shape_type": "rectangle", "flags": {}}
    bad = {"label": "x", "points": [[1, 2], [3], [4, 5], [6, 7]], "shape_type": "polygon"}
    (root / "a.json").write_text(json.dumps({"version": "5", "imagePath": "a.png", "imageWidth": 8, "imageHeight": 6, "shapes": [shape, bad]}, indent=2))
    (root / "b.json").write_text(json.dumps({"shapes": None}))
    (root / "c.json").write_text(json.dumps({"imageWidth": 4, "imageHeight": 4}))
    img = np.arange(8 * 6 * 3, dtype=np.uint8).reshape(6, 8, 3)
    png(root / "a.png", img)
    png(root / "a.JPG", img)  # the suffix is what pairing looks at
    png(root / "b.jpeg", img)
    png(root / "z.png", img)
    return root, img


def test_annotations(spark, folder):
    docs = RD.read_annotations(spark, str(folder[0]))
    records, shapes = RD.records_and_shapes(docs)
    assert {(r["image_id"], r["width"], r["height"]) for r in records.collect()} == {("a", 8, 6), ("b", 0, 0), ("c", 4, 4)}
    rows = {r["shape_idx"]: r for r in shapes.collect()}
    assert len(rows) == 2 and rows[0]["label"] == " Vehicle " and tuple(rows[0]["points"][1]) == (1.0, 2.0)
    assert rows[1]["n_points"] == 4 and len(rows[1]["points"]) == 3 and rows[1]["flags"] == {}


def test_corrupt_documents(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    (root / "good.json").write_text(json.dumps({"imageWidth": 4, "imageHeight": 4, "shapes": []}))
    (root / "bad.json").write_text('{"imageWidth": 4, "shapes": [')
    assert [r["stem"] for r in RD.read_annotations(spark, str(root), "skip").collect()] == ["good"]
    with pytest.raises(Exception):
        RD.read_annotations(spark, str(root), "fail").collect()
    with pytest.raises(ValueError):
        RD.read_annotations(spark, str(root), "ignore")


def test_images_and_pairing(spark, folder):
    images = RD.list_images(spark, str(folder[0]))
    assert sorted((r["stem"], r["ext"]) for r in images.collect()) == [("a", ".jpg"), ("a", ".png"), ("b", ".jpeg"), ("z", ".png")]
    docs = RD.read_annotations(spark, str(folder[0])).select("stem")

    def paired(policy):
        return {r["stem"]: r["image_path"].rsplit("/", 1)[1] for r in RD.pair_images(docs, images, policy).collect()}
    assert paired("preference") == {"a": "a.png", "b": "b.jpeg"}
    assert paired("name") == {"a": "a.JPG", "b": "b.jpeg"}
    assert paired("png") == {"a": "a.png"}


def test_tile_pixels(spark, folder):
    root, img = folder
    pixels = RD.read_pixels(spark, str(root / "a.png")).withColumn("image_id", F.lit(1))
    tiles = spark.createDataFrame([(1, 4, 0, 0), (1, 4, 6, 4), (1, 8, -2, -1)], "image_id int, src_tile_size int, x0 int, y0 int")
    got = {(r["src_tile_size"], r["x0"]): np.array(r["pixels"]).reshape(3, 4, 4)
           for r in scoring.extract_tile_pixels(tiles, pixels, 4, normalize=False).collect()}
    assert np.array_equal(got[(4, 0)], img[:4, :4].transpose(2, 0, 1))
    corner = np.zeros((3, 4, 4))
    corner[:, :2, :2] = img[4:6, 6:8].transpose(2, 0, 1)
    assert np.array_equal(got[(4, 6)], corner)
    padded = np.zeros((8, 8, 3))
    padded[1:7, 2:8] = img[:6, :6]
    assert got[(8, -2)] == pytest.approx(padded.reshape(4, 2, 4, 2, 3).mean((1, 3)).transpose(2, 0, 1))
    norm = scoring.extract_tile_pixels(tiles.limit(1), pixels, 4).first()["pixels"]
    assert norm[0] == pytest.approx((img[0, 0, 0] / 255 - 0.485) / 0.229, rel=1e-5)


def test_scorer_sees_bounded_batches(spark):
    def make():
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"twice": pdf["x"] * 2, "seen": len(pdf)})
        return run
    df = spark.range(0, 103).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x")).coalesce(1)
    rows = scoring.score(df, make, "twice double, seen bigint", batch_size=10, keep=("k",)).collect()
    assert len(rows) == 103 and all(r["twice"] == 2 * r["k"] for r in rows) and max(r["seen"] for r in rows) == 10


def test_documents_round_trip(spark):
    records = spark.createDataFrame([(1, "a.png", 8, 6), (2, "b.x.jpg", 4, 4)], "image_id int, image_name string, width int, height int")
    shapes = spark.createDataFrame([(1, i, f"l{i}", [(0.0, float(i))]) for i in (3, 1, 2)], "image_id int, shape_idx int, label string, points array<struct<x:double,y:double>>")
    rows = shapes.select("image_id", "shape_idx", WR.shape_struct(F.col("label"), F.col("points")).alias("shape"))
    docs = {(r["image_id"], r["part"]): r for r in WR.to_labelme(records, rows, shapes_per_doc=2).collect()}
    assert sorted(docs) == [(1, 0), (1, 1), (2, 0)]
    assert docs[(1, 1)]["doc_name"] == "a__part0001.json" and docs[(2, 0)]["doc_name"] == "b.x.json"
    first = json.loads(docs[(1, 0)]["doc"])
    assert [s["label"] for s in first["shapes"]] == ["l1", "l2"] and first["imageData"] is None and first["imageHeight"] == 6
    assert first["shapes"][0] == {"label": "l1", "points": [[0.0, 1.0]], "group_id": None, "shape_type": "polygon", "flags": {}}
    assert json.loads(docs[(2, 0)]["doc"])["shapes"] == []
    out = tempfile.mkdtemp(prefix="spark-") + "/docs"
    frame = WR.to_labelme(records, rows)
    WR.write_documents(frame, out)
    with pytest.raises(Exception):
        WR.write_documents(frame, out)
    WR.write_documents(frame, out, overwrite=True)
    assert spark.read.parquet(out).count() == 2
    WR.write_document_files(frame, out + "_files")
    again = spark.read.text(out + "_files", wholetext=True)
    assert again.count() == 2


def test_manifest(spark):
    rec = spark.createDataFrame([(1, "/d/a.png", "/d/a.json"), (2, "/d/b.png", "/d/b.json")], "image_id int, image_path string, json_path string")
    got = {r["image_id"]: r["passthrough"] for r in WR.copy_manifest(rec, rec.where("image_id = 1")).collect()}
    assert got == {1: False, 2: True}
    assert WR.copy_manifest(rec).where("passthrough and output_image like '%.png'").count() == 2


def test_run_metrics_and_samples(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for run in ("r1", "r2"):
        (root / run).mkdir()
        (root / run / "history.json").write_text(json.dumps([{"split": "train", "epoch": 1, "step": 0, "total": 1.5}, {"split": "val", "epoch": 1, "step": 0, "soft_iou": 0.5}]))
    rows = RD.read_run_metrics(spark, str(root)).collect()
    assert sorted((r["run"], r["split"]) for r in rows) == [(k, s) for k in ("r1", "r2") for s in ("train", "val")]
    out = str(root / "samples")
    sample = spark.createDataFrame([("/a.png", None)], "source_image_path string, source_json_path string")
    WR.write_object_samples(sample, out)
    got = RD.read_object_samples(spark, out).first()
    assert got["source_json_path"] == "" and got["source_obj_idx"] == -1 and got["tags"] == []


def test_projection_runs_are_kept_apart(spark):
    out = tempfile.mkdtemp(prefix="spark-") + "/runs"
    write_projection_run(spark.range(3), out, "a")
    write_projection_run(spark.range(5), out, " ")
    write_projection_run(spark.range(2), out, "a")
    assert {r["run_key"]: r["count"] for r in spark.read.parquet(out).groupBy("run_key").count().collect()} == {"a": 2, "obj_umap": 5}


def test_written_documents_read_back_whole(spark, tmp_path):
    rec = spark.createDataFrame([("a", "a.png", 10, 20), ("b", "b.png", 5, 5)], "image_id string, image_name string, width int, height int")
    points = [{"x": 0.0, "y": 0.0}, {"x": float(3), "y": 0.0}, {"x": 0.0, "y": 4.0}]
    rows = [("a", i, f"l{i}", points) for i in range(7)]
    shapes = spark.createDataFrame(rows, "image_id string, shape_idx int, label string, points array<struct<x:double,y:double>>")
    shapes = shapes.select("image_id", "shape_idx", WR.shape_struct(F.col("label"), F.col("points")).alias("shape"))
    WR.write_documents(WR.to_labelme(rec, shapes, shapes_per_doc=3), str(tmp_path / "out"))
    got = {r["stem"]: r for r in RD.read_written_documents(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b"} and [s["label"] for s in got["a"]["shapes"]] == [f"l{i}" for i in range(7)]
    assert got["b"]["shapes"] == [] and got["a"]["imageWidth"] == 10
