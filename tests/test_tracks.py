import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest

from tilewright.schema import FRAMES
from tilewright.sources.readers import read_frame_stream
from tilewright.streaming import tracks as TR

RULES = TR.TrackRules(infer_every=2, iou=0.25, max_miss=1, persist=2, cooldown=3)


def make_frames(seed, streams=3, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(streams):
        xs = rng.uniform(0, 200, 3)
        for f in range(1, n + 1):
            dets = []
            if rng.random() > 0.35:
                for x in xs + rng.normal(0, 4, 3):
                    if rng.random() > 0.3:
                        x = float(x)
                        dets.append({"poly": [{"x": x, "y": 0.0}, {"x": x + 20, "y": 0.0}, {"x": x, "y": 20.0}],
                                     "x0": x, "y0": 0.0, "x1": x + 20, "y1": 20.0})
            rows.append((s, f, datetime(2024, 1, 1) + timedelta(milliseconds=40 * f), dets))
    return rows


def box_of(d):
    return d["x0"], d["y0"], d["x1"], d["y1"]


def overlap(a, b):
    """By counting, on a grid of tenths; the boxes of these tests are 20 wide and start on any real number."""
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return shared / (2 * 400.0 - shared)


def check_rules(rows, got, rules):
    """The rules, read off the result: each scored frame's tracks against those of the frame before and its detections."""
    frames = {}
    for stream, index, _, detections in rows:
        frames.setdefault(stream, {})[index] = [d for d in detections if len(d["poly"]) >= 3]
    after = {}
    for r in got:
        after.setdefault((r["stream_id"], r["frame_idx"]), []).append(r)
    assert {k[0] for k in after} <= set(frames)
    for stream, by_index in frames.items():
        first, highest, before, last_save = min(by_index), 0, {}, None
        scored = [f for f in sorted(by_index) if f == first or f % rules.infer_every == 0]
        for number, index in enumerate(scored, 1):
            now = {r["track_id"]: r for r in after.pop((stream, index), [])}
            detections = by_index[index]
            assert all(r["infer_idx"] == number for r in now.values())
            hit = {i: box_of(r) for i, r in now.items() if r["miss"] == 0}
            assert sorted(hit.values()) == sorted(map(box_of, detections))  # every detection is one track
            new = sorted(set(now) - set(before))
            assert new == list(range(highest + 1, highest + 1 + len(new)))  # identifiers are never used again
            highest += len(new)
            assert all(now[i]["hits"] == 1 and now[i]["miss"] == 0 for i in new)
            matched = {i: overlap(box_of(before[i]), hit[i]) for i in hit if i in before}
            for i, old in before.items():
                if i in matched:
                    assert now[i]["hits"] == old["hits"] + 1 and matched[i] >= rules.iou
                elif old["miss"] < rules.max_miss:
                    assert (now[i]["miss"], now[i]["hits"], box_of(now[i])) == (old["miss"] + 1, old["hits"], box_of(old))
                else:
                    assert i not in now
            of_detection = {box: matched.get(i, -1.0) for i, box in hit.items()}
            for i, old in before.items():  # no free pair was better than both of the pairs that were taken instead
                for box, taken in of_detection.items():
                    value = overlap(box_of(old), box)
                    assert value < rules.iou or value <= max(matched.get(i, -1.0), taken) + 1e-9
            lasting = {i for i, r in now.items() if r["hits"] >= rules.persist and r["miss"] == 0}
            assert lasting == {i for i, r in now.items() if r["persistent"]}
            due = bool(lasting) and (last_save is None or number - last_save >= rules.cooldown)
            assert {r["save"] for r in now.values()} <= {due}
            last_save = number if due else last_save
            before = now
    assert not after


def batch_set(spark, rows, rules=RULES):
    return as_set(TR.track_frames(spark.createDataFrame(rows, FRAMES), rules))


def as_set(df):
    return {(r["stream_id"], r["frame_idx"], r["infer_idx"], r["track_id"], round(r["x0"], 6), r["hits"], r["miss"], r["persistent"], r["save"])
            for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_batch_twin_follows_the_rules(spark, seed):
    rows = make_frames(seed)
    df = spark.createDataFrame(rows, FRAMES).repartition(5)
    check_rules(rows, TR.track_frames(df, RULES).collect(), RULES)
    assert TR.quiet_segments(TR.number_scored(df, RULES), RULES).select("segment").distinct().count() > 1


def fold(rows, rules):
    """The streaming step, frame by frame."""
    out, last_save = set(), None
    for stream in {r[0] for r in rows}:
        own = sorted((r[1], r[3]) for r in rows if r[0] == stream)
        state, number, last_save = TR.Tracker(), 0, None
        for i, (index, detections) in enumerate(own):
            if i and index % rules.infer_every:
                continue
            number += 1
            TR.advance(state, TR._detections(detections), number, rules)
            lasting = any(TR.is_persistent(t, number, rules) for t in state.tracks)
            save = lasting and (last_save is None or number - last_save >= rules.cooldown)
            last_save = number if save else last_save
            out |= {(stream, index, number, t[0], round(t[1][0], 6), t[3], t[4], TR.is_persistent(t, number, rules), save) for t in state.tracks}
    return out


def crowd(seed, places, n, miss=0.0):
    """A stream without an empty frame, of boxes at a few whole places, so that many overlaps are equal."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(1, n + 1):
        dets = []
        for p in places:
            if rng.random() >= miss:
                x = float(p + rng.integers(0, 3) * 4)
                dets.append({"poly": [{"x": x, "y": 0.0}, {"x": x + 20, "y": 0.0}, {"x": x, "y": 20.0}], "x0": x, "y0": 0.0, "x1": x + 20, "y1": 20.0})
        rows.append((1, f, datetime(2024, 1, 1) + timedelta(milliseconds=40 * f), dets))
    return rows


@pytest.mark.parametrize("places, miss, max_miss", [([0, 0, 8], 0.0, 1), ([0, 4, 12, 30, 34], 0.2, 2)])
def test_crowded_streams_with_equal_overlaps(spark, places, miss, max_miss):
    rules = TR.TrackRules(infer_every=1, iou=0.25, max_miss=max_miss, persist=2, cooldown=3)
    rows = crowd(len(places), places, 60, miss)
    assert batch_set(spark, rows, rules) == fold(rows, rules)


def test_saves_of_one_dense_stream(spark):
    steps = [i for i in range(1, 400) if i % 13] + [500, 503, 504, 900]
    got = TR.save_decisions(spark.createDataFrame([(1, i) for i in steps] + [(2, 7)], "stream_id long, infer_idx long"), 8)
    want, last = {(2, 7)}, None
    for i in steps:
        if last is None or i - last >= 8:
            want.add((1, i))
            last = i
    rows = got.collect()
    assert {(r["stream_id"], r["infer_idx"]) for r in rows if r["save"]} == want and len(rows) == len(steps) + 1


def write_parts(spark, rows, cuts):
    path = tempfile.mkdtemp(prefix="spark-")
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = [r for r in rows if lo < r[1] <= hi]
        pd_rows = spark.createDataFrame(part, FRAMES).coalesce(1)
        pd_rows.write.mode("append").parquet(path)
    return path


def run_stream(spark, path, out, max_files, checkpoint=None):
    checkpoint = checkpoint or tempfile.mkdtemp(prefix="spark-")
    tracked = TR.track_stream(read_frame_stream(spark, path, max_files), RULES, idle_ms=None)
    q = (tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return checkpoint


@pytest.mark.parametrize("cuts, max_files", [((0, 60), 1), ((0, 7, 30, 31, 60), 1), ((0, 7, 30, 31, 60), 3)])
def test_stream_equals_batch_for_any_cut(spark, cuts, max_files):
    rows = make_frames(9)
    out = tempfile.mkdtemp(prefix="spark-")
    run_stream(spark, write_parts(spark, rows, cuts), out, max_files)
    assert as_set(spark.read.parquet(out)) == batch_set(spark, rows)


def test_restart_and_replayed_frames(spark):
    rows = make_frames(4, streams=2)
    path, out = write_parts(spark, rows, (0, 30)), tempfile.mkdtemp(prefix="spark-")
    checkpoint = run_stream(spark, path, out, 1)
    spark.createDataFrame([r for r in rows if 20 < r[1]], FRAMES).coalesce(1).write.mode("append").parquet(path)
    run_stream(spark, path, out, 1, checkpoint)
    got = spark.read.parquet(out)
    assert as_set(got) == batch_set(spark, rows)
    assert got.agg({"late": "max"}).first()[0] == 10
    assert got.where("fps > 0").agg({"fps": "max"}).first()[0] == pytest.approx(25.0)


def test_save_sink_replaces_a_repeated_batch(spark):
    rows = make_frames(4, streams=2)
    path, out, cp = write_parts(spark, rows, (0, 60)), tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    q = TR.save_documents(TR.track_stream(read_frame_stream(spark, path), RULES, idle_ms=None), out, cp).trigger(availableNow=True).start()
    q.awaitTermination()
    saved = spark.read.parquet(out)
    want = {(s, f, t) for s, f, _, t, _, _, _, p, save in batch_set(spark, rows) if p and save}
    assert {(r["stream_id"], r["frame_idx"], r["track_id"]) for r in saved.collect()} == want


def test_outlines_of_two_points_open_no_track(spark):
    line = {"poly": [{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 20.0}], "x0": 0.0, "y0": 0.0, "x1": 20.0, "y1": 20.0}
    full = {**line, "poly": [*line["poly"], {"x": 0.0, "y": 20.0}]}
    rows = [(1, f, datetime(2024, 1, 1), [line] if f < 5 else [line, full]) for f in range(1, 9)]
    got = TR.track_frames(spark.createDataFrame(rows, FRAMES), RULES).collect()
    assert {r["track_id"] for r in got} == {1} and {r["frame_idx"] for r in got} == {6, 8}
    check_rules(rows, got, RULES)


def test_pairs_are_taken_best_first():
    assert TR.pair_up(np.array([[0.5, 0.6], [0.55, 0.9]]), 0.25) == {1: 1, 0: 0}
    assert TR.pair_up(np.array([[0.1, 0.2]]), 0.25) == {} and TR.pair_up(np.zeros((0, 2)), 0.1) == {}
