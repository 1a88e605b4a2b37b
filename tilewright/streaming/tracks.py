"""Tracks over detections of a frame stream.

Structured Streaming keeps the state of each stream and takes it frame by frame. The batch twin has whole streams: it
matches detections as edges of a graph, all frames at once, and gets ages, identifiers and saved frames from list ranking
and pointer doubling, so a stream is never walked in one task.

Rules that belong to this engine: frames are taken in ``frame_idx`` order within a micro-batch, a frame that is not
newer than the last one is dropped and counted, and the state of an idle stream expires by processing time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.operators.components import merge_labels
from tilewright.operators.pointers import chain_ranks, reached
from tilewright.operators.ranking import number_rows
from tilewright.operators.selection import RATE_KEEP, infer_gate
from tilewright.session import pin

NEVER = -(10 ** 9)


@dataclass(frozen=True)
class TrackRules:
    infer_every: int = 2
    iou: float = 0.25
    max_miss: int = 1
    persist: int = 3
    cooldown: int = 8


@dataclass
class Tracker:
    """State of one stream. A track is ``[id, box, outline, hits, miss, last_infer]``."""

    next_id: int = 1
    tracks: list = field(default_factory=list)


def overlap_matrix(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """IoU of every box with every other one; boxes below one pixel count as one pixel."""
    if not len(boxes) or not len(others):
        return np.zeros((len(boxes), len(others)))
    a, b = boxes[:, None, :], others[None, :, :]
    sides = np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])
    shared = np.where((sides > 0).all(axis=-1), sides.prod(axis=-1), 0.0)
    size_a, size_b = (np.maximum(1.0, (x[..., 2:] - x[..., :2]).prod(axis=-1)) for x in (a, b))
    return shared / (size_a + size_b - shared)


def pair_up(overlap: np.ndarray, least: float) -> dict[int, int]:
    """column -> row: the best free pair again and again, until none reaches ``least``."""
    free, out = overlap.copy(), {}
    while free.size:
        row, column = np.unravel_index(free.argmax(), free.shape)
        if free[row, column] < least:
            break
        out[int(column)] = int(row)
        free[row, :] = free[:, column] = -1.0
    return out


def advance(state: Tracker, detections: Iterable[tuple], infer_idx: int, rules: TrackRules) -> None:
    """Take the detections ``(box, outline)`` of a scored frame into the state. Outlines under three points don't count."""
    found = [d for d in detections if len(d[1]) >= 3]
    boxes = [np.array([box for box in side], dtype=float).reshape(-1, 4) for side in ([t[1] for t in state.tracks], [d[0] for d in found])]
    partner = pair_up(overlap_matrix(*boxes), rules.iou)
    seen = {row: found[column] for column, row in partner.items()}
    aged = [[t[0], *seen[i], t[3] + 1, 0, infer_idx] if i in seen else [*t[:4], t[4] + 1, t[5]] for i, t in enumerate(state.tracks)]
    fresh = [d for column, d in enumerate(found) if column not in partner]
    opened = [[state.next_id + i, *d, 1, 0, infer_idx] for i, d in enumerate(fresh)]
    state.next_id += len(opened)
    state.tracks = [t for t in aged + opened if t[4] <= rules.max_miss]


def is_persistent(track, infer_idx: int, rules: TrackRules) -> bool:
    return track[3] >= rules.persist and track[4] == 0 and track[5] == infer_idx and len(track[2]) >= 3


def _detections(cell) -> list[tuple]:
    if cell is None:
        return []
    return [((d["x0"], d["y0"], d["x1"], d["y1"]), [(p["x"], p["y"]) for p in d["poly"]]) for d in cell]


def _track_row(track, infer_idx: int, rules: TrackRules) -> dict:
    box = track[1]
    return {"track_id": track[0], "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3],
            "poly": [{"x": x, "y": y} for x, y in track[2]], "hits": track[3], "miss": track[4], "last_infer": track[5],
            "persistent": is_persistent(track, infer_idx, rules)}


TRACK_COLUMNS = ("track_id bigint, x0 double, y0 double, x1 double, y1 double, poly array<struct<x:double,y:double>>, "
                 "hits bigint, miss bigint, last_infer bigint, persistent boolean")
STREAM_OUTPUT = f"stream_id bigint, frame_idx bigint, infer_idx bigint, {TRACK_COLUMNS}, save boolean, fps double, late bigint"
STREAM_STATE = "last_frame bigint, infer_idx bigint, next_id bigint, last_save bigint, late bigint, fps double, last_us bigint, tracks string"


def track_stream(frames: DataFrame, rules: TrackRules = TrackRules(), idle_ms: int | None = 3_600_000) -> DataFrame:
    """Tracks after every scored frame of a streaming ``frames`` table, with the save decision and the smoothed rate.

    State of a stream expires after ``idle_ms`` without frames. Pass None with the ``availableNow`` trigger: Spark keeps
    starting empty batches for as long as a processing-time timeout could fire, so such a run would not end.
    """
    names = [c.split()[0] for c in STREAM_OUTPUT.split(", ") if ":" not in c.split()[0]]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            last_frame, infer_idx, next_id, last_save, late, fps, last_us, saved = state.get
            tracker = Tracker(next_id, json.loads(saved))
        else:
            last_frame, infer_idx, last_save, late, fps, last_us, tracker = None, 0, NEVER, 0, 0.0, None, Tracker()
        rows = []
        todo = pd.concat(list(batches), ignore_index=True).sort_values("frame_idx", kind="stable")
        for frame_idx, ts, cell in todo[["frame_idx", "ts", "detections"]].itertuples(index=False):
            frame_idx = int(frame_idx)
            if last_frame is not None and frame_idx <= last_frame:
                late += 1
                continue
            first, last_frame = last_frame is None, frame_idx
            now = pd.Timestamp(ts).value // 1000
            if last_us is not None and now > last_us:
                rate = 1e6 / (now - last_us)
                fps = rate if fps <= 0 else RATE_KEEP * fps + (1.0 - RATE_KEEP) * rate
            last_us = now
            if not first and frame_idx % max(1, rules.infer_every):
                continue
            infer_idx += 1
            advance(tracker, _detections(cell), infer_idx, rules)
            out = [_track_row(t, infer_idx, rules) for t in tracker.tracks]
            save = any(o["persistent"] for o in out) and infer_idx - last_save >= rules.cooldown
            if save:
                last_save = infer_idx
            rows += [{"stream_id": key[0], "frame_idx": frame_idx, "infer_idx": infer_idx, **o, "save": save, "fps": fps,
                      "late": late} for o in out]
        state.update((last_frame, infer_idx, tracker.next_id, last_save, late, fps, last_us, json.dumps(tracker.tracks)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=names)

    return frames.groupBy("stream_id").applyInPandasWithState(
        run, STREAM_OUTPUT, STREAM_STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def persistent_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.where("persistent")


def save_documents(tracks: DataFrame, path: str, checkpoint: str, label: str = "vehicle"):
    """Start a query that writes the persistent outlines of every saved frame, one row per outline.

    Each micro-batch has its own folder, written with overwrite, so a repeated batch replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.where("save and persistent")
         .select("stream_id", "frame_idx", "track_id", F.lit(label).alias("label"), F.lit("polygon").alias("shape_type"),
                 F.col("poly").alias("points"))
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))

    return tracks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def number_scored(frames: DataFrame, rules: TrackRules) -> DataFrame:
    """Scored frames with their dense ``infer_idx`` per stream, from 1."""
    scored = infer_gate(frames, rules.infer_every)
    return number_rows(scored, ["stream_id"], ["frame_idx"], "infer_idx")


def quiet_segments(scored: DataFrame, rules: TrackRules) -> DataFrame:
    """Column ``segment``: grows after every ``max_miss + 1`` scored frames in a row without detections.

    After such a run no track is left, so what follows does not depend on what came before.
    """
    empty = scored.where(F.size("detections") == 0).select("stream_id", "infer_idx")
    run = rules.max_miss + 1
    after = (empty.withColumn("infer_idx", F.explode(F.sequence(F.col("infer_idx") + 1, F.col("infer_idx") + run)))
             .groupBy("stream_id", "infer_idx").agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") == run).select("stream_id", "infer_idx", F.lit(1).cast("bigint").alias("_cut")))
    marked = (scored.join(after, ["stream_id", "infer_idx"], "left")
              .withColumn("_cut", F.coalesce("_cut", F.lit(0).cast("bigint"))))
    return number_rows(marked, ["stream_id"], ["infer_idx"], "segment", weight="_cut").drop("_cut")


def detection_rows(scored: DataFrame) -> DataFrame:
    """One row for each detection with an outline of three points or more: ``stream_id, t, id`` and the detection.

    ``id`` grows with the scored frame ``t`` and, within it, with the place of the detection.
    """
    each = scored.select("stream_id", F.col("infer_idx").alias("t"), F.posexplode("detections").alias("_k", "d"))
    return each.where(F.size("d.poly") >= 3).select("stream_id", "t", (F.shiftleft("t", 24) + F.col("_k")).alias("id"), "d")


def overlaps(detections: DataFrame, rules: TrackRules) -> DataFrame:
    """Edges ``stream_id, u, v, t, iou``: a track whose last detection is ``u`` could go on with ``v`` in frame ``t``.

    A track is forgotten after ``max_miss`` frames without a match, so ``u`` is at most ``max_miss + 1`` frames older.
    """
    boxes = detections.select("stream_id", "t", "id", *[F.col(f"d.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    older = boxes.withColumn("t", F.explode(F.sequence(F.col("t") + 1, F.col("t") + rules.max_miss + 1)))
    older = older.withColumnsRenamed({"id": "u", "x0": "_x0", "y0": "_y0", "x1": "_x1", "y1": "_y1"})
    both = older.join(boxes.withColumnRenamed("id", "v"), ["stream_id", "t"])
    wide = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    high = F.least("y1", "_y1") - F.greatest("y0", "_y0")
    shared = F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)
    one = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    other = F.greatest(F.lit(1.0), (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")))
    return both.withColumn("iou", shared / (other + one - shared)).where(F.col("iou") >= rules.iou).select("stream_id", "u", "v", "t", "iou")


def matched(edges: DataFrame) -> DataFrame:
    """The edges (``stream_id, u, v``) that frame-by-frame matching, the best free pair first, takes.

    An edge is decided by those that share an end with it and come before it: earlier frames, then larger overlap. So
    all edges that come first at both of their ends are taken at once, what they exclude is dropped, and so on, wherever
    they are in their streams. A round goes on as long as the one before decided half of what was open; what is left,
    where each edge waits for the last one or equal overlaps ask for the age of the tracks, goes to :func:`_settled`.
    """
    source = W.partitionBy("stream_id", "u").orderBy("t", F.col("iou").desc(), "v")
    target = W.partitionBy("stream_id", "v").orderBy(F.col("iou").desc())
    whole = W.partitionBy("stream_id", "v", "iou")
    left = pin(edges)
    taken, size = [], left.count()
    while size:
        judged = (left.withColumns({"_s": F.row_number().over(source) == 1, "_r": F.rank().over(target) == 1})
                  .withColumn("_one", F.count(F.lit(1)).over(whole) == 1))
        now = pin(judged.where(F.col("_s") & F.col("_r") & F.col("_one")).select("stream_id", "u", "v"))
        taken.append(now)
        left = pin(left.join(now.select("stream_id", "u"), ["stream_id", "u"], "left_anti").join(now.select("stream_id", "v"), ["stream_id", "v"], "left_anti"))
        before, size = size, left.count()
        if 2 * size > before:
            break
    found = left.select("stream_id", "u", "v").limit(0)
    for part in taken:
        found = found.unionByName(part)
    return found.unionByName(_settled(left, found)) if size else found


def _settled(left: DataFrame, taken: DataFrame) -> DataFrame:
    """Edges taken among those that the rounds have left open.

    Chains of taken edges are contracted to their first detection. What is connected by open edges is walked in order,
    with the age of each track known; different groups are walked in different tasks.
    """
    ids = left.select("stream_id", F.col("u").alias("id")).unionByName(taken.select("stream_id", F.col("u").alias("id"))).unionByName(
        taken.select("stream_id", F.col("v").alias("id"))).unionByName(left.select("stream_id", F.col("v").alias("id"))).distinct()
    back = ids.join(taken.select("stream_id", F.col("v").alias("id"), F.col("u").alias("to")), ["stream_id", "id"], "left")
    heads = pin(chain_ranks(back, ["stream_id"]).select("stream_id", "id", F.col("end").alias("head")))
    open_ = left.join(heads.select("stream_id", F.col("id").alias("u"), F.col("head").alias("hu")), ["stream_id", "u"])
    nodes = open_.select(F.struct("stream_id", F.col("hu").alias("id")).alias("u"), F.struct("stream_id", F.col("v").alias("id")).alias("v"))
    groups = merge_labels(nodes).select("node.stream_id", F.col("node.id").alias("hu"), F.col("root.id").alias("group"))
    dealt = (open_.join(groups, ["stream_id", "hu"]).repartition("stream_id", "group")
             .sortWithinPartitions("stream_id", "group", "t", F.col("iou").desc()))
    key_type = left.schema["stream_id"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root, used, waiting = None, {}, set(), []

        def settle(out: list) -> None:
            """The edges of one frame with one overlap: by the age of the track, then by place."""
            for hu, u, v in sorted((root.get(hu, hu), u, v) for hu, u, v in waiting):
                if ("u", u) not in used and ("v", v) not in used:
                    used.update((("u", u), ("v", v)))
                    root[v] = hu
                    out.append((at[0], u, v))
            waiting.clear()

        for pdf in batches:
            out: list = []
            for stream, group, t, iou, hu, u, v in pdf[["stream_id", "group", "t", "iou", "hu", "u", "v"]].itertuples(index=False):
                if at != (stream, group, t, iou):
                    settle(out)
                    if at is not None and at[:2] != (stream, group):
                        root, used = {}, set()
                    at = (stream, group, t, iou)
                waiting.append((hu, u, v))
            yield pd.DataFrame(out, columns=["stream_id", "u", "v"])
        out = []
        settle(out)
        yield pd.DataFrame(out, columns=["stream_id", "u", "v"])

    return dealt.mapInPandas(walk, f"stream_id {key_type}, u bigint, v bigint")


def track_frames(frames: DataFrame, rules: TrackRules = TrackRules()) -> DataFrame:
    """Batch twin of :func:`track_stream` (without rate): the same tracks, identifiers and save decisions.

    No stream is walked frame by frame. Detections that can follow each other are matched (:func:`matched`); a track is a
    chain of them, and its age comes from list ranking. It is written down for every frame from one detection to the
    next, or until it is forgotten. Tracks are numbered by their first detections.
    """
    scored = pin(number_scored(frames, rules))
    detections = pin(detection_rows(scored))
    taken = pin(matched(overlaps(detections, rules)))
    back = detections.select("stream_id", "id").join(taken.select("stream_id", F.col("v").alias("id"), F.col("u").alias("to")), ["stream_id", "id"], "left")
    chains = pin(chain_ranks(back, ["stream_id"]).select("stream_id", "id", F.col("rank").alias("hits"), F.col("end").alias("root")))
    names = number_rows(chains.where("id = root").select("stream_id", "root"), ["stream_id"], ["root"], "track_id")
    following = taken.select("stream_id", F.col("u").alias("id"), F.shiftright("v", 24).alias("_next"))
    ends = scored.groupBy("stream_id").agg(F.max("infer_idx").alias("_last"))
    last_seen = F.least(F.col("_last"), F.col("t") + rules.max_miss, F.coalesce(F.col("_next") - 1, F.col("_last")))
    held = (detections.join(chains, ["stream_id", "id"]).join(names, ["stream_id", "root"]).join(following, ["stream_id", "id"], "left")
            .join(ends, "stream_id").withColumn("infer_idx", F.explode(F.sequence(F.col("t"), last_seen))))
    held = held.withColumn("miss", F.col("infer_idx") - F.col("t"))
    lasting = (F.col("hits") >= rules.persist) & (F.col("miss") == 0)
    rows = held.select("stream_id", "infer_idx", "track_id", *[F.col(f"d.{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "poly")], "hits", "miss",
                       F.col("t").alias("last_infer"), lasting.alias("persistent"))
    saves = save_decisions(chains.where(F.col("hits") >= rules.persist).select(
        "stream_id", F.shiftright("id", 24).alias("infer_idx")).distinct(), rules.cooldown)
    return (rows.join(scored.select("stream_id", "infer_idx", "frame_idx"), ["stream_id", "infer_idx"])
            .join(saves, ["stream_id", "infer_idx"], "left")
            .select("stream_id", "frame_idx", "infer_idx", "track_id", "x0", "y0", "x1", "y1", "poly", "hits", "miss", "last_infer", "persistent",
                    F.coalesce("save", F.lit(False)).alias("save")))


def save_decisions(candidates: DataFrame, cooldown: int) -> DataFrame:
    """Which candidate steps are saved: the first, then every one at least ``cooldown`` steps after the last saved one.

    After a saved candidate comes the first one ``cooldown`` or more steps on, which is found among the candidates of one
    stretch of ``cooldown`` steps, or else is the first of the next stretch that has any. The saved ones are those on the
    way from a first candidate, and from every candidate so late after its predecessor that it is saved in any case.
    """
    width = max(1, cooldown)
    stretch = F.floor(F.col("infer_idx") / width)
    points = pin(candidates.select("stream_id", "infer_idx").withColumn("_s", stretch))
    firsts = number_rows(points.groupBy("stream_id", "_s").agg(F.min("infer_idx").alias("_first"), F.max("infer_idx").alias("_end")),
                         ["stream_id"], ["_s"], "_n")
    firsts = pin(firsts)

    def shifted(by: int, first: str, s: str) -> DataFrame:
        return firsts.select("stream_id", (F.col("_n") - by).alias("_n"), F.col("_first").alias(first), F.col("_s").alias(s), F.col("_end").alias(f"{first}_end"))

    around = (firsts.join(shifted(1, "_a", "_as"), ["stream_id", "_n"], "left").join(shifted(2, "_b", "_bs"), ["stream_id", "_n"], "left")
              .join(shifted(-1, "_p", "_ps").select("stream_id", "_n", "_p_end"), ["stream_id", "_n"], "left")
              .select("stream_id", "_s", F.when(F.col("_as") == F.col("_s") + 1, F.col("_b")).otherwise(F.col("_a")).alias("_else"), "_p_end"))
    none = F.lit(None).cast("bigint")
    asked = points.select("stream_id", (F.col("infer_idx") + width).alias("_at"), (F.col("_s") + 1).alias("_s"), F.col("infer_idx").alias("_of"), none.alias("_is"))
    there = points.select("stream_id", F.col("infer_idx").alias("_at"), "_s", none.alias("_of"), F.col("infer_idx").cast("bigint").alias("_is"))
    in_stretch = W.partitionBy("stream_id", "_s").orderBy("_at")
    seen = asked.unionByName(there).withColumns({
        "_to": F.min("_is").over(in_stretch.rangeBetween(W.currentRow, W.unboundedFollowing)),
        "_prior": F.max("_is").over(in_stretch.rangeBetween(W.unboundedPreceding, -1))})
    to = seen.where("_of is not null").select("stream_id", F.col("_of").alias("infer_idx"), F.col("_to"))
    prior = seen.where("_is is not null").select("stream_id", F.col("_is").alias("infer_idx"), F.col("_prior"))
    steps = pin(points.join(to, ["stream_id", "infer_idx"]).join(prior, ["stream_id", "infer_idx"]).join(around, ["stream_id", "_s"]).select(
        "stream_id", F.col("infer_idx").alias("id"), F.coalesce("_to", "_else").alias("to"),
        F.coalesce(F.col("infer_idx") - F.coalesce("_prior", "_p_end") >= cooldown, F.lit(True)).alias("_fresh")))
    starts = steps.where("_fresh").select("stream_id", "id")
    further = steps.join(starts.withColumnRenamed("id", "to"), ["stream_id", "to"], "left_anti").select("stream_id", "id", "to")
    saved = reached(further, starts, ["stream_id"]).select("stream_id", F.col("id").alias("infer_idx"), F.lit(True).alias("save"))
    return candidates.join(saved, ["stream_id", "infer_idx"], "left").select("stream_id", "infer_idx", F.coalesce("save", F.lit(False)).alias("save"))
