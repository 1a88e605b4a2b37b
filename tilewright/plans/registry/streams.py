"""Tracks over frame streams, as batch twins of the streaming operators."""

from pyspark.sql import functions as F

from tilewright.plans import fixtures as X
from tilewright.streaming import tracks as TR

QUERIES, ORACLES = {}, {}
RULES = TR.TrackRules()

QUERIES["infer_index"] = lambda s, d: TR.number_scored(X.frames(s, d), RULES).select("stream_id", "frame_idx", "infer_idx")
_SCORED = """
with g as (select user_id as stream_id, event_id as frame_idx, event_type = 'error' as empty from events
  qualify event_id % 2 = 0 or row_number() over (partition by user_id order by event_id) = 1),
sc as (select *, row_number() over (partition by stream_id order by frame_idx) as infer_idx from g)"""
ORACLES["infer_index"] = _SCORED + "select stream_id, frame_idx, infer_idx from sc"

QUERIES["quiet_segments"] = lambda s, d: TR.quiet_segments(TR.number_scored(X.frames(s, d), RULES), RULES).select(
    "stream_id", "infer_idx", "segment")
ORACLES["quiet_segments"] = _SCORED + """,
c as (select *, case when lag(empty) over w and lag(empty, 2) over w then 1 else 0 end as cut from sc window w as (partition by stream_id order by infer_idx))
select stream_id, infer_idx, sum(cut) over (partition by stream_id order by infer_idx)::bigint as segment from c"""


COLUMNS = ("stream_id", "frame_idx", "infer_idx", "track_id", "hits", "miss", "last_infer", "persistent", "save", "x0")


def tracks(s, d):
    return TR.track_frames(X.frames(s, d), RULES).select(*COLUMNS)


def jumping(s, d):
    """The same streams with boxes that often move too far to be matched, so that several tracks wait for a box."""
    place = (F.col("frame_idx") * 7 + F.size("detections")) % 61 - (F.col("frame_idx") * 3) % 17
    moved = X.frames(s, d).withColumn("detections", F.transform("detections", lambda b: F.struct(
        b["poly"].alias("poly"), place.cast("double").alias("x0"), b["y0"].alias("y0"), (place + 20).cast("double").alias("x1"), b["y1"].alias("y1"))))
    return TR.track_frames(moved, TR.TrackRules(max_miss=3, persist=2)).select(*COLUMNS)


def fold_sql(place, max_miss, persist):
    """The rules step by step: the tracks of a stream after each scored frame, as a list."""
    return f"""
with recursive g as (select user_id as stream_id, event_id as frame_idx, event_type = 'error' as empty, ({place})::double as x from events
  qualify event_id % 2 = 0 or row_number() over (partition by user_id order by event_id) = 1),
sc as (select *, row_number() over (partition by stream_id order by frame_idx) as infer_idx from g),
fold as (select stream_id, 0::bigint as n, []::struct(id bigint, x double, hits bigint, miss bigint, seen bigint)[] as ts, 0::bigint as ids
    from (select distinct stream_id from sc)
  union all select stream_id, n + 1, list_concat(list_filter(list_transform(ts, lambda t, i: case when i = b
      then {{'id': t.id, 'x': x, 'hits': t.hits + 1, 'miss': 0::bigint, 'seen': n + 1}}
      else {{'id': t.id, 'x': t.x, 'hits': t.hits, 'miss': t.miss + 1, 'seen': t.seen}} end), lambda t: t.miss <= {max_miss}),
      case when b = 0 then [{{'id': ids + 1, 'x': x, 'hits': 1::bigint, 'miss': 0::bigint, 'seen': n + 1}}] else [] end),
    ids + (case when b = 0 then 1 else 0 end)
  from (select f.*, x, case when empty then null when list_max(ious) >= 0.25 then list_position(ious, list_max(ious)) else 0 end as b
    from (select fold.*, sc.x, sc.empty, list_transform(ts, lambda t: greatest(0, 20 - abs(t.x - sc.x)) * 20
        / (800 - greatest(0, 20 - abs(t.x - sc.x)) * 20)) as ious from fold join sc on sc.stream_id = fold.stream_id and sc.infer_idx = n + 1) f)),
each as (select stream_id, n as infer_idx, unnest(ts) as t from fold),
rows as (select stream_id, frame_idx, infer_idx, t.id as track_id, t.hits as hits, t.miss as miss, t.seen as last_infer,
  t.hits >= {persist} and t.miss = 0 as persistent, t.x as x0 from each join sc using (stream_id, infer_idx)),
due as (select stream_id, infer_idx, row_number() over (partition by stream_id order by infer_idx) as n
  from (select distinct stream_id, infer_idx from rows where persistent)),
kept as (select stream_id, infer_idx, n, infer_idx as last, true as save from due where n = 1
  union all select d.stream_id, d.infer_idx, d.n, case when d.infer_idx - last >= 8 then d.infer_idx else last end, d.infer_idx - last >= 8
  from kept k join due d on d.stream_id = k.stream_id and d.n = k.n + 1)
select rows.*, coalesce(save, false) as save from rows left join kept using (stream_id, infer_idx)"""


_TRACKS = fold_sql("(user_id * 13) % 500 + floor(value)::bigint % 8", 1, 3)
QUERIES["tracks"] = tracks
ORACLES["tracks"] = _TRACKS
QUERIES["persistent_tracks"] = lambda s, d: TR.persistent_tracks(tracks(s, d))
ORACLES["persistent_tracks"] = _TRACKS + " where persistent"
QUERIES["tracks_jumping"] = jumping
ORACLES["tracks_jumping"] = fold_sql("(event_id * 7 + 1) % 61 - (event_id * 3) % 17", 3, 2)


def saves(s, d):
    """Save decisions over every scored frame that has detections."""
    scored = TR.number_scored(X.frames(s, d), RULES)
    return TR.save_decisions(scored.where(F.size("detections") > 0).select("stream_id", "infer_idx"), 3)


QUERIES["auto_save"] = saves
ORACLES["auto_save"] = _SCORED.replace("with ", "with recursive ", 1) + """,
c as (select stream_id, infer_idx, row_number() over (partition by stream_id order by infer_idx) as n from sc where not empty),
w as (select stream_id, infer_idx, n, infer_idx as last, true as save from c where n = 1
  union all select c.stream_id, c.infer_idx, c.n, case when c.infer_idx - last >= 3 then c.infer_idx else last end, c.infer_idx - last >= 3
  from w join c on c.stream_id = w.stream_id and c.n = w.n + 1)
select stream_id, infer_idx, save from w"""
