"""Training metrics from cells and steps."""

from pyspark.sql import functions as F

from tilewright.operators import metrics as M
from tilewright.plans import fixtures as X

QUERIES, ORACLES = {}, {}
TIE = 3.14159e-10  # off any decimal grid, so that no value rounds by its last bit


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c) + TIE, digits) for c in cols})


QUERIES["seg_metrics"] = lambda s, d: _round(M.segmentation_metrics(X.logit_cells(s, d)), "soft_iou", "pos_iou", "neg_fp_rate")
ORACLES["seg_metrics"] = X.with_sql("logit_cells") + """,
s as (select batch, sample, sum(p * target) as i, sum(p + target - p * target) as u, sum(target) as t, max(case when p > 0.5 then 1 else 0 end) as hit from probs group by 1, 2)
select batch, round(avg(i / (u + 1e-7)) filter (u > 1e-7) + 3.14159e-10::double, 6) as soft_iou, round(avg(i / (u + 1e-7)) filter (t > 0) + 3.14159e-10::double, 6) as pos_iou,
  round(avg(hit) filter (t = 0) + 3.14159e-10::double, 6) as neg_fp_rate from s group by 1"""

QUERIES["hard_mask_iou"] = lambda s, d: _round(M.hard_mask_iou(X.logit_cells(s, d)), "mask_iou")
ORACLES["hard_mask_iou"] = X.with_sql("logit_cells") + """,
s as (select batch, sample, count(*) filter (p > 0.5 and target = 1) as i, count(*) filter (p > 0.5 or target = 1) as u from probs group by 1, 2)
select batch, round(avg(i / (u + 1e-7)) + 3.14159e-10::double, 6) as mask_iou from s group by 1"""

_MCC = """,
q as (select batch, sample, sum(p * target) as tp, sum((1 - p) * (1 - target)) as tn, sum(p * (1 - target)) as fp_, sum((1 - p) * target) as fn from probs group by 1, 2),
mcc as (select batch, 1 - avg((tp * tn - fp_ * fn) / (sqrt((tp + fp_) * (tp + fn) * (tn + fp_) * (tn + fn) + 1e-7) + 1e-7)) as mcc_loss from q group by 1)"""
QUERIES["mcc"] = lambda s, d: _round(M.mcc_loss(X.logit_cells(s, d)), "mcc_loss")
ORACLES["mcc"] = X.with_sql("logit_cells") + _MCC + "select batch, round(mcc_loss + 3.14159e-10::double, 6) as mcc_loss from mcc"

_BOUNDARY = """,
near as (select a.batch, a.sample, a.gy, a.gx, any_value(a.bce) as bce, least(1, max(b.p) - min(b.p)) as bp, least(1, max(b.target) - min(b.target)) as bt
  from probs a join (select *, unnest([-1, 0, 1]) as dy from probs) b on a.sample = b.sample and a.gy = b.gy + b.dy and b.gx between a.gx - 1 and a.gx + 1
  group by 1, 2, 3, 4),
pix as (select batch, avg(bce) as bce, avg(-(bt * greatest(case when bp > 0 then ln(bp) else -100 end, -100)
  + (1 - bt) * greatest(case when bp < 1 then ln(1 - bp) else -100 end, -100))) as boundary from near group by 1)"""
QUERIES["bce_boundary"] = lambda s, d: _round(M.pixel_losses(X.logit_cells(s, d)), "bce", "boundary")
ORACLES["bce_boundary"] = X.with_sql("logit_cells") + _BOUNDARY + "select batch, round(bce + 3.14159e-10::double, 6) as bce, round(boundary + 3.14159e-10::double, 6) as boundary from pix"

QUERIES["weighted_total"] = lambda s, d: _round(M.weighted_total(X.logit_cells(s, d), 1.0, 0.5, 0.25).select("batch", "total"), "total")
ORACLES["weighted_total"] = X.with_sql("logit_cells") + _MCC + _BOUNDARY + """
select batch, round(mcc_loss + 0.5 * bce + 0.25 * boundary + 3.14159e-10::double, 6) as total from mcc join pix using (batch)"""

QUERIES["fp_terms"] = lambda s, d: _round(M.fp_terms(X.logit_cells(s, d)), "fp_activation", "fp_suppression")
ORACLES["fp_terms"] = X.with_sql("logit_cells") + """
select batch, round(avg(p) filter (fp > 0.5) + 3.14159e-10::double, 6) as fp_activation, round(avg(greatest(logit, 0) + ln(1 + exp(-abs(logit)))) filter (fp > 0.5) + 3.14159e-10::double, 6) as fp_suppression
from probs group by 1"""

QUERIES["tile_cls_bce"] = lambda s, d: _round(M.cls_loss(
    X.table(s, d, "orders").selectExpr("o_orderkey div 16 as batch", "cast((o_orderkey * 13 % 400 - 200) / 50.0D as double) as z",
                                       "o_orderkey % 2 as t"), "z", "t"), "cls_bce")
ORACLES["tile_cls_bce"] = """
with r as (select o_orderkey // 16 as batch, (o_orderkey * 13 % 400 - 200) / 50.0::double as z, o_orderkey % 2 as t from orders)
select batch, round(avg(greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))) + 3.14159e-10::double, 6) as cls_bce from r group by 1"""

QUERIES["hard_scores"] = lambda s, d: _round(M.hard_scores(X.logit_cells(s, d)), "score")
ORACLES["hard_scores"] = X.with_sql("logit_cells") + """
select sample, round(max(p) + 3.14159e-10::double, 6) as score from probs group by 1 having max(target) = 0"""

QUERIES["epoch_rollup"] = lambda s, d: _round(M.epoch_rollup(X.steps(s, d)), "train_total", "train_fp_sup", "train_soft_iou", "val_total", "val_fp_sup", "val_soft_iou")
ORACLES["epoch_rollup"] = X.with_sql("steps") + """
select run, epoch::int as epoch, """ + ", ".join(
    f"round(avg({m}) filter (split = '{p}') + 1e-9::double + 3.14159e-10::double, 6) as {p}_{m}" for p in ("train", "val") for m in ("total", "fp_sup", "soft_iou")) + """,
  count(*) filter (split = 'train') as train_steps, count(*) filter (split = 'val') as val_steps from steps group by 1, 2"""

QUERIES["best_epoch"] = lambda s, d: _round(M.best_epoch(M.epoch_rollup(X.steps(s, d)), "val_soft_iou", 2), "best_value")
ORACLES["best_epoch"] = X.with_sql("steps") + """,
e as (select run, epoch::int as epoch, avg(soft_iou) filter (split = 'val') as v from steps group by 1, 2)
select run, epoch as best_epoch, round(v + 3.14159e-10::double, 6) as best_value from e where epoch % 2 = 0 and v is not null
qualify row_number() over (partition by run order by v desc, epoch) = 1"""


def resumed_history(s, d):
    epochs = M.epoch_rollup(X.steps(s, d)).select("run", "epoch", "train_steps")
    return M.append_resumed_history(epochs, epochs.select("run", "epoch", (F.col("train_steps") + 1000).alias("train_steps")))


QUERIES["resumed_history"] = resumed_history
ORACLES["resumed_history"] = X.with_sql("steps") + """,
e as (select run, epoch::int as epoch, count(*) filter (split = 'train') as train_steps from steps group by 1, 2)
select * from e union all select run, (epoch + max(epoch) over (partition by run))::int, train_steps + 1000 from e"""

QUERIES["step_series"] = lambda s, d: M.step_series(X.steps(s, d)).select("run", "split", "epoch", "step", "global_step")
ORACLES["step_series"] = X.with_sql("steps") + """
select run, split, epoch::int as epoch, step, row_number() over (partition by run, split order by epoch, step) - 1 as global_step from steps"""
