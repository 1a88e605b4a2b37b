"""Training metrics from cell tables and from step tables.

Cell tables have ``batch, sample, gy, gx, logit, target`` and, for false-positive terms, ``fp``. Sums are taken per
sample first, so both levels aggregate partially before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.functions.geometry import sigmoid
from tilewright.operators.grids import boundary_maps
from tilewright.operators.ranking import number_rows
from tilewright.schema import STEP_METRICS

EPS = 1e-7


def logistic_loss(logit: Column, target: Column) -> Column:
    """Binary cross entropy on a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def probability_loss(prob: Column, target: Column) -> Column:
    """Binary cross entropy on a probability; logarithms stop at −100."""
    def safe_log(v: Column) -> Column:
        return F.when(v > 0, F.greatest(F.log(F.when(v > 0, v)), F.lit(-100.0))).otherwise(F.lit(-100.0))

    return -(target * safe_log(prob) + (1 - target) * safe_log(1 - prob))


def segmentation_metrics(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per batch: soft IoU over samples with a union, IoU over positive samples, share of negatives with a hit above
    the threshold."""
    p, t = sigmoid(F.col("logit")), F.col("target").cast("double")
    per = cells.groupBy("batch", "sample").agg(
        F.sum(p * t).alias("_i"), F.sum(p + t - p * t).alias("_u"), F.sum(t).alias("_t"),
        F.max((p > threshold).cast("int")).alias("_hit"))
    iou, pos = F.col("_i") / (F.col("_u") + EPS), F.col("_t") > 0
    return per.groupBy("batch").agg(
        F.avg(F.when(F.col("_u") > EPS, iou)).alias("soft_iou"), F.avg(F.when(pos, iou)).alias("pos_iou"),
        F.avg(F.when(~pos, F.col("_hit").cast("double"))).alias("neg_fp_rate"))


def hard_mask_iou(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per batch: mean IoU of thresholded masks; an empty union counts as 0."""
    p, t = (sigmoid(F.col("logit")) > threshold).cast("double"), F.col("target").cast("double")
    per = cells.groupBy("batch", "sample").agg(F.sum(p * t).alias("_i"), F.sum(F.greatest(p, t)).alias("_u"))
    return per.groupBy("batch").agg(F.avg(F.col("_i") / (F.col("_u") + EPS)).alias("mask_iou"))


def mcc_loss(cells: DataFrame) -> DataFrame:
    """Per batch: one minus the mean soft Matthews correlation of its samples."""
    p, t = sigmoid(F.col("logit")), F.col("target").cast("double")
    per = cells.groupBy("batch", "sample").agg(
        F.sum(p * t).alias("tp"), F.sum((1 - p) * (1 - t)).alias("tn"), F.sum(p * (1 - t)).alias("fp"),
        F.sum((1 - p) * t).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    mcc = (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + EPS) + EPS)
    return per.groupBy("batch").agg((F.lit(1.0) - F.avg(mcc)).alias("mcc_loss"))


def pixel_losses(cells: DataFrame) -> DataFrame:
    """Per batch: mean logistic loss, and the loss between the boundary maps of prediction and target.

    Cells must be dense per sample.
    """
    p, t = sigmoid(F.col("logit")), F.col("target").cast("double")
    base = cells.select("batch", "sample", F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), "logit",
                        t.alias("target"), p.alias("prob"))
    keys = ["batch", "sample"]
    edges = boundary_maps(base, keys, {"_bp": "prob", "_bt": "target"})
    return edges.groupBy("batch").agg(
        F.avg(logistic_loss(F.col("logit"), F.col("target"))).alias("bce"),
        F.avg(probability_loss(F.col("_bp"), F.col("_bt"))).alias("boundary"))


def weighted_total(cells: DataFrame, mcc_weight: float = 1.0, bce_weight: float = 1.0,
                   boundary_weight: float = 1.0) -> DataFrame:
    """Per batch: the three segmentation losses and their weighted sum."""
    both = mcc_loss(cells).join(pixel_losses(cells), "batch")
    return both.withColumn("total", mcc_weight * F.col("mcc_loss") + bce_weight * F.col("bce")
                           + boundary_weight * F.col("boundary"))


def fp_terms(cells: DataFrame) -> DataFrame:
    """Per batch: mean probability on false-positive cells and the loss that pushes it to 0; NULL without such cells."""
    on = F.col("fp") > 0.5
    return cells.groupBy("batch").agg(
        F.avg(F.when(on, sigmoid(F.col("logit")))).alias("fp_activation"),
        F.avg(F.when(on, logistic_loss(F.col("logit"), F.lit(0.0)))).alias("fp_suppression"))


def cls_loss(rows: DataFrame, logit: str, target: str, keys: Sequence[str] = ("batch",),
             name: str = "cls_bce") -> DataFrame:
    """Mean logistic loss of tile or zoom logits."""
    return rows.groupBy(*keys).agg(F.avg(logistic_loss(F.col(logit), F.col(target).cast("double"))).alias(name))


def hard_scores(cells: DataFrame) -> DataFrame:
    """Highest probability of each sample without a positive cell."""
    per = cells.groupBy("sample").agg(F.max(F.col("target").cast("double")).alias("_t"),
                                      F.max(sigmoid(F.col("logit"))).alias("score"))
    return per.where(F.col("_t") == 0).select("sample", "score")


def epoch_rollup(steps: DataFrame) -> DataFrame:
    """Mean of each step metric per run and epoch, training and validation side by side. NULL steps are skipped."""
    aggs = []
    for split in ("train", "val"):
        here = F.col("split") == split
        aggs += [F.avg(F.when(here, F.col(m))).alias(f"{split}_{m}") for m in STEP_METRICS if m in steps.columns]
        aggs.append(F.count_if(here).alias(f"{split}_steps"))
    return steps.groupBy("run", "epoch").agg(*aggs)


def best_epoch(epochs: DataFrame, metric: str = "val_soft_iou", val_interval: int = 1) -> DataFrame:
    """Validated epoch with the highest metric per run, the earliest one on a tie."""
    validated = epochs.where((F.col("epoch") % val_interval == 0) & F.col(metric).isNotNull())
    return (validated.groupBy("run").agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("e"))).alias("_b"))
            .select("run", (-F.col("_b.e")).alias("best_epoch"), F.col("_b.m").alias("best_value")))


def append_resumed_history(history: DataFrame, resumed: DataFrame) -> DataFrame:
    """History of a run continued by a resumed one, whose epochs count on from the last loaded epoch."""
    last = history.groupBy("run").agg(F.max("epoch").alias("_last"))
    moved = (resumed.join(last, "run", "left")
             .withColumn("epoch", (F.col("epoch") + F.coalesce("_last", F.lit(0))).cast(history.schema["epoch"].dataType))
             .drop("_last"))
    return history.unionByName(moved, allowMissingColumns=True)


def step_series(steps: DataFrame) -> DataFrame:
    """Global step number per run and split."""
    return (number_rows(steps, ["run", "split"], ["epoch", "step"], "_rank")
            .withColumn("global_step", F.col("_rank") - 1).drop("_rank"))
