"""Training histories: losses by epoch, the best rate so far, patience."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def training_curve(steps: DataFrame, evaluations: DataFrame, run: str = "run") -> DataFrame:
    """(run, epoch, mean_loss, rate, best, stale): mean loss of each epoch's steps, the least rate so far and
    for how many epochs it has not improved."""
    loss = steps.groupBy(run, "epoch").agg(F.avg("loss").alias("mean_loss"))
    w = Window.partitionBy(run).orderBy("epoch")
    e = loss.join(evaluations.select(run, "epoch", "rate"), [run, "epoch"]).withColumn("best", F.min("rate").over(w))
    last = F.last(F.when(F.col("_better"), F.col("epoch")), ignorenulls=True).over(w)
    before = F.min("rate").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("_better", before.isNull() | (F.col("rate") < before)).withColumn("stale", (F.col("epoch") - last).cast("int")).drop("_better")


def stopped_at(curve: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """(run, epoch): the first epoch at which patience is used up."""
    return curve.where(F.col("stale") >= patience).groupBy(run).agg(F.min("epoch").alias("epoch"))
