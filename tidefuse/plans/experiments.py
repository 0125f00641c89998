"""Experiment plans as tables: combine, filter, update, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN_SCHEMA = (
    "plan_name string, created_time string, total_experiments int, experiment_combinations array<struct<"
    "experiment_id string, model_config struct<model_type string, model_name string>,"
    "dataset_config struct<dataset_type string, split_sizes struct<train int, test int>>,"
    "fault_config struct<enabled boolean, fault_type string,"
    "injection_schedule array<struct<fault_type string, delay double, duration double>>>,"
    "status string, start_time string, end_time string,"
    "results struct<success boolean, duration double, anomaly_count bigint,"
    "training_results struct<final_accuracy double>>>>"
)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan files to one row per combination."""
    plans = spark.read.schema(PLAN_SCHEMA).option("multiLine", True).json(path)
    return plan_rows(plans)


def plan_rows(plans: DataFrame) -> DataFrame:
    e = F.col("_e")
    return plans.select("plan_name", F.explode("experiment_combinations").alias("_e")).select(
        "plan_name", e["experiment_id"].alias("experiment_id"),
        e["model_config"]["model_type"].alias("model_type"),
        e["model_config"]["model_name"].alias("model_name"),
        e["dataset_config"]["dataset_type"].alias("dataset_type"),
        F.coalesce(e["fault_config"]["fault_type"], F.lit("baseline")).alias("fault_type"),
        e["status"].alias("status"),
        e["results"]["success"].alias("success"), e["results"]["duration"].alias("duration"),
        e["results"]["anomaly_count"].alias("anomaly_count"),
        e["results"]["training_results"]["final_accuracy"].alias("final_accuracy"),
    )


def combine(models: DataFrame, datasets: Sequence[str], faults: Sequence[str]) -> DataFrame:
    """Every model with every dataset and fault of the plan, all pending.

    Datasets and faults are short lists of the plan itself, so each model row
    unfolds in place and nothing is joined.
    """
    unfolded = models.select("*", F.explode(F.array(*map(F.lit, datasets))).alias("dataset_type"))
    unfolded = unfolded.select("*", F.explode(F.array(*map(F.lit, faults))).alias("fault_type"))
    return unfolded.select(
        F.concat_ws("_", "model_name", "dataset_type", "fault_type").alias("experiment_id"),
        "model_type", "model_name", "dataset_type", "fault_type",
        F.lit("pending").alias("status"),
    )


def to_run(plan: DataFrame, skip_completed: bool = True) -> DataFrame:
    open_runs = F.coalesce(F.col("status") != "completed", F.lit(True))
    return plan.where(open_runs) if skip_completed else plan


def update(plan: DataFrame, results: DataFrame, order: str = "end_time") -> DataFrame:
    """Fold results into the plan by experiment id; others keep their status.

    Of several results of one experiment that with the greatest ``order`` counts, a missing
    order coming first; of equal ones the greatest by its columns, so that the result does
    not depend on how rows are stored. Neither side is broadcast: plan and results grow with
    the models, and the planner's estimate of an unfolded plan leaves out the unfolding.
    """
    if order not in results.columns:
        raise ValueError(f"results lack the column {order}, which says what the last result is")
    outcome = [c for c in results.columns if c != "experiment_id"]
    outcome.sort(key=lambda c: c != order)
    last = results.groupBy("experiment_id").agg(F.max(F.struct(*outcome)).alias("_last"))
    results = last.select("experiment_id", *[F.col("_last")[c].alias(c) for c in outcome])
    kept = plan.select(*[c for c in plan.columns if c not in outcome])
    joined = kept.hint("merge").join(results, "experiment_id", "left")
    status = (
        F.when(F.col("success"), F.lit("completed")).when(~F.col("success"), F.lit("failed"))
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status)


def _counted(hit: Column, name: str) -> Column:
    return F.count_if(hit).alias(name)


def report(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by status, success rate and means over successful runs (0 if none)."""
    done = F.col("status") == "completed"
    good = done & F.col("success")
    zero = F.lit(0.0)
    return (
        plan.groupBy(*keys).agg(
            F.count("*").alias("total_experiments"), _counted(done, "completed"),
            _counted(F.col("status") == "failed", "failed"),
            F.coalesce(F.avg(F.when(good, F.col("duration"))), zero).alias("average_duration"),
            F.coalesce(F.sum(F.when(good, F.col("anomaly_count"))), F.lit(0)).alias("total_anomalies"),
            F.coalesce(
                F.avg(F.when(good, F.coalesce(F.col("final_accuracy"), zero))), zero
            ).alias("average_accuracy"),
        )
        .withColumn("pending", F.col("total_experiments") - F.col("completed") - F.col("failed"))
        .withColumn("success_rate", F.coalesce(
            F.try_divide(F.col("completed").cast("double"), F.col("total_experiments").cast("double")), zero))
    )


def model_performance(plan: DataFrame) -> DataFrame:
    good = (F.col("status") == "completed") & F.col("success")
    return plan.where(good).groupBy("model_type").agg(
        F.avg("final_accuracy").alias("average_accuracy"),
        F.stddev_pop("final_accuracy").alias("std_accuracy"),
        F.count("*").alias("n"),
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Models and training time by success; the model lists stay rows of ``outcomes``."""
    return outcomes.groupBy("success").agg(
        F.count("*").alias("models"),
        F.sum(F.when(F.col("success"), F.coalesce("training_time", F.lit(0.0))).otherwise(F.lit(0.0)))
        .alias("total_training_time"),
    )

