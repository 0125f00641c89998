"""The feature matrix: selected columns, cleaned, with its label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.functions.timeops import SECOND, micros
from tidefuse.operators.fill import is_event
from tidefuse.operators.labels import label_points

# Prefixes and derived columns that make up the matrix.
PREFIXES = ("gpu_", "sys_", "train_", "eval_")
DERIVED = (
    "gpu_memory_utilization_ratio", "train_step_rate", "train_loss_change_rate",
    "train_loss_moving_avg", "total_anomaly_events", "elapsed_seconds",
)
ROLLED = ("_moving_average", "_standard_deviation", "_rate_of_change")
KEYS = ("run_id", "timestamp")


def feature_names(df: DataFrame) -> list[str]:
    """Numeric columns by prefix, all events, derived columns; each once."""
    types = dict(df.dtypes)
    wide = ("int", "bigint", "float", "double")
    picked = [c for p in PREFIXES for c in df.columns if c.startswith(p) and types[c] in wide]
    picked += [c for c in df.columns if is_event(c)]
    picked += [c for c in df.columns if c in DERIVED or c.endswith(ROLLED)]
    return list(dict.fromkeys(picked))


def clean_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN, infinite and missing numbers become 0."""
    types = dict(df.dtypes)
    infinite = "abs(`{0}`) = double('infinity')"
    cells = []
    for c in df.columns:
        if c not in columns:
            cells.append(f"`{c}`")
        elif types[c] in ("float", "double"):
            bad = f"`{c}` IS NULL OR isnan(`{c}`) OR {infinite.format(c)}"
            cells.append(f"CASE WHEN {bad} THEN CAST(0 AS {types[c]}) ELSE `{c}` END AS `{c}`")
        else:
            cells.append(f"coalesce(`{c}`, CAST(0 AS {types[c]})) AS `{c}`")
    return df.selectExpr(*cells)


def clean_values(df: DataFrame) -> DataFrame:
    """Clean every number, and make missing texts empty."""
    types = dict(df.dtypes)
    numbers = [c for c, t in types.items() if t in ("int", "bigint", "float", "double", "smallint", "tinyint")]
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c, t in types.items() if t == "string"}
    cleaned = clean_numbers(df, numbers)
    return cleaned.withColumns(texts) if texts else cleaned


def build_matrix(series: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Keys, features and ``is_anomaly`` in one row per point."""
    features = feature_names(series)
    labelled = label_points(series, windows)
    return clean_numbers(labelled, features).select(*KEYS, *features, "is_anomaly")


def matrix_stats(matrix: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mean, sample deviation, extremes and missing count per feature, one pass."""
    columns = [c for c in matrix.columns if c not in (*KEYS, "is_anomaly")]
    parts = []
    for c in columns:
        v = f"CAST(`{c}` AS DOUBLE)"
        parts += [F.expr(f"{call} AS `{c}|{name}`") for name, call in (
            ("mean", f"avg({v})"), ("std", f"stddev_samp({v})"), ("min", f"min({v})"),
            ("max", f"max({v})"), ("missing", f"count_if({v} IS NULL)"),
        )]
    wide = matrix.groupBy(*keys).agg(*parts)
    fields = ("mean", "std", "min", "max", "missing")
    long = ", ".join(
        f"struct('{c}' AS feature, {', '.join(f'`{c}|{f}` AS {f}' for f in fields)})" for c in columns
    )
    return wide.selectExpr(*keys, f"inline(array({long}))")


def matrix_metadata(matrix: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Size, label balance and time range per run."""
    features = [c for c in matrix.columns if c not in (*KEYS, "is_anomaly")]
    duration = (micros(F.max("timestamp")) - micros(F.min("timestamp"))) / F.lit(float(SECOND))
    return matrix.groupBy(*keys).agg(
        F.count("*").alias("total_records"),
        F.lit(len(features)).alias("total_features"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomaly_count"),
        F.count_if(F.col("is_anomaly") == 0).alias("normal_count"),
        F.avg("is_anomaly").alias("anomaly_ratio"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        duration.alias("duration_seconds"),
    )


def save_matrix(matrix: DataFrame, path: str) -> None:
    """Matrix with labels, partitioned by run; a hot run is split over several files."""
    matrix.hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(
        f"{path}/matrix"
    )
    stored = matrix.sparkSession.read.parquet(f"{path}/matrix")
    matrix_metadata(stored).write.mode("overwrite").parquet(f"{path}/metadata")
