"""The whole way from raw sources to a labelled matrix, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidefuse.operators import faults, features, fill, matrix, rollup
from tidefuse.operators.align import align, is_numeric, metric_types, time_span
from tidefuse.operators.blocks import DEFAULT_BLOCK_SLOTS


def fused_series(
    devices: DataFrame | None = None,
    hosts: DataFrame | None = None,
    records: DataFrame | None = None,
    order: str = "line_no",
    granularity: float = 1.0,
    event_fill: str = "zero",
    block_slots: int = DEFAULT_BLOCK_SLOTS,
    device_ids: int | None = None,
    method: str = "forward",
    rolling: Sequence[str] = (),
    window: float = 300.0,
) -> DataFrame:
    """Rolled up, aligned, filled and derived series of the sources that are given.

    ``method`` fills numbers forward, or on a straight line between their neighbours
    (``linear``). ``rolling`` columns get mean, deviation and rate of change over
    the last ``window`` seconds.
    """
    if method not in ("forward", "linear"):
        raise ValueError("method is 'forward' or 'linear'")
    sources = []
    if devices is not None:
        sources.append(rollup.device_rollup(devices, device_ids))
    if hosts is not None:
        sources.append(rollup.host_samples(hosts))
    if records is not None:
        sources.append(rollup.training_rollup(records, order))
    span = time_span([s for s in (devices, hosts, records) if s is not None])
    if method == "forward":
        dense = features.fuse_derived(sources, granularity, event_fill, block_slots, span)
    else:
        grid = align(sources, granularity, block_slots, span)
        numbers = [c for c, t in metric_types(grid).items() if is_numeric(t) and not fill.is_event(c)]
        straight = fill.interpolate_linear(grid, numbers, granularity, block_slots)
        dense = fill.fill_missing(straight, granularity, event_fill, block_slots)
    series = features.add_derived(dense, granularity, block_slots)
    return features.rolling_features(series, rolling, granularity, window, block_slots) if rolling else series


def labelled_matrix(
    devices: DataFrame | None = None,
    hosts: DataFrame | None = None,
    records: DataFrame | None = None,
    windows: DataFrame | None = None,
    margins: tuple[float, float] = (0.0, 0.0),
    **choices: object,
) -> DataFrame:
    """Feature matrix with ``is_anomaly`` from fault windows and events.

    ``margins`` are the seconds before and after a fault that count too; further
    choices are those of ``fused_series``.
    """
    series = fused_series(devices, hosts, records, **choices)
    if windows is not None and any(margins):
        windows = faults.widen(windows, *margins)
    return matrix.build_matrix(series, windows)
