"""Log lines to columns: built-in regular expressions only, no Python per line."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.operators.blocks import BLOCK, range_blocks, scan, split_blocks
from tidefuse.sources.logs import LINE_ORDER

# The patterns of the log formats.
NUMBER = r"([\d\.\-e]+)"
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
STEP = r"Step\s+(\d+)\s*\|\s*Loss:\s*([\d\.\-e]+)\s*\|\s*LR:\s*([\d\.\-e]+)\s*\|\s*Throughput:\s*([\d\.\-e]+)\s*samples/s\s*\|\s*Step Time:\s*([\d\.\-e]+)s"
EVAL = r"eval_(\w+):\s*([\d\.\-e]+)"
NAN_LOSS = r"(?i)\[ANOMALY DETECTED\]\s*NaN/Inf Loss.*?step\s+(\d+).*?:\s*([\d\.\-e]*)"
HIGH_LOSS = r"(?i)\[ANOMALY DETECTED\]\s*High Loss.*?step\s+(\d+).*?:\s*([\d\.\-e]+)"
OUT_OF_MEMORY = r"(?i)(CUDA.*out of memory|OutOfMemoryError|\bOOM\b)"
OUT_OF_MEMORY_LOOSE = r"(?i)(CUDA.*out of memory|OutOfMemoryError|OOM)"
PHASES = (
    ("train_begin", r"(?i)训练开始|Training.*begin"),
    ("train_end", r"(?i)训练结束|Training.*end|Training.*complete"),
    ("eval_begin", r"(?i)评估.*开始|Evaluation.*begin"),
    ("eval_end", r"(?i)评估.*结束|Evaluation.*end"),
)
EVAL_METRICS = ("loss", "accuracy", "f1", "precision", "recall")
SIMPLE_LOSS = r"Loss:\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|nan)"
SIMPLE_ACCURACY = r"Accuracy:\s*([0-9]*\.?[0-9]+)"
SIMPLE_RATE = r"LR:\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
SIMPLE_STEP = r"Step\s*(\d+)"
SIMPLE_EPOCH = r"Epoch\s*(\d+)"

RECORD_COLUMNS = (
    "timestamp", "step", "loss", "learning_rate", "throughput", "step_time",
    "eval_loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall",
    "metric_type", "phase",
    "event_nan_loss", "event_oom", "event_high_loss", "event_error", "event_warning",
    "anomaly_type", "anomaly_step", "anomaly_value", "raw_line", "eval_metrics",
)


def group(line: Column, pattern: str, index: int = 1) -> Column:
    """Text of a group, null where the pattern or the group does not match."""
    text = F.regexp_extract(line, pattern, index)
    return F.when(text != "", text)


def line_timestamp(line: Column) -> Column:
    return F.regexp_replace(group(line, TIMESTAMP), r"\s+", " ").try_cast("timestamp_ntz")


def step_parts(line: Column) -> Column:
    """The texts of a step line's five fields, null where there is none.

    The long pattern is looked for in lines with a word that every match contains, and split once.
    """
    found = F.regexp_substr(F.when(line.contains("Throughput:"), line), F.lit(STEP))
    return F.split(F.regexp_replace(found, STEP, "$1|$2|$3|$4|$5"), r"\|")


def step_values(parts: Column) -> dict[str, Column]:
    """Step number and its four measures from ``step_parts``; a field that is no number is null."""
    kinds = (("step", "long"), ("loss", "double"), ("learning_rate", "double"),
             ("throughput", "double"), ("step_time", "double"))
    return {name: parts[i].try_cast(kind) for i, (name, kind) in enumerate(kinds)}


def step_fields(line: Column) -> dict[str, Column]:
    return step_values(step_parts(line))


def eval_map(line: Column) -> Column:
    """All evaluation pairs of a line; a repeated name keeps its last value."""
    names = F.regexp_extract_all(line, F.lit(EVAL), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(EVAL), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    kept = F.filter(
        pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), p["k"])
    )
    return F.map_from_entries(
        F.transform(kept, lambda p: F.struct(p["k"], p["v"].try_cast("double")))
    )


def eval_values(pairs: Column) -> dict[str, Column]:
    return {f"eval_{m}": F.try_element_at(pairs, F.lit(m)) for m in EVAL_METRICS}


def eval_fields(line: Column) -> dict[str, Column]:
    return eval_values(eval_map(F.when(line.contains("eval_"), line)))


def metric_type(line: Column) -> Column:
    """A line with evaluation pairs counts as evaluation, also if it has a step."""
    return kind_of(eval_map(F.when(line.contains("eval_"), line)), step_parts(line))


def kind_of(pairs: Column, parts: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.lit("evaluation")).when(parts.isNotNull(), F.lit("training_step"))


def event_fields(line: Column, loose_oom: bool = False) -> dict[str, Column]:
    """Event flags and the anomaly's type, step and value; later rules win."""
    nan, high = line.rlike(NAN_LOSS), line.rlike(HIGH_LOSS)
    oom = line.rlike(OUT_OF_MEMORY_LOOSE if loose_oom else OUT_OF_MEMORY)
    nan_value = F.coalesce(group(line, NAN_LOSS, 2), F.lit("NaN"))

    def flag(hit: Column) -> Column:
        return F.when(hit, F.lit(1))

    return {
        "event_nan_loss": flag(nan),
        "event_oom": flag(oom),
        "event_high_loss": flag(high),
        "event_error": flag(line.rlike("(?i)error")),
        "event_warning": flag(line.rlike("(?i)warning")),
        "anomaly_type": F.when(high, F.lit("high_loss")).when(oom, F.lit("oom_error"))
        .when(nan, F.lit("nan_loss")),
        "anomaly_step": F.when(high, group(line, HIGH_LOSS, 1))
        .when(nan, group(line, NAN_LOSS, 1)).try_cast("long"),
        "anomaly_value": F.when(high, group(line, HIGH_LOSS, 2)).when(nan, nan_value),
    }


def phase(line: Column) -> Column:
    name, pattern = PHASES[0]
    found = F.when(line.rlike(pattern), F.lit(name))
    for name, pattern in PHASES[1:]:
        found = found.when(line.rlike(pattern), F.lit(name))
    return found


def parse_lines(lines: DataFrame, line: str = "line", loose_oom: bool = False,
                timestamp: Column | None = None) -> DataFrame:
    """Every record column of every line that is not blank; other columns stay.

    The timestamp is the one in the line or null, if no other is given; ``log_records`` carries it.
    ``eval_metrics`` has every evaluation value of the line by its name.
    """
    text = F.col(line)
    kept = [c for c in lines.columns if c != line]
    # The long patterns are matched once, before their fields are taken.
    matched = lines.where(F.length(F.trim(text)) > 0).withColumns({
        "_parts": step_parts(text), "_pairs": eval_map(F.when(text.contains("eval_"), text))})
    parts, pairs = F.col("_parts"), F.col("_pairs")
    fields = {
        "timestamp": line_timestamp(text) if timestamp is None else timestamp,
        **step_values(parts), **eval_values(pairs),
        "metric_type": kind_of(pairs, parts), "phase": phase(text), **event_fields(text, loose_oom),
        "raw_line": F.trim(text), "eval_metrics": F.when(F.size(pairs) > 0, pairs),
    }
    return matched.select(*kept, *[fields[c].alias(c) for c in RECORD_COLUMNS])


def parse_simple_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The short log format; the timestamp is the text before the first ' - '."""
    text = F.trim(F.col(line))
    kept = [c for c in lines.columns if c != line]
    level = (
        F.when(text.rlike("ERROR|CRITICAL"), F.lit("error"))
        .when(text.contains("WARNING"), F.lit("warning"))
        .when(F.lower(text).contains("nan"), F.lit("anomaly"))
        .otherwise(F.lit("info"))
    )
    stamp = F.when(text.contains(" - "), F.split_part(text, F.lit(" - "), F.lit(1)))
    return lines.where(F.length(text) > 0).select(
        *kept,
        stamp.try_cast("timestamp_ntz").alias("timestamp"),
        group(text, SIMPLE_LOSS).try_cast("double").alias("loss"),
        group(text, SIMPLE_ACCURACY).try_cast("double").alias("accuracy"),
        group(text, SIMPLE_RATE).try_cast("double").alias("learning_rate"),
        group(text, SIMPLE_STEP).try_cast("long").alias("step"),
        group(text, SIMPLE_EPOCH).try_cast("long").alias("epoch"),
        level.alias("event_type"),
    )


def carry_timestamps(
    records: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Give lines without a time the last time before them in their file.

    Rows that know their block (``split_blocks`` of lines read from files) need no other cuts.
    """
    shown = [c for c in records.columns if c != BLOCK]
    blocked = records if BLOCK in records.columns else range_blocks(records, keys, order)
    return scan(blocked, keys, order, last={"timestamp": F.col("timestamp")}).select(*shown)


def log_records(lines: DataFrame, keys: Sequence[str], line: str = "line", loose_oom: bool = False) -> DataFrame:
    """Records of lines from ``read_lines``; a line without a time has the last one before it among ``keys``.

    Only the lines with their times are shuffled, by file split; they are parsed after that.
    """
    timed = lines.withColumn("_time", line_timestamp(F.col(line)))
    blocked = split_blocks(timed, *LINE_ORDER[:2])
    carried = scan(blocked, keys, list(LINE_ORDER), last={"_time": F.col("_time")})
    return parse_lines(carried, line, loose_oom, F.col("_time")).drop("_time")


@dataclass(frozen=True)
class Rule:
    """One parsing rule: the type and group of a pattern's match."""

    name: str
    pattern: str
    kind: str
    group: int


# The default rule table.
DEFAULT_RULES = (
    Rule("loss", r"loss[:\s=]+([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", "double", 1),
    Rule("accuracy", r"accuracy[:\s=]+([0-9]*\.?[0-9]+)", "double", 1),
    Rule("learning_rate", r"learning_rate[:\s=]+([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", "double", 1),
    Rule("step", r"step[:\s=]+([0-9]+)", "long", 1),
    Rule("epoch", r"epoch[:\s=]+([0-9]+)", "long", 1),
    Rule("error", r"(ERROR|CRITICAL|Exception|Error)", "string", 0),
    Rule("warning", r"(WARNING|WARN)", "string", 0),
)


def apply_rules(line: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> dict[str, Column]:
    return {r.name: group(line, r.pattern, r.group).try_cast(r.kind) for r in rules}


def rule_hits(lines: DataFrame, line: str = "line", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Long form: one row per line and matching rule, the value as text."""
    kept = [c for c in lines.columns if c != line]
    cells = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), group(F.col(line), r.pattern, r.group).alias("value"))
        for r in rules
    ])
    return lines.select(*kept, F.inline(cells)).where(F.col("value").isNotNull())
