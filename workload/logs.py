"""Log parsing on lines built from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.functions import logparse
from tidefuse.functions.timeops import block_start
from tidefuse.operators.blocks import BLOCK
from tidefuse.session import scratch_path
from tidefuse.sources import logs as log_files
from workload.base import EV, events, query

STAMP = "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')"
SQL_STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"

# One line form per remainder of the event's property.
FORMS = (
    ("Step {id} | Loss: {v} | LR: {k}e-05 | Throughput: {v} samples/s | Step Time: 0.{k}s", "INFO"),
    ("eval_loss: {v} | eval_accuracy: 0.{k} | eval_f1: 1-2 | eval_auc: 0.{k} | eval_custom: {k} | eval_loss: {k}.5", "INFO"),
    ("[ANOMALY DETECTED] NaN/Inf Loss at step {id}: nan", "ERROR"),
    ("[ANOMALY DETECTED] High Loss at step {id}: {v}", "WARNING"),
    ("CUDA out of memory on device {k}", "ERROR"),
    ("waiting room {k}", "INFO"),
    ("Training run {id} begin", "INFO"),
    ("Evaluation of {id} 结束 end", "INFO"),
    ("Epoch {k}, Step {id}, Loss: nan, Accuracy: 0.{k}, LR: 1.9e-05", "CRITICAL"),
    ("Step {id} | Loss: {v} eval_loss: {v} loss={v} step={id} accuracy: 0.{k}", "INFO"),
)
UNTIMED = 10


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line_no, line; every eleventh form has no time of its own."""
    ev = events(spark, sf_dir)
    form = F.col("k") % (len(FORMS) + 1)

    def text(pattern: str):
        out = []
        for piece in pattern.replace("{", "\0{").replace("}", "}\0").split("\0"):
            out.append({
                "{id}": F.col("event_id").cast("string"), "{v}": F.format_string("%.2f", "value"),
                "{k}": F.col("k").cast("string"),
            }.get(piece, F.lit(piece)))
        return F.concat(*out)

    line = F.when(form == UNTIMED, F.concat(F.lit("  continued trace "), F.col("k").cast("string")))
    for i, (pattern, level) in enumerate(FORMS):
        line = line.when(form == i, F.concat(F.expr(STAMP), F.lit(f" - {level} - "), text(pattern)))
    return ev.select(F.col("run_id").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


def _sql_text(pattern: str) -> str:
    out = []
    for piece in pattern.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece:
            out.append({"{id}": "event_id", "{v}": "printf('%.2f', value)", "{k}": "k"}.get(piece, f"'{piece}'"))
    return " || ".join(out)


SQL_LINES = f"""{EV}, lines AS (SELECT run_id AS file, event_id AS line_no, CASE k % {len(FORMS) + 1}
  {' '.join(f"WHEN {i} THEN {SQL_STAMP} || ' - {lv} - ' || {_sql_text(p)}" for i, (p, lv) in enumerate(FORMS))}
  ELSE '  continued trace ' || k END AS line, k % {len(FORMS) + 1} AS form, timestamp AS written, event_id, k, printf('%.2f', value) AS v FROM ev)"""


def rx(pattern: str, group: int = 1, column: str = "line") -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


# What each form of line says, from the values it was built of; no pattern of the library is used.
TIME_CELL = f"CASE WHEN form <> {UNTIMED} THEN date_trunc('second', written) END"
STEP_CELLS = """CASE WHEN form = 0 THEN event_id END AS step, CASE WHEN form = 0 THEN CAST(v AS DOUBLE) END AS loss,
  CASE WHEN form = 0 THEN CAST(k || 'e-05' AS DOUBLE) END AS learning_rate, CASE WHEN form = 0 THEN CAST(v AS DOUBLE) END AS throughput,
  CASE WHEN form = 0 THEN CAST('0.' || k AS DOUBLE) END AS step_time"""
EVAL_FORMS = {
    "loss": "CASE form WHEN 1 THEN k + 0.5 WHEN 9 THEN CAST(v AS DOUBLE) END",
    "accuracy": "CASE WHEN form = 1 THEN CAST('0.' || k AS DOUBLE) END",
    "f1": "CAST(NULL AS DOUBLE)", "precision": "CAST(NULL AS DOUBLE)", "recall": "CAST(NULL AS DOUBLE)",
    "auc": "CASE WHEN form = 1 THEN CAST('0.' || k AS DOUBLE) END",
    "custom": "CASE WHEN form = 1 THEN CAST(k AS DOUBLE) END",
}


def sql_eval(name: str) -> str:
    return f"CAST({EVAL_FORMS[name]} AS DOUBLE) AS eval_{name}"


EVAL_CELLS = ", ".join(sql_eval(n) for n in ("loss", "accuracy", "f1", "precision", "recall"))
TYPE_CELL = "CASE WHEN form IN (1, 9) THEN 'evaluation' WHEN form = 0 THEN 'training_step' END AS metric_type"
EVENT_CELLS = """CASE WHEN form = 2 THEN 1 END AS event_nan_loss, CASE WHEN form = 4 THEN 1 END AS event_oom,
  CASE WHEN form = 3 THEN 1 END AS event_high_loss, CASE WHEN form IN (2, 4) THEN 1 END AS event_error,
  CASE WHEN form = 3 THEN 1 END AS event_warning,
  CASE form WHEN 2 THEN 'nan_loss' WHEN 3 THEN 'high_loss' WHEN 4 THEN 'oom_error' END AS anomaly_type,
  CASE WHEN form IN (2, 3) THEN event_id END AS anomaly_step, CASE form WHEN 2 THEN 'NaN' WHEN 3 THEN v END AS anomaly_value"""
PHASE_CELL = "CASE form WHEN 6 THEN 'train_begin' WHEN 7 THEN 'eval_end' END AS phase"
RECORD_CELLS = f"{STEP_CELLS}, {EVAL_CELLS}, {TYPE_CELL}, {PHASE_CELL}, {EVENT_CELLS}, trim(line) AS raw_line, {sql_eval('auc')}"
CARRIED = f"last_value({TIME_CELL} IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS timestamp"


def with_auc(records_: DataFrame) -> DataFrame:
    """The evaluation value that has no column of its own, from the map of all."""
    return records_.withColumn("eval_auc", F.try_element_at("eval_metrics", F.lit("auc"))).drop("eval_metrics")


def write_logs(spark: SparkSession, sf_dir: str) -> str:
    """One folder of rolled text files per run, lines in order."""
    path = scratch_path(spark, "logs")
    (
        lines(spark, sf_dir).repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
        .select("file", "line").write.partitionBy("file").text(path)
    )
    return path


@query("scan_log", f"WITH {SQL_LINES} SELECT file, {CARRIED}, {RECORD_CELLS} FROM lines")
def scan_log(spark, sf_dir):
    """Text files back to records; the time of a line without one comes from the line before."""
    path = write_logs(spark, sf_dir)
    run = F.regexp_extract("file", r"file=([^/]+)/", 1)
    read = log_files.read_lines(spark, path).withColumn("run", run)
    return with_auc(logparse.log_records(read, ["run"]).drop(*log_files.LINE_ORDER).withColumnRenamed("run", "file"))


@query("log_timestamp", f"WITH {SQL_LINES} SELECT file, line_no, {CARRIED} FROM lines")
def log_timestamp(spark, sf_dir):
    stamped = lines(spark, sf_dir).select(
        "file", "line_no", logparse.line_timestamp(F.col("line")).alias("timestamp"),
        block_start(F.col("line_no"), 1000).alias(BLOCK),
    )
    return logparse.carry_timestamps(stamped, ["file"], ["line_no"])


@query("log_step_parse", f"WITH {SQL_LINES} SELECT line_no, {STEP_CELLS} FROM lines")
def log_step_parse(spark, sf_dir):
    fields = logparse.step_fields(F.col("line"))
    return lines(spark, sf_dir).select("line_no", *[c.alias(n) for n, c in fields.items()])


@query("log_eval_parse", f"""WITH {SQL_LINES} SELECT line_no, {EVAL_CELLS}, {TYPE_CELL},
  CASE form WHEN 1 THEN 5 WHEN 9 THEN 1 ELSE 0 END AS n_metrics, {sql_eval('custom')}, {sql_eval('auc')} FROM lines""")
def log_eval_parse(spark, sf_dir):
    line = F.col("line")
    pairs = logparse.eval_map(line)
    return lines(spark, sf_dir).select(
        "line_no", *[c.alias(n) for n, c in logparse.eval_fields(line).items()],
        logparse.metric_type(line).alias("metric_type"), F.size(pairs).alias("n_metrics"),
        *[F.try_element_at(pairs, F.lit(m)).alias(f"eval_{m}") for m in ("custom", "auc")],
    )


@query("log_events", f"WITH {SQL_LINES} SELECT line_no, {EVENT_CELLS} FROM lines")
def log_events(spark, sf_dir):
    fields = logparse.event_fields(F.col("line"))
    return lines(spark, sf_dir).select("line_no", *[c.alias(n) for n, c in fields.items()])


@query("log_phase", f"WITH {SQL_LINES} SELECT line_no, {PHASE_CELL} FROM lines")
def log_phase(spark, sf_dir):
    return lines(spark, sf_dir).select("line_no", logparse.phase(F.col("line")).alias("phase"))


@query("log_simple_parse", f"""WITH {SQL_LINES} SELECT line_no,
  CASE WHEN trim(line) LIKE '% - %' THEN TRY_CAST(split_part(trim(line), ' - ', 1) AS TIMESTAMP) END AS timestamp,
  CASE WHEN form IN (0, 9) THEN CAST(v AS DOUBLE) WHEN form = 8 THEN 'nan'::DOUBLE END AS loss,
  CASE WHEN form = 8 THEN CAST('0.' || k AS DOUBLE) END AS accuracy,
  CASE form WHEN 0 THEN CAST(k || 'e-05' AS DOUBLE) WHEN 8 THEN 1.9e-05 END AS learning_rate,
  CASE WHEN form IN (0, 8, 9) THEN event_id END AS step, CASE WHEN form = 8 THEN k END AS epoch,
  CASE WHEN line LIKE '%ERROR%' OR line LIKE '%CRITICAL%' THEN 'error' WHEN line LIKE '%WARNING%' THEN 'warning'
    WHEN lower(line) LIKE '%nan%' THEN 'anomaly' ELSE 'info' END AS event_type FROM lines""")
def log_simple_parse(spark, sf_dir):
    return logparse.parse_simple_lines(lines(spark, sf_dir).drop("file"))


@query("log_rules", f"WITH {SQL_LINES} " + " UNION ALL ".join(
    f"SELECT line_no, '{r.name}' AS rule, {rx(r.pattern, r.group)} AS value FROM lines WHERE {rx(r.pattern, r.group)} IS NOT NULL"
    for r in logparse.DEFAULT_RULES
))
def log_rules(spark, sf_dir):
    return logparse.rule_hits(lines(spark, sf_dir).drop("file"))

