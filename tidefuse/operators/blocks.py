"""Ordered scans over long series without putting a series into one task.

A window over ``partitionBy(run_id)`` sends a whole run to one task. Here a
series is cut into blocks that follow each other in its order. Every block is
scanned on its own, and what earlier or later blocks contribute is carried in
from one summary row per block. Results equal those of the plain window.

Blocks come from one of three places:

* ``block_start`` of a grid slot or ``step_block`` of a counter: the width
  bounds the rows of a block, as slots and steps are unique within a series;
* ``range_blocks`` for rows of any density: cuts follow from exact counts per cell
  of the order, and inside an instant shared by many rows from the next column;
* ``split_blocks`` for lines of files: a file's split is a block;
* ``with_halo`` for frames that look back a fixed time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefuse.functions.timeops import floor_us, micros

BLOCK = "_blk"
DEFAULT_BLOCK_SLOTS = 3600
#: Rows of a block of ``range_blocks``, about.
BLOCK_ROWS = 100_000


def step_block(step: Column, width: int = 10_000) -> Column:
    return F.coalesce(floor_us(step.cast("long"), width), F.lit(0).cast("long"))


def split_blocks(df: DataFrame, file: str, split: str) -> DataFrame:
    """Add ``_blk``: the split of a file that a row was read from. No row moves for that."""
    return df.withColumn(BLOCK, F.struct(F.col(file), F.col(split)))


def _place(df: DataFrame, column: str) -> tuple[Column, float]:
    """An order-keeping number for a column, and the width of a cell of it."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(column).cast("double"), 3.6e9
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double"), 1.0
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("double"), float(1 << 20)
    if isinstance(kind, T.StringType):
        # The first six bytes; a cell has the first three in common.
        digits = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
        return F.conv(digits, 16, 10).cast("double"), float(1 << 24)
    raise TypeError(f"no blocks over a column of type {kind.simpleString()}")


def range_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_blk``: consecutive ranges of (keys, order) of about ``rows`` rows.

    The order's first column is cut into cells of fixed width. Rows are counted per
    key and cell, and a row's rank is estimated from the counts before its cell and
    its place inside; estimates never run against the order, so a multiple of ``rows``
    of them is a block. An instant (one value of the first column) with more than
    ``rows`` rows is cut again, along the second column. All follows from the rows
    alone: no sample, no checkpoint, and the same blocks whenever a task is run again.
    """
    here, width = _place(df, order[0])
    then = _place(df, order[1])[0] if len(order) > 1 else F.lit(0.0)
    none = F.lit(-(1 << 63)).cast("long")  # a missing value comes first
    placed = df.withColumns({"_bx": here, "_by": then}).withColumn(
        "_bcell", F.coalesce(F.floor(F.col("_bx") / width), none))
    by_cell = [*keys, "_bcell"]
    cells = placed.groupBy(*by_cell).agg(
        F.count(F.lit(1)).alias("_bn"), F.min("_bx").alias("_blo"), F.max("_bx").alias("_bhi"))
    before = Window.partitionBy(*keys).orderBy("_bcell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_bbefore", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    if len(order) > 1:
        busy = cells.where(F.col("_bn") > rows).select(*[F.col(c).alias(f"_bk{i}") for i, c in enumerate(by_cell)])
        same = _all_equal(by_cell, "_bk")
        instants = placed.select(*by_cell, "_bx", "_by").join(busy, same, "left_semi").groupBy(*by_cell, "_bx").agg(
            F.count(F.lit(1)).alias("m"), F.min("_by").alias("lo"), F.max("_by").alias("hi")).where(F.col("m") > rows)
        # At most a row of this list per `rows` rows of the cell.
        dense = instants.groupBy(*[F.col(c).alias(f"_bk{i}") for i, c in enumerate(by_cell)]).agg(
            F.collect_list(F.struct("_bx", "m", "lo", "hi")).alias("_bdense"))
        cells = cells.join(dense, same, "left").drop(*[f"_bk{i}" for i in range(len(by_cell))])
    else:
        cells = cells.withColumn("_bdense", F.lit(None).cast("array<struct<_bx:double,m:bigint,lo:double,hi:double>>"))
    cells = cells.select(*[F.col(c).alias(f"_bc{i}") for i, c in enumerate(by_cell)],
                         "_bn", "_blo", "_bhi", "_bbefore", "_bdense")
    joined = placed.join(cells, _all_equal(by_cell, "_bc"))
    share = F.coalesce((F.col("_bx") - F.col("_blo")) / (F.col("_bhi") - F.col("_blo") + 1), F.lit(0.0))
    rank = F.col("_bbefore") + F.col("_bn") * share
    at = F.try_element_at(F.filter("_bdense", lambda d: d["_bx"].eqNullSafe(F.col("_bx"))), F.lit(1))
    passed = F.coalesce(F.size(F.filter("_bdense", lambda d: d["_bx"] < F.col("_bx"))), F.lit(0))
    part = at["m"] * (F.col("_by") - at["lo"]) / (at["hi"] - at["lo"] + 1)
    block = F.struct(
        F.floor(rank / rows).alias("range"), (2 * passed + at.isNotNull().cast("int")).alias("instant"),
        F.coalesce(F.floor(part / rows), F.lit(0).cast("long")).alias("part"))
    return joined.select(*df.columns, block.alias(BLOCK))


def _all_equal(columns: Sequence[str], prefix: str) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(columns)])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    last: Mapping[str, Column | str] | None = None,
    following: Mapping[str, Column | str] | None = None,
    previous: Mapping[str, Column | str] | None = None,
    low: Mapping[str, Column | str] | None = None,
    total: Mapping[str, Column | str] | None = None,
    first: Mapping[str, Column | str] | None = None,
    recent: Mapping[str, Column | str] | None = None,
    depth: int = 10,
    block: str = BLOCK,
    keep_block: bool = False,
) -> DataFrame:
    """Add running columns to a series that has a block column.

    Inputs are columns or SQL expressions, by the name of their result.

    last       last non-null value up to and including the row
    previous   last non-null value before the row
    following  next non-null value from the row on
    low        smallest value up to and including the row
    total      running sum up to and including the row
    first      first non-null value of the whole series
    recent     the last ``depth`` non-null values up to and including the row, as structs
               of the order and the value (``at``, ``value``), the newest first
    """
    groups = {"last": last, "previous": previous, "following": following, "low": low,
              "total": total, "first": first, "recent": recent}
    wanted = [(kind, name) for kind, group in groups.items() for name in group or ()]
    inputs = {f"_in_{n}": c for group in groups.values() for n, c in (group or {}).items()}
    shown = [c for c in df.columns if c != block]
    computed = {n: c for n, c in inputs.items() if isinstance(c, Column)}
    df = df.withColumns(computed) if computed else df

    # Both passes read one shuffle. For that they must ask for the same columns,
    # so all columns travel in one cell that the optimizer cannot prune, and for
    # the same rows, so they are keyed by columns that cannot be null and attract
    # no null filter: the keys themselves, or copies of keys that can be null.
    # The cell is unfolded by the outer generator: for the other one the optimizer filters on the
    # cell's size at the scan, where all expressions below would be evaluated once more, unshared.
    solid = {f.name for f in df.schema.fields if not f.nullable}
    part = [k if k in solid else f"_key{i}" for i, k in enumerate(keys)]
    in_cell = [f"`{c}`" for c in shown if c not in part]
    in_cell += [f"`{n}`" if n in computed else f"{c} AS `{n}`" for n, c in inputs.items()]
    key_cells = [
        f"`{k}`" if k == p else f"coalesce(CAST(`{k}` AS STRING), '\\0') AS {p}"
        for k, p in zip(keys, part, strict=True)
    ]
    # A number, or a struct of numbers and texts that is never null.
    cut = f"CAST(coalesce({block}, 0) AS BIGINT) AS {block}"
    if isinstance(df.schema[block].dataType, T.StructType):
        cut = block
    rows = (
        df.selectExpr(*key_cells, cut,
                      f"array(struct({', '.join(in_cell)})) AS _cell")
        .repartition(*part, block)
        .selectExpr(*[f"`{p}`" for p in part], block, "inline_outer(_cell)")
    )

    ordering = f"`{order[0]}`" if len(order) == 1 else f"struct({', '.join(f'`{o}`' for o in order)})"
    by_key = ", ".join(f"`{p}`" for p in part)
    before = f"OVER (PARTITION BY {by_key} ORDER BY {block} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local = f"PARTITION BY {by_key}, {block} ORDER BY {', '.join(f'`{o}`' for o in order)} ROWS BETWEEN"
    upto = f"OVER ({local} UNBOUNDED PRECEDING AND CURRENT ROW)"
    earlier = f"OVER ({local} UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # Looking ahead is looking back in reversed order: frames that end with the
    # partition are evaluated anew for every row, frames that begin with it are not.
    after = (f"OVER (PARTITION BY {by_key} ORDER BY {block} DESC"
             " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    whole = (f"OVER (PARTITION BY {by_key} ORDER BY {block}"
             " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    reverse = ", ".join(f"`{o}` DESC NULLS LAST" for o in order)
    onward = (f"OVER (PARTITION BY {by_key}, {block} ORDER BY {reverse}"
              " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")

    # Lists of the newest values: of the known rows (or blocks) alone, a frame of `depth` rows holds them;
    # the others take that of the known one before them.
    lists = [name for kind, name in wanted if kind == "recent"]
    known_rows = f"ROWS BETWEEN {depth - 1} PRECEDING AND CURRENT ROW"
    pair = f"struct({ordering} AS at, {{0}} AS value)"
    if lists:
        by_order = ", ".join(f"`{o}`" for o in order)
        rows = rows.selectExpr("*", *[
            f"CASE WHEN `_in_{n}` IS NOT NULL THEN collect_list({pair.format(f'`_in_{n}`')}) OVER"
            f" (PARTITION BY {by_key}, {block}, (`_in_{n}` IS NOT NULL) ORDER BY {by_order} {known_rows}) END AS `_list_{n}`"
            for n in lists])

    sums, carries, out = [], [], []
    for kind, name in wanted:
        value, summed, carry = f"`_in_{name}`", f"`_sum_{name}`", f"`_carry_{name}`"
        if kind == "recent":
            held = f"CASE WHEN {value} IS NOT NULL THEN {pair.format(value)} END"
            # No more than a block's rows, and `depth` of them go on.
            sums.append(F.expr(f"slice(sort_array(collect_list({held}), false), 1, {depth}) AS {summed}"))
            carries.append(f"last(`_lists_{name}`, true) {before} AS {carry}")
            here = f"reverse(last(`_list_{name}`, true) {upto})"
            none = f"slice({here}, 1, 0)"
            out.append(f"slice(concat(coalesce({here}, slice({carry}, 1, 0), array()), coalesce({carry}, {none}, array())),"
                       f" 1, {depth}) AS `{name}`")
            continue
        known = f"CASE WHEN {value} IS NOT NULL THEN {ordering} END"
        summary, carried, running = {
            "last": (f"max_by({value}, {known})", f"last({summed}, true) {before}",
                     f"coalesce(last({value}, true) {upto}, {carry})"),
            "previous": (f"max_by({value}, {known})", f"last({summed}, true) {before}",
                         f"coalesce(last({value}, true) {earlier}, {carry})"),
            "following": (f"min_by({value}, {known})", f"last({summed}, true) {after}",
                          f"coalesce(last({value}, true) {onward}, {carry})"),
            "low": (f"min({value})", f"min({summed}) {before}",
                    f"least(min({value}) {upto}, {carry})"),
            "total": (f"sum({value})", f"sum({summed}) {before}",
                      f"coalesce(sum({value}) {upto}, 0) + coalesce({carry}, 0)"),
            "first": (f"min_by({value}, {known})", f"first({summed}, true) {whole}", carry),
        }[kind]
        sums.append(F.expr(f"{summary} AS {summed}"))
        carries.append(f"{carried} AS {carry}")
        out.append(f"{running} AS `{name}`")
    names = {name for _, name in wanted}
    summaries = rows.groupBy(*part, block).agg(*sums)
    if lists:
        summaries = summaries.selectExpr("*", *[
            f"CASE WHEN size(`_sum_{n}`) > 0 THEN slice(flatten(reverse(collect_list(`_sum_{n}`) OVER (PARTITION BY {by_key},"
            f" (size(`_sum_{n}`) > 0) ORDER BY {block} {known_rows}))), 1, {depth}) END AS `_lists_{n}`" for n in lists])
    summaries = summaries.selectExpr(*[f"`{p}`" for p in part], block, *carries)
    kept = [f"`{c}`" for c in shown if c not in names] + ([block] if keep_block else [])
    return rows.join(summaries, [*part, block], "left").selectExpr(*kept, *out)


def with_halo(df: DataFrame, us: Column, width: int, halo: int) -> DataFrame:
    """Copy each row into every block whose frame may look back on it.

    Adds ``_blk`` and ``_own``; windows run per block, then only own rows stay.
    """
    home = F.coalesce(floor_us(us, width), F.lit(0).cast("long"))
    reach = F.coalesce(floor_us(us + F.lit(halo), width), home)
    return df.withColumn(BLOCK, F.explode(F.sequence(home, reach, F.lit(width)))).withColumn(
        "_own", F.col(BLOCK) == home
    )
