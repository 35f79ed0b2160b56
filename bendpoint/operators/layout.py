"""How series are spread over tasks.

Row-frame operators need each series in order.  A plain ``Window.partitionBy(series)`` puts a whole
series in one task, which is safe only where the axis bounds the series: a daily axis holds at most
366 rows a year.  On any other axis a series may hold a third of all rows, so it is cut into blocks
of consecutive rows; each block also receives copies of the few neighbouring rows its frames reach,
and the copies are dropped afterwards.  The results are those of the unblocked window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..session import ensure_checkpoint_dir

SERIES_ROWS = 1 << 18  # longest stretch of a series that is numbered or summed up by one window
# Rows of a series that are framed together.  With its copies a block stays below the 4,096 rows up
# to which Spark keeps a window's rows in a plain in-memory buffer.
WINDOW_ROWS = 1 << 12
BLOCK_ROWS = WINDOW_ROWS - 256

ROW = "_row"
BLOCK = "_block"
HOME = "_home"


BROADCAST_ROWS = 100_000  # most rows, of a few columns each, that a table is broadcast with


def small(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Mark a table for broadcast if a count of it, or of ``counted`` (as many rows but cheaper to make),
    proves that it has few rows; else leave the join to shuffle.  The result is the same."""
    counted = df if counted is None else counted
    return F.broadcast(df) if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def made_once(table: DataFrame) -> DataFrame:
    """The table in checkpointed form: what several jobs read is not made again for each of them."""
    ensure_checkpoint_dir(table.sparkSession)
    return table.checkpoint()


def dealt(df: DataFrame, by: Sequence[str], rows: float) -> DataFrame:
    """The table in tasks of about ``rows`` rows each: for work per row that its few bytes do not show.

    The number is set from a count, so adaptive execution leaves the tasks apart.
    """
    return df.repartition(math.ceil(df.count() / rows) or 1, *by)


def per_key(table: DataFrame) -> DataFrame:
    """A table of one row a key, made once and broadcast if it is small, so that rows joined to it stay."""
    return small(made_once(table))


def keys_of(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def is_daily(df: DataFrame, t: str) -> bool:
    return isinstance(df.schema[t].dataType, T.DateType)


def position(df: DataFrame, t: str, c: Column | None = None) -> Column:
    """The axis ``t`` (or ``c``, of the same type) as a long: microseconds, days, or the integer."""
    kind = df.schema[t].dataType
    c = F.col(t) if c is None else c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("long")


def _numbered(window: WindowSpec, order: Sequence[str]) -> Column:
    """Row number that refuses two rows at the same place of a series."""
    same = F.lit(True)
    for c in order:
        same = same & (F.lag(c).over(window) == F.col(c))
    return F.when(same, F.raise_error(F.lit("two rows share the same series and axis value"))).otherwise(
        F.row_number().over(window)
    ).cast("long")


def add_index(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    tie: Sequence[str] = (),
    name: str = "index",
    series_rows: int = SERIES_ROWS,
) -> DataFrame:
    """Dense row index 1..n along ``t`` (then ``tie``) within each series.

    A daily axis, or series proven short by one small aggregate, are numbered by one window.
    Otherwise rows are counted per bin of the axis, the bin counts are summed up along the series
    (a table of n / series_rows rows), and each row adds its place within its own bin.  Bins that
    hold many times the mean are split again by the same rule.
    """
    keys = keys_of(keys)
    order = [t, *tie]
    whole = Window.partitionBy(*keys).orderBy(*order)
    if is_daily(df, t) and not tie:
        return df.withColumn(name, _numbered(whole, order))

    at = position(df, t)
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")
    )
    measured = sizes.agg(
        F.max("n").alias("longest"),
        F.sum("n").alias("total"),
        F.min("lo").alias("lo"),
        F.min((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / series_rows)).alias("width"),
    ).first()
    if measured.longest is None or measured.longest <= series_rows:
        return df.withColumn(name, _numbered(whole, order))

    width = max(1, int(measured.width))
    lo = int(measured.lo)
    binned = df.withColumns(
        {"_bin": F.floor((at - lo) / width), "_within": F.pmod(at - lo, F.lit(width))}
    )
    crowded = 4 * series_rows
    hot = (
        binned.groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > crowded)
        .select(*keys, "_bin", F.ceil(F.col("_n") / series_rows).alias("_parts"))
    )
    if measured.total // crowded <= 1_000_000:  # an upper bound of the rows of `hot`
        hot = F.broadcast(hot)
    binned = binned.join(hot, [*keys, "_bin"], "left").withColumn(
        "_part",
        F.coalesce(F.floor(F.col("_within") * F.col("_parts") / F.lit(width)), F.lit(0)).cast("long"),
    ).drop("_within", "_parts")
    place = [*keys, "_bin", "_part"]
    starts = (
        binned.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*keys)
                    .orderBy("_bin", "_part")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    inside = Window.partitionBy(*place).orderBy(*order)
    return (
        binned.withColumn("_at", _numbered(inside, order))
        .join(starts, place)
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_bin", "_part", "_before", "_at")
    )


@dataclass(frozen=True)
class Layout:
    """A series table ready for row frames: its rows, its window, and the way back."""

    df: DataFrame
    window: WindowSpec
    added: tuple[str, ...]
    by: tuple[str, ...]  # the window's partition columns

    def running(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def with_rows(self, df: DataFrame) -> Layout:
        return Layout(df, self.window, self.added, self.by)

    def each(self, name: str, values: Sequence[int]) -> Layout:
        """Every row once for each value, which becomes part of the series key; nothing moves."""
        df = self.df.withColumn(name, F.explode(F.array(*[F.lit(int(v)) for v in values])))
        by = (*self.by, name)
        return Layout(df, Window.partitionBy(*by).orderBy(ROW), (*self.added, name), by)

    def cells(self, n: int | Column, name: str = "_cell") -> tuple[Layout, WindowSpec, WindowSpec]:
        """The layout with its rows in cells of ``n``, and running frames from a cell's two ends.

        A frame of ``n`` rows is the head of its row's cell and the tail of the cell before: two values
        combined instead of ``n``. Cells are counted from the start of the series, so no result depends
        on blocks.
        """
        n = F.lit(n) if isinstance(n, int) else n
        layout = self.add({name: F.floor((F.col(ROW) - 1) / n)})
        inside = Window.partitionBy(*self.by, name)
        reach = (Window.unboundedPreceding, Window.currentRow)
        return (
            layout,
            inside.orderBy(ROW).rowsBetween(*reach),
            inside.orderBy(F.desc(ROW)).rowsBetween(*reach),
        )

    def begun(self, tail: Column, n: int) -> Column:
        """A tail's value where the row's frame of ``n`` begins; NULL where the head is the whole frame."""
        return F.when(F.pmod(F.col(ROW), F.lit(n)) != 0, F.lag(tail, n - 1).over(self.window))

    def add(self, columns: dict[str, Column]) -> Layout:
        return self.with_rows(self.df.withColumns(columns))

    def finish(self) -> DataFrame:
        out = self.df
        if HOME in self.added:
            out = out.filter(F.col(HOME))
        return out.drop(*self.added)


def lay_out(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    before: int = 0,
    after: int = 0,
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Layout:
    """Order each series by ``t`` for frames reaching ``before`` rows back and ``after`` rows ahead.

    ``index`` names a dense row index the table already has (see ``add_index``); without it one is
    made.  A daily axis, whose length the calendar bounds, is not cut into blocks.
    """
    keys = keys_of(keys)
    if index is None and is_daily(df, t):
        window = Window.partitionBy(*keys).orderBy(t)
        df = df.withColumn(ROW, _numbered(window, [t]))
        return Layout(df, window, (ROW,), tuple(keys))
    if index is None:
        df = add_index(df, keys, t, name=ROW)
    else:
        df = df.withColumn(ROW, F.col(index).cast("long"))
    added = (ROW, BLOCK, HOME)
    rows = max(block_rows, before + 1, after + 1)
    place = F.pmod(F.col(ROW) - 1, F.lit(rows))
    block = F.floor((F.col(ROW) - 1 - place) / F.lit(rows)).cast("long")
    blocks = F.array(
        block,
        F.when(place >= rows - before, block + 1),
        F.when((place < after) & (block > 0), block - 1),
    )
    spread = df.withColumn(BLOCK, F.explode(F.array_compact(blocks))).withColumn(
        HOME, F.col(BLOCK) == block
    )
    # Rows may arrive partitioned by series alone, which a window by block would accept as it is.
    spread = spread.repartition(*keys, BLOCK)
    return Layout(spread, Window.partitionBy(*keys, BLOCK).orderBy(ROW), added, (*keys, BLOCK))
