"""Rolling fits and the signals made of them, for one block of a series as numpy arrays.

Spark deals out the blocks (``layout``) and repeats no row for it: a task makes all widths, and all
noise levels, of a block's rows at once.  Arrays have a level a row and the series along the last axis.
The arithmetic is that of ``rolling.Fit``: running moments of cells, in the order of Spark's aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import BLOCK, HOME, ROW, keys_of, lay_out
from .rolling import axis_grain

TASK_ROWS = 1 << 14  # rows of a block: some MB with all their widths and levels


@dataclass(frozen=True)
class Held:
    """Values and where they are known; elsewhere they are NULL."""

    v: np.ndarray
    ok: np.ndarray

    def at(self, n: int) -> Held:
        """The value ``n`` rows ahead (back when negative), NULL beyond the block."""
        v, ok = np.full_like(self.v, np.nan), np.zeros_like(self.ok)
        if abs(n) < v.shape[-1]:
            to, of = (slice(None, -n or None), slice(n, None)) if n >= 0 else (slice(-n, None), slice(None, n))
            v[..., to], ok[..., to] = self.v[..., of], self.ok[..., of]
        return Held(v, ok)

    def minus(self, other: Held) -> Held:
        return Held(self.v - other.v, self.ok & other.ok)

    def over(self, limit: Held | float) -> Held:
        """Is it more than the limit?  As in SQL, NaN is more than any number."""
        v, ok = (limit.v, limit.ok) if isinstance(limit, Held) else (limit, True)
        return Held((self.v > v) | (np.isnan(self.v) & ~np.isnan(v)), self.ok & ok)

    def same(self, other: Held) -> Held:
        return Held((self.v == other.v) | (np.isnan(self.v) & np.isnan(other.v)), self.ok & other.ok)


def both(a: Held, b: Held) -> Held:
    """AND of SQL: false if either is, even where the other is NULL."""
    return Held(a.v & b.v, (a.ok & b.ok) | (a.ok & ~a.v) | (b.ok & ~b.v))


def all_of(*conditions: Held) -> Held:
    return reduce(both, conditions)


def half_up(s: Held, digits: int | None) -> Held:
    """Rounded as SQL rounds: the shortest decimal form of the number, halves away from zero."""
    if digits is None:
        return s
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(s.v) * 10.0**digits
        whole = np.floor(scaled + 0.5)
        out = np.where(scaled < 2.0**52, np.copysign(whole / 10.0**digits, s.v) + 0.0, s.v)
        close = s.ok & (scaled < 2.0**52) & (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-15 * scaled + 1e-9)
    unit = Decimal(1).scaleb(-digits)
    out[close] = [float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) + 0.0 for x in s.v[close].tolist()]
    return Held(out, s.ok)


def rolling_max(s: Held, k: int) -> Held:
    """Maximum of ``k`` rows; NULL until full."""
    v, ok, width = s.v.copy(), s.ok.copy(), 1
    while width < k:
        step = min(width, k - width)
        v[..., step:] = np.maximum(v[..., step:], v[..., :-step])
        ok[..., step:] &= ok[..., :-step]
        ok[..., :step] = False
        width += step
    return Held(v, ok)


def _running(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Running moments along the first axis: sums about the means, and the means as seen from the first row."""
    n = np.arange(1.0, len(x) + 1)
    out = {"mx": np.cumsum(x - x[0], axis=0) / n[:, None], "my": np.cumsum(y - y[0], axis=0) / n[:, None, None]}
    xx, xy, yy = np.zeros_like(x), np.zeros_like(y), np.zeros_like(y)
    mean_x, mean_y = x[0], y[0]
    for j in range(1, len(x)):
        dx, dy = x[j] - mean_x, y[j] - mean_y
        step_x, step_y = dx / n[j], dy / n[j]
        mean_x, mean_y = mean_x + step_x, mean_y + step_y
        xx[j] = xx[j - 1] + dx * (dx - step_x)
        yy[j] = yy[j - 1] + dy * (dy - step_y)
        xy[j] = xy[j - 1] + dy * (x[j] - mean_x)
    return out | {"xx": xx, "xy": xy, "yy": yy}


def _along(a: np.ndarray) -> np.ndarray:
    """Cells (step, ..., cell) put back in line (..., row)."""
    return np.moveaxis(a, 0, -1).reshape(*a.shape[1:-1], -1)


@dataclass(frozen=True)
class Block:
    """Consecutive rows of a series: their numbers, regressor and values (a level a row)."""

    row: np.ndarray
    x: np.ndarray
    value: Held

    def fit(self, w: int, scale: float) -> Fitted:
        """Fits of all frames of ``w`` rows: a frame is the tail of one cell and the head of the next."""
        n, front = len(self.row), int(self.row[0] - 1) % w
        cells = -(-(front + n) // w)

        def cut(a: np.ndarray) -> np.ndarray:
            padded = np.full((*a.shape[:-1], cells * w), np.nan)
            padded[..., front : front + n] = a
            return np.ascontiguousarray(np.moveaxis(padded.reshape(*a.shape[:-1], cells, w), -1, 0))

        x, y = cut(self.x), cut(self.value.v)
        place = front + np.arange(n)
        begins = np.maximum(place - (w - 1), 0)
        head = {p: _along(a)[..., place] for p, a in _running(x, y).items()}
        tail = {p: _along(a[::-1])[..., begins] for p, a in _running(x[::-1], y[::-1]).items()}
        n_head, n_tail = place % w + 1, w - begins % w
        dx = np.repeat(x[-1], w)[begins] - np.repeat(x[0], w)[place] + (tail["mx"] - head["mx"])
        dy = np.repeat(y[-1], w, axis=-1)[..., begins] - np.repeat(y[0], w, axis=-1)[..., place] + (tail["my"] - head["my"])
        weight = n_head * n_tail / float(w)
        two = n_head < w
        spread = {"xx": dx * dx, "xy": dx * dy, "yy": dy * dy}
        sums = {p: head[p] + np.where(two, tail[p] + d * weight, 0.0) for p, d in spread.items()}
        known = np.concatenate([np.zeros((len(self.value.ok), 1), int), np.cumsum(self.value.ok & ~np.isnan(self.x), axis=-1)], axis=-1)
        full = np.zeros_like(self.value.ok)
        full[..., w - 1 :] = known[..., w:] - known[..., : max(n + 1 - w, 0)] == w
        return Fitted(self, w, scale, full, **sums)


@dataclass(frozen=True)
class Fitted:
    """Sums about the mean of each row's frame, where it is ``full``."""

    block: Block
    w: int
    scale: float
    full: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def slope(self) -> Held:
        return Held(self.xy / self.xx / self.scale, self.full & (self.xx != 0))

    def r2(self) -> Held:
        return Held(self.xy * self.xy / (self.xx * self.yy), self.full & (self.xx * self.yy != 0))

    def sigma(self) -> Held:
        rest = np.where(self.xx != 0, np.maximum(self.yy - self.xy * self.xy / self.xx, 0.0), 0.0)
        return Held(np.sqrt(rest / (self.w - 2.0)), self.full & (self.w != 2))

    def gradient(self, s: Held) -> Held:
        """Central difference with unit step, one-sided at the two ends of the series."""
        ahead, behind = s.at(1), s.at(-1)
        out = Held((ahead.v - behind.v) / 2.0, ahead.ok & behind.ok)
        first, last = self.block.row == 1, np.arange(len(self.block.row)) == len(self.block.row) - 1
        for at, end in ((last, s.minus(behind)), (first, ahead.minus(s))):
            out = Held(np.where(at, end.v, out.v), np.where(at, end.ok, out.ok))
        return out


WIDTH = "window_length_level"


def each_block(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str | dict[float, Column],
    windows: Sequence[int],
    reach: tuple[int, int],
    outputs: dict[str, str],
    work: Callable[[Fitted], dict[str, Held]],
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Every row once for each width, with the ``outputs`` (name to type) that ``work`` makes of its fits.

    ``value`` is a column, or one for each noise level: then every row is there once for each level
    too, with its ``standard_deviation`` and ``noise``.  Levels are made where a block lies, after rows
    have moved.  ``reach`` is how far rows need fits before and after themselves.
    """
    x, scale = axis_grain(df, t, x_unit)
    held, windows = df.columns, list(windows)
    layout = lay_out(df.withColumn("_x", x), keys, t, max(windows) + reach[0], reach[1], index, block_rows or TASK_ROWS)
    values = value if isinstance(value, dict) else {None: F.col(value)}
    levels = list(values)
    fields = [df.schema[c] for c in held]
    if isinstance(value, dict):
        fields += [T.StructField("standard_deviation", T.DoubleType()), T.StructField("noise", T.DoubleType())]
    fields += [T.StructField(WIDTH, T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType() if kind == "double" else T.BooleanType()) for c, kind in outputs.items()]
    noisy = isinstance(value, dict)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ROW)
        flat = rows["_values"].combine_chunks().flatten()
        v = flat.to_numpy(zero_copy_only=False).reshape(-1, len(levels)).T
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(levels)).T
        block = Block(rows[ROW].to_numpy(), rows["_x"].to_numpy(), Held(np.ascontiguousarray(v), np.ascontiguousarray(known)))
        home = rows[HOME].to_numpy() if HOME in rows.column_names else np.ones(len(rows), bool)
        own = rows.select(held).filter(pa.array(home))
        with np.errstate(all="ignore"):
            made = [work(block.fit(w, scale)) for w in windows]
        parts = []
        for at, level in enumerate(levels):
            noise = [pa.array([level] * len(own), pa.float64()), pa.array(v[at][home], mask=~known[at][home])] if noisy else []
            for w, signals in zip(windows, made, strict=True):
                new = [pa.array(s.v[at][home], mask=~s.ok[at][home]) for s in (signals[c] for c in outputs)]
                widths = pa.array(np.full(len(own), w, np.int32))
                parts.append(pa.Table.from_arrays([*own.columns, *noise, widths, *new], [f.name for f in fields]))
        return pa.concat_tables(parts)

    moved = layout.df.withColumn("_values", F.array(*[c.cast("double") for c in values.values()]))
    by = [*keys_of(keys), BLOCK] if BLOCK in layout.added else keys_of(keys)
    return moved.groupBy(*by).applyInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
