"""Fill-in-middle: texts cut in three and put in another order by scattering bytes, and back again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, text_bytes, whole_text

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK = 3  # bytes
FORMS = ("plain", "psm", "spm")
PART_BYTES = 1 << 21
BLOCK = 1 << 20  # bytes whose shifts are held at once
COUNTED = 1 << 12  # bytes whose code points are counted together


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks stand, and their letters."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8)) & (data[at + 2] == ord(">"))]
    return at, data[at + 1]


def displaced(starts: np.ndarray, shifts: np.ndarray, total: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For blocks low..high of bytes 0..total, the place each byte goes to or comes from.

    Segments start at `starts` (ascending, the first at 0) and move by `shifts`. A difference array
    holds at each start by how much the shift changes, so its running sum is the shift of every byte.
    """
    change = np.diff(shifts, prepend=0)
    carried = 0
    for low in range(0, total, BLOCK):
        high = min(low + BLOCK, total)
        first, last = np.searchsorted(starts, [low, high])
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, starts[first:last] - low, change[first:last])
        shift = carried + np.cumsum(difference)
        carried = int(shift[-1])
        yield low, high, np.arange(low, high) + shift


class CodePoints:
    """Finds the byte at which a code point begins."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.begins = (data & 0xC0) != 0x80
        blocks = np.arange(0, len(data), COUNTED)
        counts = np.add.reduceat(self.begins, blocks, dtype=np.int64) if len(data) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.first = np.array([self._rank(int(x)) for x in at], np.int64)
        self.n = np.diff(self.first)

    def _rank(self, byte: int) -> int:
        block = byte // COUNTED
        return int(self.before[block] + np.count_nonzero(self.begins[block * COUNTED : byte]))

    def place(self, rank: int) -> int:
        if rank >= self.before[-1]:
            return len(self.begins)
        block = int(np.searchsorted(self.before, rank, "right")) - 1
        low = block * COUNTED
        return low + int(np.flatnonzero(self.begins[low : low + COUNTED])[rank - self.before[block]])


def _texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.string())


def _transformed(plain_percent: int, spm_percent: int):
    def run(part: pa.RecordBatch) -> list[pa.Array]:
        data, at = text_bytes(part.column("text"))
        h1, h2, h3, h4 = (np.array(part.column(f"h{i}")) for i in range(1, 5))
        points = CodePoints(data, at)
        n = points.n
        low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
        plain = (n == 0) | (h3 % 100 >= 100 - plain_percent)
        # A mark within one text, not one that two neighbouring texts make up.
        marked = _marks(data)[0]
        holder = np.searchsorted(at, marked, "right") - 1
        plain[holder[marked + MARK <= at[holder + 1]]] = True
        spm = ~plain & (h4 % 100 < spm_percent)

        begin, end = at[:-1], at[1:]
        moved = np.flatnonzero(~plain)
        c1, c2 = begin.copy(), end.copy()
        c1[moved] = [points.place(int(points.first[i] + low[i])) for i in moved]
        c2[moved] = [points.place(int(points.first[i] + high[i])) for i in moved]
        size = end - begin + 3 * MARK * ~plain
        out_at = np.concatenate([[0], np.cumsum(size)])
        o = out_at[:-1]
        prefix, suffix = c1 - begin, end - c2
        # Where the three marks, and the three parts of a text, go.
        mark_p = np.where(spm, o + MARK + suffix, o)
        mark_s = np.where(spm, o, o + MARK + prefix)
        mark_m = o + 2 * MARK + prefix + suffix
        to = np.where(plain, [o, o + prefix, c2 - begin + o], [mark_p + MARK, mark_m + MARK, mark_s + MARK])
        starts = np.stack([begin, c1, c2], axis=1).ravel()
        out = np.empty(int(out_at[-1]), np.uint8)
        for a, b, place in displaced(starts, to.T.ravel() - starts, len(data)):
            out[place] = data[a:b]
        for where, mark in ((mark_p, MARKS["P"]), (mark_s, MARKS["S"]), (mark_m, MARKS["M"])):
            out[where[moved][:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
        form = np.where(plain, 0, np.where(spm, 2, 1))
        return [
            pa.array(n),
            pa.array(np.array(FORMS)[form]),
            pa.array(low, mask=plain),
            pa.array(high - low, mask=plain),
            _texts(out, out_at),
        ]

    return run


def transform(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """All columns of docs, and n (code points), form, prefix_chars, middle_chars (null if plain), output.

    h1 to h4 are the first four groups of 8 digits of sha256(`seed`:doc_id). The prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger. Form is plain
    (output is the text) if the text is empty or holds a mark `<P>`, `<S>` or `<M>`, and for
    `plain_percent` of the h3; of the others `spm_percent` are spm, by h4, the rest psm.

    A text needs nothing but itself, so nothing is shuffled; a task holds a few megabytes and its
    longest text. Null texts are empty; a null doc_id is hashed as no digits; repeated rows get the same
    result each; an empty table gives an empty one. Columns named like the results are replaced.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(key, 256)

    def group(i: int) -> Column:
        return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")

    inputs = {"text": whole_text()} | {f"h{i}": group(i) for i in range(1, 5)}
    outputs = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return add_columns(docs, inputs, outputs, _transformed(plain_percent, spm_percent), "text", PART_BYTES)


def _restored(part: pa.RecordBatch) -> list[pa.Array]:
    data, at = text_bytes(part.column("output"))
    forms = np.array(part.column("form").to_pylist(), object)
    begin, end = at[:-1], at[1:]
    cut = (forms == "psm") | (forms == "spm")
    marks, letters = _marks(data)
    holder = np.searchsorted(at, marks, "right") - 1
    inside = (marks + MARK <= at[holder + 1]) & cut[holder]
    marks, letters, holder = marks[inside], letters[inside], holder[inside]
    # What is no output of a form has no text to restore.
    bad = ~cut & (forms != "plain")
    bad |= cut & (np.bincount(holder, minlength=len(forms)) != 3)
    place = {}
    for name in MARKS:
        place[name] = np.full(len(forms), -1)
        mine = letters == ord(name)
        place[name][holder[mine]] = marks[mine]
    p, s, m = place["P"], place["S"], place["M"]
    good = ((forms == "psm") & (p == begin) & (s > p) & (m > s)) | ((forms == "spm") & (s == begin) & (p > s) & (m > p))
    bad |= cut & ~good
    cut = good & ~bad

    size = np.where(cut, end - begin - 3 * MARK, end - begin)
    text_at = np.concatenate([[0], np.cumsum(size)])
    r = text_at[:-1]
    spm = forms == "spm"
    prefix = np.where(cut, np.where(spm, m, s) - p - MARK, 0)
    middle = np.where(cut, end - m - MARK, 0)
    starts = np.stack([r, r + prefix, r + prefix + middle], axis=1).ravel()
    source = np.where(cut, [p + MARK, m + MARK, s + MARK], begin).T.ravel()
    out = np.empty(int(text_at[-1]), np.uint8)
    for a, b, taken in displaced(starts, source - starts, len(out)):
        out[a:b] = data[taken]
    texts = _texts(out, text_at)
    return [pa.compute.if_else(pa.array(bad), pa.scalar(None, pa.string()), texts)]


def restore(df: DataFrame) -> DataFrame:
    """All columns of df, and `restored`: the text that `output` was made from, by `output` and `form` alone.

    Null where form or output is null, or where output is none that form could have made.
    """
    usable = F.col("output").isNotNull() & F.col("form").isNotNull()
    inputs = {
        "output": F.coalesce(F.col("output"), F.lit("")),
        "form": F.when(usable, F.col("form")).otherwise(""),
    }
    return add_columns(df, inputs, "restored string", _restored, "output", PART_BYTES)
