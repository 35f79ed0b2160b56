"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, arrow_map, ascii_lower, fresh_names, landed, whole_text
from .components import components, least_reached

BITS = 64
SPACE = r"[\x20\x09-\x0D]+"
UNIT_ROWS = 4096
ENTRIES = 1 << 16
ENTRIES_OUT = 1 << 12
SHINGLES_AT_ONCE = 1 << 17


def shingle_hashes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, hashes): XXH64 (seed 42) of every run of `size` words, repeats included.

    Fewer words make one run, none an empty list. Words get a projection of their own: inlined in the
    lambda below they would be split again for every shingle.
    """
    w = F.col("w")
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(whole_text()).alias("mark"),
        F.array_remove(F.split(ascii_lower(whole_text()), SPACE, -1), "").alias("w"),
    )
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))),
        lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")),
    )
    return split.select(
        "doc_id", "mark", F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(runs).alias("hashes")
    )


def majority(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of `counts` consecutive hashes: the bits set in over half of them (none: zero)."""
    ends = np.cumsum(counts)
    ones = np.zeros((len(counts), BITS), np.int64)
    for low in range(0, len(flat), SHINGLES_AT_ONCE):
        part = np.ascontiguousarray(flat[low : low + SHINGLES_AT_ONCE])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.searchsorted(ends, low, "right")
        last = np.searchsorted(ends, low + len(part) - 1, "right")
        rows = np.arange(first, last + 1)
        rows = rows[counts[rows] > 0]
        cuts = np.maximum(ends[rows] - counts[rows] - low, 0)
        ones[rows] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    won = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(won, axis=1, bitorder="little").view(np.int64).ravel()


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hashes")
        offsets = hashes.offsets.to_numpy()
        flat = hashes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        prints = majority(flat.astype(np.int64, copy=False), np.diff(offsets))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(prints)], ["doc_id", "mark", "fp"]
        )


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, mark, fp bigint): one row per row of docs. Texts without words have fingerprint zero."""
    return arrow_map(shingle_hashes(docs, size), _majorities, "doc_id bigint, mark bigint, fp bigint")


def choose_blocks(n: int, radius: int) -> int:
    """Blocks so that the bits of all but `radius` of them split n prints into lists of about 1,024.

    Two prints within the radius agree on all but `radius` blocks, so any choice finds all links.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n >> (BITS * (blocks - radius) // blocks) > 1024:
        blocks += 1
    return blocks


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks: the bits of each choice of blocks - radius blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """Union-find over positions 0..n-1 in numpy; roots are the smallest positions."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def sliced_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (u, v) of all pairs within a group that differ in at most `radius` bits.

    fps: uint64, group after group; starts: where groups begin. Each group is laid out in words of 64
    lanes; plane b holds bit b of 64 prints. An entry compares one print with one word of its group:
    planes XOR the print's bit are added into three carry-save counters, and entries whose lanes all
    exceed the radius are abandoned every eight planes.
    """
    sizes = np.diff(np.append(starts, len(fps)))
    group = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(fps)) - starts[group]
    words_of = -(-sizes // 64)
    first_word = np.concatenate(([0], np.cumsum(words_of)[:-1]))
    word, lane = first_word[group] + inside // 64, (inside % 64).astype(np.uint64)
    word_start = np.flatnonzero(np.diff(word, prepend=-1))
    bit = np.uint64(1) << lane
    planes = [
        np.add.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << lane, word_start) for b in range(BITS)
    ]
    valid = np.add.reduceat(bit, word_start)
    per_row = (first_word + words_of)[group] - word  # own word and the later ones
    done = np.cumsum(per_row)
    low = 0
    while low < len(fps):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + ENTRIES, "right")))
        n = per_row[low:high]
        row = np.repeat(np.arange(low, high), n)
        at = word[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        later = np.where(at == word[row], ~(bit[row] | (bit[row] - np.uint64(1))), ~np.uint64(0))
        alive = valid[at] & later
        ones, twos, fours = (np.zeros(len(row), np.uint64) for _ in range(3))
        for b in range(BITS):
            x = planes[b][at] ^ (np.uint64(0) - ((fps[row] >> np.uint64(b)) & np.uint64(1)))
            carry = ones & x
            ones ^= x
            carry, twos = twos & carry, twos ^ carry
            spill, fours = fours & carry, fours ^ carry
            alive &= ~spill
            if b % 8 == 7:
                alive &= ~_above(ones, twos, fours, radius)
                keep = alive != 0
                if not keep.all():
                    row, at, alive = row[keep], at[keep], alive[keep]
                    ones, twos, fours = ones[keep], twos[keep], fours[keep]
        for cut in range(0, len(row), ENTRIES_OUT):
            part = slice(cut, cut + ENTRIES_OUT)
            lanes = np.unpackbits(np.ascontiguousarray(alive[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            entry, found = np.nonzero(lanes)
            if len(entry):
                yield row[part][entry], word_start[at[part][entry]] + found
        low = high


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count exceeds radius (0..7)."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit has at most two tiles of rows, so what is held is bounded."""
        held_unit, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(unit: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
            forest = Forest(len(fp))
            for u, v in sliced_links(fp, starts, radius):
                forest.link(u, v)
            child = np.flatnonzero(forest.root != np.arange(len(fp)))
            a, b = fp[child].view(np.int64), fp[forest.root[child]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            unit = np.concatenate([held_unit, batch.column("unit").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(unit):
                continue
            whole = np.searchsorted(unit == unit[-1], True)  # the last unit may go on
            if whole:
                yield links(unit[:whole], fp[:whole])
            held_unit, held_fp = unit[whole:], fp[whole:]
        if len(held_unit):
            yield links(held_unit, held_fp)

    return run


def links(prints: DataFrame, radius: int = 4, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Edges (a, b) that span each component of distinct `fp` (bigint) at most `radius` bits apart.

    Prints meet in lists by shared blocks. A list of over `unit_rows` rows is dealt into tiles by
    a hash of the print and each pair of tiles is a unit of its own, so no list is cut or skipped.
    """
    n = prints.count()
    masks = block_masks(choose_blocks(n, radius), radius)
    lists = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.mask", "k.key")
    crowded = lists.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / unit_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: (t != F.col("mine")) | (F.col("tiles") == 1))
    units = (
        lists.join(crowded, ["mask", "key"])
        .withColumn("tiles", tiles)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(others))
        .select("fp", F.xxhash64("mask", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"))
    )
    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return arrow_map(dealt, _compare(radius), "a bigint, b bigint").distinct()


def _groups(docs: DataFrame, radius: int, size: int) -> tuple[DataFrame, DataFrame]:
    """All rows' prints; and for each distinct print the first row of its component, nulls last."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0..6: counters have three bits and spill at eight")
    prints = landed(fingerprints(docs, size))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = landed(prints.groupBy("fp").agg(F.min(row).alias("first")))
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = least_reached(classes.join(roots, "fp"), "fp", "first")
    return prints, classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; extra columns are not carried.

    Fingerprints at most `radius` bits apart are linked; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and link like any other. A null doc_id links but is
    never the smallest unless all of its component are null. Repeated rows repeat. Empty table: empty.
    Texts count whole, however long.
    """
    prints, groups = _groups(docs, radius, size)
    return prints.join(groups, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates keeps its smallest doc_id.

    Where a group holds that doc_id with several texts the one whose hash is lowest stays, and of rows
    that repeat both, one. Rows with a null doc_id go unless their whole group has none, of which one
    stays. All columns are kept.
    """
    doc, mark = fresh_names(docs, "doc", "mark")
    _, groups = _groups(docs, radius, size)
    chosen = groups.select(
        F.coalesce("least.doc_id", F.lit(LOWEST)).alias(doc), F.col("least.mark").alias(mark)
    ).distinct()
    keyed = docs.withColumns(
        {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), mark: F.xxhash64(whole_text())}
    )
    return keyed.dropDuplicates([doc, mark]).join(chosen, [doc, mark], "left_semi").drop(doc, mark)
