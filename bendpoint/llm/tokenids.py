"""Token-id files: Re-Pair grammar compression per block, with random access to documents.

A file set is a Parquet folder that Spark writes, so that tasks which fail or run twice leave one whole
copy, on any store. Each row is a block of consecutive documents that decodes by itself:

  shard int           shards follow the order of doc_id
  block int           number of the block in its shard
  first_id long       ids of the shard before this block
  n_ids long          ids of this block
  doc_ids binary      little-endian int64, one per document; null doc_ids are in null_docs
  null_docs binary    one byte per document, 1 if its doc_id is null
  counts binary       little-endian uint32, ids of each document, with the end id
  starts binary       little-endian uint32, place of each document's first symbol; documents share none
  base long           smallest nonterminal; rule r makes the symbol base + r
  rules binary        little-endian uint32 pairs, each of smaller symbols
  lengths binary      little-endian uint32, ids that each rule expands to
  symbols binary      the sequence, little-endian, `width` bytes each
  width int           2, 3 or 4
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded, fresh_names, whole_text
from .tokens import pieces

BLOCK_IDS = 1 << 19
AT_ONCE_BYTES = 1 << 22  # of text that is encoded at once
LEAST_COUNT = 8
TABLE_BITS = 18
SCHEMA = (
    "shard int, block int, first_id bigint, n_ids bigint, doc_ids binary, null_docs binary, counts binary, starts binary, "
    "base bigint, rules binary, lengths binary, symbols binary, width int"
)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _frequent(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, bool]:
    """Keys found in LEAST_COUNT places or more, one for each slot of the table, and whether these are all.

    Only keys whose slot is full enough are counted one by one.
    """
    found, n = np.unique(keys[(np.bincount(slots, minlength=1 << TABLE_BITS) >= LEAST_COUNT)[slots]], return_counts=True)
    found = found[n >= LEAST_COUNT]
    own = np.unique(_slot(found), return_index=True)[1]
    return found[own], len(own) == len(found)


def compress(ids: np.ndarray, counts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, starts of documents among them, rules (pairs) and the ids each rule expands to.

    Re-Pair in rounds: the most frequent pairs of adjacent symbols are replaced by nonterminals, from
    left to right where they overlap, until no pair is frequent. No pair crosses from one document to
    the next. Rules that occur once or never after all stay; they are few.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    whole, fresh = True, 0
    while True:
        # After all frequent pairs were replaced, only pairs with a symbol of that round can be frequent.
        new = symbols >= fresh
        places = np.flatnonzero(~last[:-1] if whole else ~last[:-1] & (new[:-1] | new[1:]))
        pairs = symbols[:-1].astype(np.uint64) << np.uint64(32)
        pairs |= symbols[1:]
        keys = pairs[places]
        slots = _slot(keys)
        chosen, whole = _frequent(keys, slots)
        whole = not whole
        if not len(chosen):
            break
        rank_of = np.full(1 << TABLE_BITS, -1, np.int32)
        rank_of[_slot(chosen)] = np.arange(len(chosen))
        rank = rank_of[slots]
        right = np.flatnonzero(rank >= 0)
        right = right[chosen[rank[right]] == keys[right]]
        at, rank = places[right], rank[right]
        # Of places that touch, every other one counts, from the left.
        begins = np.diff(at, prepend=-2) != 1
        nth = np.arange(len(at))
        run = np.maximum.accumulate(np.where(begins, nth, 0))
        free = (nth - run) & 1 == 0
        at, rank = at[free], rank[free]
        pair = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        known = np.concatenate([[1], lengths])  # a token is one id long
        parts = known[np.maximum(pair.astype(np.int64) - base + 1, 0)]
        lengths = np.concatenate([lengths, parts.sum(axis=1).astype(np.uint32)])
        fresh = base + len(rules)
        symbols[at] = fresh + rank
        rules = np.concatenate([rules, pair])
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
    ends = np.flatnonzero(last) + 1
    return symbols, np.concatenate([[0], ends[:-1]]).astype(np.uint32), rules, lengths


def _spread(symbols: np.ndarray, flat: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols one after the other; those of rule r are flat[first[r] : first[r + 1]]."""
    made = np.flatnonzero(symbols >= base)
    rule = symbols[made].astype(np.int64) - base
    size = np.ones(len(symbols), np.int64)
    size[made] = first[rule + 1] - first[rule]
    done = np.cumsum(size)
    out = np.repeat(symbols, size)
    # Where a rule's ids go in the result, and where they come from.
    size, begin = size[made], done[made] - size[made]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + inner] = flat[np.repeat(first[rule], size) + inner]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that a run of symbols stands for. Expansion lengths say where each symbol's ids go."""
    # Every rule's ids, one after the other; a rule refers to symbols made before it. Rules that refer
    # to none of each other, such as those of a round, are expanded at once.
    first = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat = np.empty(int(first[-1]), np.uint32)
    needs = rules.max(axis=1).astype(np.int64) - base
    low = 0
    while low < len(rules):
        late = needs[low + 1 :] >= low
        high = low + 1 + (int(late.argmax()) if late.any() else len(late))
        flat[first[low] : first[high]] = _spread(rules[low:high].ravel(), flat, first, base)
        low = high
    return _spread(symbols, flat, first, base)


def _wide(symbols: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of `width` bytes."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _narrow(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return out.view("<u4").ravel()


def read_document(block: dict, place: int) -> np.ndarray:
    """The ids of one document of a block (a row as a dict), without expanding the others."""
    starts = np.frombuffer(block["starts"], "<u4")
    symbols = _narrow(block["symbols"], block["width"])
    end = starts[place + 1] if place + 1 < len(starts) else len(symbols)
    rules = np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    return expand(symbols[starts[place] : end], rules, np.frombuffer(block["lengths"], "<u4"), block["base"])


def _encode(path: str, cut: str, end_id: int, base: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def written() -> pa.RecordBatch:
            nonlocal block, first
            docs = [d for part in held for d in part[0]]
            flat = np.concatenate([part[1] for part in held])
            counts = np.concatenate([part[2] for part in held])
            symbols, starts, rules, lengths = compress(flat, counts, base)
            width = next(w for w in (2, 3, 4) if base + len(rules) <= 1 << 8 * w)
            row = {
                "shard": shard, "block": block, "first_id": first, "n_ids": len(flat),
                "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
                "null_docs": np.array([d is None for d in docs], np.uint8).tobytes(),
                "counts": counts.astype("<u4").tobytes(), "starts": starts.astype("<u4").tobytes(), "base": base,
                "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
                "symbols": _wide(symbols, width), "width": width,
            }
            block, first = block + 1, first + len(flat)
            kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [pa.array([row[name]], kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))], list(row)
            )

        for batch in batches:
            for part in bounded(batch, "text", AT_ONCE_BYTES):
                flat, counts = pieces(path, cut, end_id).encode(part.column("text").to_pylist(), AT_ONCE_BYTES)
                docs, ends = part.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(counts)])
                low = 0
                while low < len(docs):  # a block ends with the document that fills it
                    high = min(int(np.searchsorted(ends, ends[low] + block_ids - size)), len(docs))
                    held.append((docs[low:high], flat[ends[low] : ends[high]], counts[low:high]))
                    size += int(ends[high] - ends[low])
                    low = high
                    if size >= block_ids:
                        yield written()
                        held, size = [], 0
        if held:
            yield written()

    return run


def write_ids(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int = 2,
    cut: str = "lead",
    base: int | None = None,
    shards: int | None = None,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Tokenize every text, append `end_id`, and write the ids in ascending doc_id order to `folder`.

    Nonterminals start at `base`, the size of the vocabulary unless given. Null and empty texts are the end id alone. Null doc_ids come first; rows of one doc_id are
    ordered by a hash of their text, then as they were read, so that a doc_id of a third of all rows
    still spreads over shards. Extra columns are not written. An empty table writes no blocks.
    """
    if base is None:
        from tokenizers import Tokenizer

        base = max(end_id + 1, Tokenizer.from_file(path).get_vocab_size())
    mark, nth = fresh_names(docs, "mark", "nth")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole_text().alias("text"),
        F.xxhash64(whole_text()).alias(mark),
        F.monotonically_increasing_id().alias(nth),
    )
    order = ["doc_id", mark, nth]
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    texts = dealt.sortWithinPartitions(*order).select("doc_id", "text")
    arrow_map(texts, _encode(path, cut, end_id, base, block_ids), SCHEMA).write.parquet(folder)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
            symbols = _narrow(row["symbols"], row["width"])
            rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
            flat = expand(symbols, rules, np.frombuffer(row["lengths"], "<u4"), row["base"]).astype("<u4")
            ends = np.cumsum(counts)
            docs = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_docs"], np.uint8) == 1)
            cuts = np.concatenate([[0], ends * 4]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), row["shard"], np.int32)),
                    docs,
                    pa.array(row["first_id"] + ends - counts),
                    pa.array(counts),
                    ids,
                ],
                ["shard", "doc_id", "in_shard", "n_tokens", "ids"],
            )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files; start is global.

    The totals of the shards, a few bytes for each task that wrote, are summed on the driver.
    """
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    sizes = blocks.groupBy("shard").agg(F.max(F.col("first_id") + F.col("n_ids")).alias("n")).orderBy("shard").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r["shard"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(rows, "shard int, before bigint"))
    decoded = arrow_map(blocks, _decode, "shard int, doc_id bigint, in_shard bigint, n_tokens bigint, ids binary")
    return decoded.join(offsets, "shard").select(
        "doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids"
    )
