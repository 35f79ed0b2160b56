"""Pack tokenized documents into windows: best-fit decreasing over a segment tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, whole_text
from .tokens import CACHE_PIECES, pieces

CHUNK_IDS = 1 << 20
TASK_BYTES = 4 << 20  # text that a task packs, at least
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """Windows with room left, by their room; a segment tree over 0..capacity finds the tightest."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of at least `need`, taken out, and that room."""
        i = self.size + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return self.windows[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length (1..capacity) its window and its offset there; and the number of windows."""
    opened = OpenWindows(capacity)
    window, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        w, room = opened.take(need) or (n, capacity)
        n += w == n
        window[i], offset[i] = w, capacity - room
        if room > need:
            opened.put(w, room - need)
    return window, offset, n


def pack_ids(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces of documents of `counts` ids (1 or more) in document order: doc, start, length, window, offset."""
    per = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), per)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
    length = np.minimum(counts[doc] - start, capacity)
    window, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    rest = length < capacity
    window[rest], offset[rest], n = best_fit(length[rest], capacity)
    window[~rest] = n + np.arange(int((~rest).sum()))
    return {"doc": doc, "start": start, "length": length, "window": window, "offset": offset}


def _pack(path: str, cut: str, end_id: int, capacity: int, chunk_ids: int, cache_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id
            docs = [d for part in held for d in part[0]]
            flat = np.concatenate([part[1] for part in held])
            counts = np.concatenate([part[2] for part in held])
            p = pack_ids(counts, capacity)
            cuts = np.concatenate([[0], np.cumsum(p["length"]) * 4]).astype(np.int32)
            ids = pa.Array.from_buffers(
                pa.binary(), len(p["doc"]), [None, pa.py_buffer(cuts), pa.py_buffer(flat.astype("<u4", copy=False))]
            )
            columns = [
                pa.array(docs, pa.int64()).take(pa.array(p["doc"])),
                pa.array(p["start"]),
                pa.array(p["length"]),
                ids,
                pa.array(counts[p["doc"]]),
                pa.array(p["window"] + next_id),
                pa.array(p["offset"]),
            ]
            next_id += int(p["window"].max()) + 1
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                flat, counts = pieces(path, cut, end_id, cache_pieces).encode(part.column("text").to_pylist())
                held.append((part.column("doc_id").to_pylist(), flat, counts))
                size += len(flat)
                if size >= chunk_ids:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return run


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    cut: str = "drop",
    chunk_ids: int = CHUNK_IDS,
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    Each text's ids, and `end_id`, are cut into full windows of `capacity`; what remains is packed
    best-fit decreasing with the other remainders of the same chunk. A chunk is at least `chunk_ids`
    consecutive ids of one task: nothing is shuffled, what a task holds is bounded by the chunk and its
    largest text, and a task that runs again makes the same windows. At most the last windows of a chunk
    are left with much room. A worker remembers the ids of `cache_pieces` words (some 150 bytes each) at
    most, which changes time and memory alone; small partitions are read together, TASK_BYTES of text by a task, so that
    chunks are full however finely the table is dealt. sequence_id is unique, not consecutive.

    Null and empty texts are one piece of the end id. Repeated rows and null doc_ids are packed as
    they come. An empty table gives no rows. Other columns are not carried.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.coalesce(max(1, size // TASK_BYTES))
    return arrow_map(texts, _pack(path, cut, end_id, capacity, chunk_ids, cache_pieces), SCHEMA)
