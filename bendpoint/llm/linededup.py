"""Drop lines that repeat across documents: levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, ascii_lower, fresh_names, landed, union_all, whole_text

STRIP = " \t\n\x0b\f\r"


def _doc() -> Column:
    """A null doc_id counts as one document, smaller than all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))


def _keys(lines: Column, min_chars: int) -> Column:
    """Places and 128-bit hashes of the lines that are long enough to count."""

    def entry(line: Column, at: Column) -> Column:
        key = F.btrim(line, F.lit(STRIP))
        return F.struct(
            at.alias("at"),
            F.xxhash64(key).alias("h1"),
            F.xxhash64(F.lit(1), key).alias("h2"),
            (F.char_length(key) >= min_chars).alias("long"),
        )

    return F.filter(F.transform(lines, entry), lambda e: e["long"])


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, print, at, h1, h2): a row for each counted line; print is the hash of the whole text."""
    return docs.select(
        _doc().alias("doc"),
        F.xxhash64(whole_text()).alias("print"),
        F.explode(_keys(F.split(ascii_lower(whole_text()), "\n", -1), min_chars)).alias("k"),
    ).select("doc", "print", "k.at", "k.h1", "k.h2")


class Runs:
    """Sorted runs of (h1, h2, n_docs, last), in levels; `fanout` runs of a level merge into one above.

    Batches come with descending doc_id. A key that some run already holds with `min_docs` documents is
    settled, since its last document is known and its count suffices: a batch merge-anti-joins every
    run on its settled keys and adds a run of the others. So a line in a third of all documents takes
    one row of a few runs, not one of each batch.
    """

    def __init__(self, min_docs: int, fanout: int = 2) -> None:
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))
        return landed(merged.sort("h1", "h2"))

    def add(self, keys: DataFrame) -> None:
        """keys: line_keys of a batch. A document must lie in one batch."""
        fresh = keys.groupBy("h1", "h2").agg(
            F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("last")
        )
        for run in self.runs():
            settled = run.filter(F.col("n_docs") >= self.min_docs).hint("merge")
            fresh = fresh.join(settled, ["h1", "h2"], "left_anti")
        self.levels[0].append(landed(fresh.sort("h1", "h2")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merged(union_all(self.levels[level])))
            self.levels[level] = []
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def repeated(self) -> DataFrame:
        """(h1, h2, last) of the keys in at least `min_docs` documents."""
        runs = self.runs()
        whole = runs[0] if len(runs) == 1 else self._merged(union_all(runs))
        return whole.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last")


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 3, fanout: int = 2
) -> DataFrame:
    """All columns of docs, with `text` replaced by the kept lines, and n_lines and n_dropped (long).

    A line's key is the line without white space ([ \\t-\\r]) at its ends and with A-Z lower-cased. Keys
    of at least `min_chars` code points found in at least `min_docs` documents (distinct doc_id) lose
    all their lines but those in the largest doc_id that holds them. Null and empty texts are one empty
    line and become empty. A null doc_id counts as one document, smaller than the others. Rows that
    repeat a doc_id are parts of one document: all keep or lose a line together. An empty table gives
    an empty one. Columns named n_lines or n_dropped are replaced; others stay as they are.
    """
    shares = [i / batches for i in range(1, batches)]
    edges = docs.select(_doc().alias("doc")).approxQuantile("doc", shares, 0.01) if shares else []
    bounds = sorted({int(x) for x in edges}, reverse=True)
    runs = Runs(min_docs, fanout)
    above = None
    for bound in [*bounds, None]:
        part = docs if above is None else docs.filter(_doc() < above)
        runs.add(line_keys(part if bound is None else part.filter(_doc() >= bound), min_chars))
        above = bound
    lost = (
        line_keys(docs, min_chars)
        .join(runs.repeated().hint("merge"), ["h1", "h2"])
        .filter(F.col("doc") < F.col("last"))
        .groupBy("doc", "print")
        .agg(F.collect_set("at").alias("lost"))
    )
    doc, mark, lines, gone = fresh_names(docs, "doc", "print", "lines", "lost")
    lost = lost.select(F.col("doc").alias(doc), F.col("print").alias(mark), F.col("lost").alias(gone))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    found = (
        docs.select(*own, _doc().alias(doc), F.xxhash64(whole_text()).alias(mark))
        .join(lost, [doc, mark], "left")
        .withColumn(lines, F.split(whole_text(), "\n", -1))
        .withColumn(gone, F.coalesce(F.col(gone), F.array().cast("array<int>")))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.size(gone) == 0, whole_text()).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    )
    return found.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in own],
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )
