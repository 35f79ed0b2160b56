"""Find benchmark passages in documents: winnowed fingerprints, joined and extended to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, ascii_lower, fresh_names, landed, small, whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD, -1), "")


def _spans(i: Column, hashes: str, n: int) -> list[Column]:
    return [F.get(F.col(hashes), i + j) for j in range(n)]


def _slices(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.slice(F.col("h"), i, n))


def _fingerprints(hashed: DataFrame, window: int, gram: int) -> DataFrame:
    """Add `mins` to rows with word hashes `h`: for each window of words, the least hash of its grams.

    A window holds window - gram + 1 grams, and winnowing keeps the least of them. Equal windows have
    equal minima, so every shared span of `window` words shares a kept fingerprint.
    """
    grams = F.when(
        F.size("h") >= window,
        F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.xxhash64(*_spans(i, "h", gram))),
    )
    mins = F.transform(
        F.sequence(F.lit(0), F.size("g") - (window - gram + 1)),
        lambda i: F.least(*_spans(i, "g", window - gram + 1)),
    )
    # No filters here: pushed below the projections they would split the words again.
    return hashed.withColumn("g", grams).withColumn("mins", F.when(F.col("g").isNotNull(), mins)).drop("g")


def _hashed(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    split = df.select(*[c.alias(k) for k, c in keys.items()], words(whole_text()).alias("w"))
    return split.withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).drop("w")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(span, item): the distinct windows of each item as arrays of word hashes; a shorter item is one."""
    n = F.size("h")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    return (
        _hashed(benchmark, {"item": F.col("item_id").cast("string")})
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("h"), i + 1, window))).alias("span"))
        .distinct()
    )


def _hits(docs: DataFrame, spans: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, print, at, n, span): where windows of `spans` occur in docs, at word `at`, `n` words long."""
    keys = {
        "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)),
        "print": F.xxhash64(whole_text()),
    }
    hashed = _hashed(docs, keys)
    sizes = [r[0] for r in spans.select(F.size("span")).distinct().collect()]  # at most `window` numbers
    found = []
    if window in sizes:
        long_spans = spans.filter(F.size("span") == window).select("span").distinct()
        prints = small(
            landed(
                _fingerprints(long_spans.withColumnRenamed("span", "h"), window, gram)
                .select(F.explode("mins").alias("fp"))
                .distinct()
            )
        )
        n = F.size("mins")
        runs = (
            _fingerprints(hashed, window, gram)
            .withColumn(
                "starts",
                F.when(
                    n > 0,
                    F.filter(
                        F.sequence(F.lit(0), n - 1),
                        lambda i: (i == 0) | (F.get(F.col("mins"), i) != F.get(F.col("mins"), i - 1)),
                    ),
                ),
            )
            .select(
                "doc",
                "print",
                F.explode(
                    F.transform(
                        "starts",
                        lambda s, j: F.struct(
                            F.get(F.col("mins"), s).alias("fp"),
                            s.alias("at"),
                            F.slice(
                                F.col("h"), s + 1, F.coalesce(F.get(F.col("starts"), j + 1), n) - s + (window - 1)
                            ).alias("h"),
                        ),
                    )
                ).alias("run"),
            )
            .select("doc", "print", "run.fp", "run.at", "run.h")
        )
        hits = runs.join(prints, "fp").select(
            "doc",
            "print",
            "at",
            F.posexplode(_slices(F.sequence(F.lit(1), F.size("h") - (window - 1)), window)).alias("off", "span"),
        )
        found.append(hits.select("doc", "print", (F.col("at") + F.col("off")).alias("at"), "span"))
    shorter = sorted(set(sizes) - {window})
    if shorter:
        short = small(landed(spans.filter(F.size("span") < window).select(F.xxhash64("span").alias("fp")).distinct()))

        def grams(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size("h") - (n - 1))
            places = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.slice(F.col("h"), i, n).alias("span")))
            return F.when(F.size("h") >= n, places)

        # Spans of all sizes in one pass over the words.
        every = F.flatten(F.array_compact(F.array(*[grams(n) for n in shorter])))
        rows = hashed.select("doc", "print", F.explode(every).alias("g")).select("doc", "print", "g.at", "g.span")
        found.append(rows.join(short, F.xxhash64("span") == F.col("fp"), "left_semi"))
    if not found:
        return hashed.limit(0).select("doc", "print", F.lit(0).alias("at"), F.col("h").alias("span"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """All columns of docs, and n_words, n_hit, n_items (long), items (array of strings), contaminated.

    Words are the ASCII-lower-cased runs of [0-9a-z] and characters beyond ASCII. A window is `window`
    consecutive words of an item; an item of fewer words, but not none, is one window. Each document
    word inside an occurrence of a window is hit; `items` are the ids of the items with such windows,
    sorted as strings. Null and empty texts have no words and no hits; a null item_id hits words but
    is not listed. Repeated rows each get the same result. Either table may be empty. Columns named
    like the results are replaced.

    Documents are never broadcast; the benchmark's windows are if a count shows that they are few.
    Words are compared by their 64-bit hashes, a window by all its words.
    """
    windows = landed(item_windows(benchmark, window))
    classes = landed(windows.groupBy("span").agg(F.collect_set("item").alias("items")))
    where = _hits(docs, windows.select("span"), window, gram).join(
        small(classes, 200_000), "span"
    )
    # Items of a window come as one list, and lists meet only within a document.
    places = where.select("doc", "print", F.struct("at", F.size("span").alias("n")).alias("place"), "items")
    covered = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            F.greatest(acc["end"], p["at"] + p["n"]).alias("end"),
            (acc["n"] + F.greatest(p["at"] + p["n"] - F.greatest(acc["end"], p["at"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    doc, mark, hit, ids = fresh_names(docs, "doc", "print", "hit", "ids")
    found = (
        places.groupBy("doc", "print")
        .agg(F.collect_set("place").alias("places"), F.collect_set("items").alias("lists"))
        .select(
            F.col("doc").alias(doc),
            F.col("print").alias(mark),
            covered.cast("long").alias(hit),
            F.array_sort(F.array_distinct(F.flatten("lists"))).alias(ids),
        )
    )
    results = ("n_words", "n_hit", "n_items", "items", "contaminated")
    own = [c for c in docs.columns if c not in results]
    none = F.array().cast("array<string>")
    return (
        docs.select(
            *own,
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias(doc),
            F.xxhash64(whole_text()).alias(mark),
            F.size(words(whole_text())).cast("long").alias("n_words"),
        )
        .join(found, [doc, mark], "left")
        .select(
            *own,
            "n_words",
            F.coalesce(F.col(hit), F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce(F.col(ids), none)).cast("long").alias("n_items"),
            F.coalesce(F.col(ids), none).alias("items"),
            (F.coalesce(F.col(hit), F.lit(0)) > 0).alias("contaminated"),
        )
    )
