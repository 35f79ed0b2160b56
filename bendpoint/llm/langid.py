"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_names, kept, whole_text

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
AT_ONCE_CHARS = 1 << 19
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Text starts, the buckets of the n-grams that begin at each kept character (an array for each
    order), the text of each character, and whether texts hold letters. Anything but letters counts as
    one space; n-grams do not cross texts."""
    joined = "".join(f" {t} " for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    letters = np.bincount(owner[~space], minlength=len(texts)) > 0
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    buckets = []
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # A text ends with one space; shorter n-grams there take the code 0 for what lies beyond.
        ahead = np.zeros(len(codes), np.uint64)
        if n == 1:
            ahead = codes
        else:
            same = owner[n - 1 :] == owner[: len(owner) - n + 1]
            ahead[: len(codes) - n + 1] = np.where(same, codes[n - 1 :], 0)
        mixed = (mixed + ahead + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return starts, buckets, owner, letters


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for high, text in enumerate(texts):
        if size and size + len(text) > AT_ONCE_CHARS:
            yield low, high
            low, size = high, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(langs)}
        counts = np.zeros((len(langs), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            texts, mine = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            mine = np.array([number[x] for x in mine], np.int64)
            for low, high in _slices(texts):
                _, buckets, owner, _ = _grams(texts[low:high])
                base = mine[low:high][owner] << BUCKET_BITS
                for b in buckets:
                    counts += np.bincount(base + b, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        for cut in range(0, len(lang), 1 << 17):
            part = slice(cut, cut + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[part].astype(np.int32)), pa.array(bucket[part].astype(np.int32)),
                 pa.array(counts[lang[part], bucket[part]])],
                ["lang", "bucket", "n"],
            )

    return run


@dataclass
class Model:
    langs: list[str]
    log_probability: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def train(docs: DataFrame, per_lang: int = 4000, smoothing: float = 0.1, max_langs: int = 256) -> Model:
    """Learn from rows of docs (text, lang, doc_id), those with a null lang aside.

    Of each language about `per_lang` whole texts are used: a bounded sample, drawn by a hash of the
    whole row, so that neither a language of a third of all rows nor a group of copies that is a third
    of a language takes more than its share. Only the `max_langs` most frequent values of lang are
    learned, which bounds the model where the column is dirty. The counts are summed by (language,
    bucket), at most 65,536 rows for each language, whatever the table's size. doc_id decides the draw
    alone. An empty table gives a model that knows no language.
    """
    one = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    known = docs.filter(F.col("lang").isNotNull()).select(
        whole_text().alias("text"), F.col("lang").cast("string").alias("lang"), one.alias("row")
    )
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["n"] for r in frequent.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("text", "lang", "row"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(F.col("lang").isin(langs)).filter(draw < share).drop("row").repartition(8)
    counts = np.full((len(langs), 1 << BUCKET_BITS), smoothing)
    totals = arrow_map(sample, _count(langs), "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = totals.toArrow()
    counts[table["lang"].to_numpy(), table["bucket"].to_numpy()] += table["n"].to_numpy()
    prior = np.log(np.array([sizes[k] for k in langs], float))
    log_probability = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return Model(langs, np.ascontiguousarray(log_probability, np.float32), prior - np.logaddexp.reduce(prior))


def classify(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    names, scores = [], [np.empty(0)]
    for low, high in _slices(texts):
        starts, buckets, _, letters = _grams(texts[low:high])
        total = np.zeros((high - low, len(model.langs)))
        if model.langs:
            for b in buckets:
                total += np.add.reduceat(model.log_probability[b], starts, axis=0, dtype=np.float64)
            total += model.log_prior
            total = np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])
            best = total.argmax(axis=1)
            names += [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            scores.append(np.where(letters, total.max(axis=1).clip(0, 1), 0.0))
        else:
            names += [UNKNOWN] * (high - low)
            scores.append(np.zeros(high - low))
    return names, np.concatenate(scores)


@kept(maxsize=2)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def _classify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            names, scores = classify(batch.column(0).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and lang_pred (string) and score (double, the posterior probability).

    Only `text` is looked at. Texts that are null, empty or hold no letter, and all texts when nothing
    was learned, are `und` with score 0; n-grams of any length of text count. Ties go to the language
    that sorts first. Columns named like the results are replaced.

    The model (65,536 x languages x 4 bytes) is broadcast; its size does not depend on the corpus.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (text,) = fresh_names(docs, "whole")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    fields = [f for f in docs.schema.fields if f.name in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return arrow_map(
        docs.select(whole_text().alias(text), *own), _classify(shared), f"{schema}, lang_pred string, score double"
    )


def remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, mod n. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
