"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_names, kept, landed, whole_text

LETTERS = 32
DECAY = 0.7
LEAST_LIKENESS = 0.0  # no likeness is too small to count
LISTED = 16  # words of up to so many letters have their triples listed, longer ones go through a dense table
CACHE_WORDS = 200_000
AT_ONCE_WORDS = 20_000
AT_ONCE_TRIPLES = 1 << 20
AT_ONCE_DENSE = 16
AT_ONCE_TOKENS = 50_000

_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_MAY_BE_SPELLED = re.compile(r"\s\S\s\S\s")


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """For each code point: 0 if it is no letter, a-z as 1-26 also under accents, others 27-31."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            table[i] = ord(base) - 96 if "a" <= base <= "z" else 27 + i % 5
    return table


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter codes of all words, one after the other, and the word of each."""
    text = "".join(words)
    codes = _codes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return codes[codes > 0], owner[codes > 0]


@lru_cache(maxsize=LISTED + 1)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of three letters of a word (3 x triples), and their weights."""
    at = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3).T
    return at, DECAY ** (at[2] - at[0] + 1.0)


def _dense(words: list[np.ndarray]) -> np.ndarray:
    """Feature vectors (words x triples) of letter codes of any length, letter by letter."""
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    lengths = np.array([len(words[i]) for i in order])
    ones, twos = np.zeros((len(words), LETTERS)), np.zeros((len(words), LETTERS, LETTERS))
    last_first = np.zeros((len(words), LETTERS, LETTERS, LETTERS))  # the third letter leads
    for t in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -t))  # words longer than t
        row, code = np.arange(n), np.array([words[i][t] for i in order[:n]])
        last_first[row, code] += DECAY * twos[:n]
        twos[row, :, code] += ones[:n]
        ones[row, code] += 1
        ones[:n] *= DECAY
        twos[:n] *= DECAY
    out = np.empty((len(words), LETTERS**3))
    out[order] = last_first.transpose(0, 2, 3, 1).reshape(len(words), -1)
    return out


def _norms(codes: np.ndarray) -> np.ndarray:
    """Lengths of the feature vectors of words (words x letters) of one length: the kernel with themselves."""
    gap = np.arange(codes.shape[1])[:, None] - np.arange(codes.shape[1])
    reach = np.where(gap > 0, DECAY ** np.maximum(gap, 0.0), 0.0)
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float64)
    pairs = same * (reach @ same @ reach.T)
    return DECAY * np.sqrt((same * (reach @ pairs @ reach.T)).sum(axis=(1, 2)))


def _split(words: list[str]) -> list[np.ndarray]:
    codes, owner = _joined(words)
    ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
    return [codes[low:high] for low, high in zip([0, *ends], ends)]


def _vectors(words: list[str]) -> np.ndarray:
    """Unit feature vectors (words x triples) of few words; no letters or under three give zeros."""
    out = _dense(_split(words))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _runs(first: np.ndarray, end: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Step through runs of consecutive places that begin at `first`, all runs at once.

    Gives for the first place of all runs, then for the second place of those that have one and so on,
    the runs (as the first ones of `_longest_first`) and the places there.
    """
    order = _longest_first(first, end)
    start, sizes = first[order], np.diff(first, append=end)[order]
    for i in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -i))  # runs longer than i
        yield slice(0, n), start[:n] + i


def _longest_first(first: np.ndarray, end: int) -> np.ndarray:
    return np.argsort(-np.diff(first, append=end), kind="stable")


class Kernel:
    """Likeness of words to landmarks: the normalised gap-weighted subsequence kernel of order three.

    Every subsequence of three letters counts, however far it spreads, with weight DECAY ** length, and
    every likeness is kept. Long words take time in proportion to their length. Letters put between those
    of a landmark lower its likeness by the subsequences that they add; its share counts only what the word
    has of the landmark's own, so such words stand out from common short ones.
    """

    def __init__(self, landmarks: list[str]) -> None:
        features = _dense(_split(landmarks))
        self.sizes = np.maximum(np.linalg.norm(features, axis=1), 1e-12)
        features /= self.sizes[:, None]
        self.used = np.flatnonzero(features.any(axis=0))
        self.slot = np.full(LETTERS**3, -1, np.int64)
        self.slot[self.used] = np.arange(len(self.used))
        self.values = np.ascontiguousarray(features[:, self.used].T, np.float32)
        self.letters = np.isin(np.arange(LETTERS), np.stack([self.used >> 10, self.used >> 5 & 31, self.used & 31]))
        self.m = len(landmarks)

    def likeness(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words that share a subsequence with any landmark, by number, and their likeness to each."""
        found, sums, norms = self.of_codes(_split(words))
        return found, sums / norms[:, None]

    def of_codes(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As likeness, of letter codes: the products with each landmark, and the lengths of the words' vectors.

        A product by its word's length is the likeness; by the landmark's it is the landmark's share in the word.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found, sums, norms = [np.empty(0, np.int64)], [np.empty((0, self.m), np.float32)], [np.empty(0, np.float32)]
        for length in np.unique(lengths[(lengths >= 3) & (lengths <= LISTED)]).tolist():
            (i, j, k), weights = _places(length)
            at = np.flatnonzero(lengths == length)
            codes = np.stack([words[x] for x in at.tolist()]).astype(np.int64)
            step = max(1, AT_ONCE_TRIPLES // (8 * len(weights)))
            for low in range(0, len(at), step):
                part = codes[low : low + step]
                slot = self.slot[(part[:, i] * LETTERS + part[:, j]) * LETTERS + part[:, k]]
                row, place = np.nonzero(slot >= 0)
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                slot, weight = slot[row, place], weights[place, None].astype(np.float32)
                near, order = row[first], _longest_first(first, len(row))
                summed = np.zeros((len(near), self.m), np.float32)
                for runs, x in _runs(first, len(row)):
                    summed[runs] += self.values[slot[x]] * weight[x]
                found.append(at[low + near[order]])
                sums.append(summed)
                norms.append(_norms(part[near[order]]).astype(np.float32))
        long = [x for x in np.flatnonzero(lengths > LISTED).tolist() if self.letters[words[x]].sum() >= 3]
        long.sort(key=lengths.__getitem__)
        for low in range(0, len(long), AT_ONCE_DENSE):
            part = np.array(long[low : low + AT_ONCE_DENSE])
            features = _dense([words[x] for x in part.tolist()])
            summed = (features[:, self.used] @ self.values).astype(np.float32)
            near = summed.any(axis=1)
            found.append(part[near])
            sums.append(summed[near])
            norms.append(np.linalg.norm(features[near], axis=1).astype(np.float32))
        numbers = np.concatenate(found)
        order = np.argsort(numbers)
        return numbers[order], np.concatenate(sums)[order], np.concatenate(norms)[order]


@dataclass
class Model:
    landmarks: list[str]
    whiten: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -60.0]))

    def score(self, pooled: np.ndarray, words: np.ndarray) -> np.ndarray:
        decisions = pooled @ (self.whiten @ self.weights) + self.bias
        logits = np.stack([decisions, np.log1p(words)], axis=1) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


class Reader:
    """Finds the words of texts that are like landmarks; a bounded cache keeps what words were."""

    def __init__(self, landmarks: list[str]) -> None:
        self.kernel = Kernel(landmarks)
        self._start_over()

    def _start_over(self) -> None:
        self.where: dict[str, int] = {}  # of each word twice its row, and 1 if a sentence ends in it
        self.row_of: dict[bytes, int] = {}  # by letters alone
        self.rows = np.zeros((1024, self.kernel.m), np.float32)
        self.scale = np.zeros(1024, np.float32)  # what makes a row a likeness
        self.filled = 1

    def _find(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.where.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            if self.where and len(self.where) + len(missing) > 4 * CACHE_WORDS or self.filled > CACHE_WORDS:
                self._start_over()
                return self._find(words)
            new = list(dict.fromkeys(words[i] for i in missing))
            for low in range(0, len(new), AT_ONCE_WORDS):
                part = new[low : low + AT_ONCE_WORDS]
                keys = [c.tobytes() for c in _split(part)]
                unknown = [k for k in dict.fromkeys(keys) if k not in self.row_of]
                self._add(unknown)
                self.where.update((w, 2 * self.row_of[k] + (w[-1] in ".!?")) for w, k in zip(part, keys, strict=True))
            at[missing] = [self.where[words[i]] for i in missing]
        return at

    def _add(self, keys: list[bytes]) -> None:
        found, sums, norms = self.kernel.of_codes([np.frombuffer(k, np.uint8) for k in keys])
        self.row_of.update(dict.fromkeys(keys, 0))
        end = self.filled + len(found)
        self.row_of.update(zip([keys[i] for i in found.tolist()], range(self.filled, end), strict=True))
        if end > len(self.rows):
            more = max(end, 3 * len(self.rows) // 2) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.kernel.m), np.float32)])
            self.scale = np.concatenate([self.scale, np.zeros(more, np.float32)])
        self.rows[self.filled : end], self.scale[self.filled : end] = sums, 1 / norms
        self.filled = end

    def _describe(self, texts: list[list[str]]) -> np.ndarray:
        known = self._find([w for t in texts for w in t])
        m = self.kernel.m
        best, total = np.zeros((len(texts), 2 * m)), np.zeros((len(texts), m))
        hot = np.flatnonzero(known > 1)
        if len(hot):
            of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[hot]
            sentence = np.cumsum(known & 1)[hot]
            first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
            word, order = known[hot] >> 1, _longest_first(first, len(hot))
            like, shared = np.zeros((len(first), m), np.float32), np.zeros((len(first), m), np.float32)
            for runs, x in _runs(first, len(hot)):
                rows = self.rows[word[x]]
                np.maximum(shared[runs], rows, out=shared[runs])
                rows *= self.scale[word[x], None]
                np.maximum(like[runs], rows, out=like[runs])
            back = np.argsort(order)  # sentences of a text side by side again
            start = np.flatnonzero(np.diff(of[first], prepend=-1))
            mine, order = of[first][start], _longest_first(start, len(first))
            mine = mine[order]
            for runs, x in _runs(start, len(first)):
                text, one = mine[runs], like[back[x]].astype(np.float64)
                best[text] = np.maximum(best[text], np.hstack([one, shared[back[x]] / self.kernel.sizes]))
                total[text] += one**2
        return np.hstack([best[:, :m], np.log1p(total), np.minimum(best[:, m:], 1)])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its sentences' likeness to each landmark, and the words of each text.

        A sentence is as like a landmark as its likest word. Of the sentences come the greatest likeness
        (m columns), the logarithm of 1 + the sum of its squares (m more) and each landmark's greatest share
        in a word (m more).
        """
        pooled, counts = [np.empty((0, 3 * self.kernel.m))], np.zeros(len(texts), np.int64)
        part: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            text = text.lower()
            if _MAY_BE_SPELLED.search(text):
                text = _SPELLED.sub(lambda m: "".join(m[0].split()), text)
            part.append(text.replace("\n", " . ").split())
            counts[i] = len(part[-1])
            size += counts[i]
            if size >= AT_ONCE_TOKENS or i + 1 == len(texts):
                pooled.append(self._describe(part))
                part, size = [], 0
        return np.concatenate(pooled), counts


@kept(maxsize=1)
def _reader(landmarks: tuple[str, ...]) -> Reader:
    return Reader(list(landmarks))


@kept(maxsize=1)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def _describe(landmarks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled, words = _reader(tuple(landmarks)).documents(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(list(pooled), pa.list_(pa.float64())), pa.array(words)],
                ["toxic", "pooled", "words"],
            )

    return run


def _landmarks(sample: DataFrame, n_toxic: int, n_clean: int, most: int, candidates: int) -> list[str]:
    """The words whose documents are most surprisingly toxic, none too like another."""
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "))
    counts = (
        sample.select("toxic", F.explode(words).alias("word"))
        .filter(F.length("word").between(3, 24))
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter("t >= 3")
    )
    surprise = F.col("t") * F.log((F.col("t") / n_toxic) / ((F.col("c") + 0.5) / max(n_clean, 1)))
    top = counts.withColumn("s", surprise).filter("s > 0").orderBy(F.desc("s"), "word").limit(candidates).collect()
    words = [r["word"] for r in top]
    if not words:
        return []
    near = _vectors(words)
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) == most:
            break
        if near[i].any() and all(near[i] @ near[j] < 0.9 for j in chosen):
            chosen.append(i)
    return [words[i] for i in chosen]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by dual coordinate descent; the bias is a feature."""
    z = np.hstack([x, np.ones((len(x), 1))])
    norms, alpha, w = np.einsum("ij,ij->i", z, z), np.zeros(len(z)), np.zeros(z.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(z)):
            new = min(max(alpha[i] + (1 - y[i] * (w @ z[i])) / norms[i], 0.0), c * cost[i])
            w += (new - alpha[i]) * y[i] * z[i]
            alpha[i] = new
    return w[:-1], float(w[-1])


def _calibrate(measures: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The logistic curve that fits best, by Newton's method; the last weight is the constant."""
    x, w = np.hstack([measures, np.ones((len(y), 1))]), np.zeros(measures.shape[1] + 1)
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x.T * (count * p * (1 - p))) @ x + ridge, x.T @ (count * (y - p)) - ridge @ w)
    return w


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 4000, landmarks: int = 96, candidates: int = 400
) -> Model:
    """Learn from docs (doc_id, text) with labels (doc_id, toxic 0/1); null labels are left aside.

    About `per_class` documents of each class are drawn by a hash: a bounded sample of whole texts, of
    which one vector each comes to the driver. Landmarks are words of toxic documents. The vectors are
    mapped by the inverse root of the landmarks' kernel matrix (Nystroem), a linear machine with hinge
    loss is fitted to them, and a logistic curve to its decisions and the lengths.

    Label rows that repeat count once; a document labelled both ways is an example of each class. A
    doc_id of several rows is that many examples. Labels without a document, and null doc_ids, teach
    nothing. Texts are read whole, however long, a sentence at a time; null and empty ones have no words.
    Without rows of both classes the model gives the one class there is, or 0.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return _constant(bool(sizes.get(1)))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.broadcast(known.filter(draw < share).distinct())  # about twice per_class rows
    sample = landed(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .join(drawn, "doc_id")
        .select("text", "toxic")
        .repartition(16)
    )
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return _constant(bool(n.get(1)))
    names = _landmarks(sample, n[1], n[0], landmarks, candidates)
    if not names:
        return _constant(False)
    table = arrow_map(sample, _describe(names), "toxic int, pooled array<double>, words bigint").toArrow()
    toxic, words = table["toxic"].to_numpy(), table["words"].to_numpy()
    pooled = np.array(table["pooled"].to_pylist())
    near = _vectors(names)
    values, axes = np.linalg.eigh(near @ near.T)
    whiten = np.kron(np.eye(3), axes / np.sqrt(np.maximum(values, 1e-3)) @ axes.T)
    weights, bias = _svm(pooled @ whiten, np.where(toxic == 1, 1.0, -1.0), np.where(toxic == 1, 3.0, 1.0))
    decisions = pooled @ (whiten @ weights) + bias
    # The sample holds more toxic documents than the corpus: rows count for what they stand for.
    stand = np.where(toxic == 1, sizes[1] / n[1], sizes[0] / n[0])
    curve = _calibrate(np.stack([decisions, np.log1p(words)], axis=1), toxic, stand / stand.mean())
    return Model(names, whiten, weights, bias, curve)


def _constant(toxic: bool) -> Model:
    return Model([], curve=np.array([0.0, 0.0, 60.0 if toxic else -60.0]))


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if model.landmarks:
                scores = model.score(*_reader(tuple(model.landmarks)).documents(texts))
            else:
                scores = model.score(np.zeros((len(texts), 0)), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"]
            )

    return run


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, score (double, 0 to 1) and predicted (int, 1 if score is 0.5 or more).

    Only `text` is looked at. A sentence (up to a word that ends in . ! or ?, or a line's end) is known
    by the greatest likeness of its words to each landmark, a document by the sums over its sentences.
    Letters alone count, accents and case do not; three or more letters spelled out with single spaces
    are one word, and marks inside a word are skipped. Null and empty texts, and texts with nothing like
    a landmark, get the score of a text of as many words without any likeness. Where only one class was
    learned from, that class; where none, 0. Columns named like the results are replaced. Texts count
    whole, however long; repeated rows get the same score each; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    (text,) = fresh_names(docs, "whole")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # some 64 words and their weights
    fields = [f for f in docs.schema.fields if f.name in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = arrow_map(docs.select(whole_text().alias(text), *own), _judge(shared), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
