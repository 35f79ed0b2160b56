"""License notices, fill-in-middle and collocations against plain Python on small tables."""

import hashlib
import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bendpoint.llm import collocations, common, fim, licenses

from .conftest import rows

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def distance(notice: licenses.Notice, text: str) -> int:
    """Least number of characters to add, drop or change, with the fixed ones as they are."""
    fixed = [f for part, f in notice.parts for _ in part]
    m, far = len(fixed), 99
    row = []
    for i in range(m + 1):
        shut = (i == 0 or fixed[i - 1]) and (i == m or fixed[i])
        new = []
        for j in range(len(text) + 1):
            best = 0 if i == j == 0 else far
            if j and not shut:
                best = min(best, new[j - 1] + 1)
            if i and not fixed[i - 1]:
                best = min(best, row[j] + 1)
            if i and j and (notice.text[i - 1] == text[j - 1] or not fixed[i - 1]):
                best = min(best, row[j - 1] + (notice.text[i - 1] != text[j - 1]))
            new.append(best)
        row = new
    return row[-1]


def brute_notices(text, notices):
    """Labels of the notices that some run of whole words equals within the errors, and the best score."""
    words = re.findall(WORD, text.translate(LOWER))
    labels, score = set(), 0.0
    for notice in notices:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if abs(len(run) - len(notice.text)) <= notice.errors:
                    found = distance(notice, run)
                    if found <= notice.errors:
                        labels.add(notice.label)
                        score = max(score, 1 - found / (notice.errors + 1))
    return labels, score


def brute_base(text):
    words = re.findall(WORD, text.translate(LOWER))
    found = [
        (i, label)
        for phrase, label in licenses.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(found)


def test_notices_by_brute_force(docs_of):
    draw = random.Random(3)
    notices = [licenses.Notice.read(label, marked, 10) for label, marked in licenses.NOTICES]
    texts = []
    for _ in range(60):
        notice = draw.choice([n for n in notices if len(n.text) < 50])
        letters = list(notice.text)
        for _ in range(draw.randrange(0, notice.errors + 2)):
            at = draw.randrange(len(letters))
            letters[at : at + draw.randrange(2)] = draw.choice(["", "e", "l", " ", "3"])
        texts.append(f"É Foo, {''.join(letters).upper()} the mit (baz)")
    out = licenses.scan(docs_of(list(enumerate(texts)))).collect()
    for r in out:
        n, base = brute_base(r.text)
        labels, score = brute_notices(r.text, notices)
        assert (r.n_words, r.n_base, set(r.base_labels)) == (n, len(base), {label for _, label in base})
        assert set(r.labels) == labels | {label for _, label in base}, r.text
        assert r.score == pytest.approx(1.0 if base else score)
        for s in r.spans:
            inside, _ = brute_notices(r.text[s.start : s.end], notices)
            assert s.label in inside


def test_license_cases(docs_of):
    docs = [
        (1, "Under the MIT License; under the mit\nlicense."),
        (2, "Licensed under the Apache Licence, Version 2.0, CC BY-NC 4.0"),
        (3, "Das ist mit Lizenz. limit license"),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, None),
        (6, ""),
        (7, "x " * 200_000 + "under the MIT Licens " + "under the " * 20_000),
        (8, "released under the MITT license, under the mpl license, apache license version 3"),
        (None, "cc by nc cc by nc"),
        (1, "Under the MIT License; under the mit\nlicense."),
    ]
    table = docs_of(docs).withColumns({"Score": F.lit("own"), "spans": F.lit(1), "h1": F.lit(5)})
    out = licenses.scan(table)
    assert "h1" in out.columns and "Score" not in out.columns
    got = {(r.doc_id): r for r in out.collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 1 - 1, 4, ["mit"])
    assert got[2].base_labels == ["cc-by-nc"] and got[2].labels == ["apache-2", "cc-by-nc"]
    apache = next(s for s in got[2].spans if s.label == "apache-2")
    assert got[2].text[apache.start : apache.end] == "Apache Licence, Version 2" and apache.errors == 1
    assert got[3].labels == [] and got[3].score == 0 and got[3].first_word is None
    assert got[4].labels == ["gpl-3"] and got[4].n_base == 0 and got[4].score == 1
    assert got[5].n_words == 0 and got[6].n_words == 0
    assert got[7].labels == ["mit"] and 0 < got[7].score < 1 and got[7].n_words == 240_004
    assert got[8].labels == []
    assert got[None].n_base == 2 and got[None].last_word == 3
    assert out.filter("doc_id = 1").count() == 2
    assert licenses.scan(docs_of([])).count() == 0


def brute_fim(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_fill_in_middle(docs_of, monkeypatch):
    draw = random.Random(7)
    docs = [(i, "".join(draw.choice("aé漢😀<P>SM \n") for _ in range(draw.randrange(0, 30)))) for i in range(300)]
    docs += [(-5, "<"), (400, None), (401, ""), (402, "S>"), (403, "P>x"), (None, "no id"), (7, "twice"), (7, "twice")]
    docs += [(404, "long é漢 " * 300_000), (405, "<P"), (406, ">"), (407, "<S<P><")]
    table = docs_of(docs).withColumns({"N": F.lit(3), "restored": F.lit(1), "h1": F.lit("own")})
    out = fim.restore(fim.transform(table))
    assert "h1" in out.columns and "N" not in out.columns
    got = rows(out, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert got == sorted((brute_fim(*d) for d in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(docs_of([]))).count() == 0


def test_restore_refuses_what_no_form_made(spark):
    bad = [("psm", "<P>a<S>b"), ("psm", "x<P>a<S>b<M>c"), ("spm", "<P>a<S>b<M>c"), (None, "a"), ("psm", None), ("odd", "a")]
    out = fim.restore(spark.createDataFrame(bad, "form string, output string"))
    assert [r.restored for r in out.collect()] == [None] * 6


def test_displacement_over_small_blocks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(fim, "BLOCK", 3)
    starts, shifts = np.array([0, 0, 4, 4, 7, 10]), np.array([5, 2, 9, -1, 0, 3])
    got = np.concatenate([place for _, _, place in fim.displaced(starts, shifts, 10)])
    assert got.tolist() == [2, 3, 4, 5, 3, 4, 5, 7, 8, 9]


def brute_collocations(docs, min_count, max_words, covered_percent):
    n, f = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if a >= min_count and len(x) > 2}
    out = []
    for (lang, *words), a in found.items():
        m = len(words)
        inside = [
            b
            for (other, *longer), b in found.items()
            if other == lang and len(longer) > m
            and any(longer[i : i + m] == words for i in range(len(longer) - m + 1))
        ]
        if any(100 * b >= covered_percent * a for b in inside):
            continue
        cuts = []
        for k in range(1, m):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk_bytes", "most_known"), [(40, 1 << 19), (1 << 20, 3)])
def test_collocations_by_brute_force(docs_of, monkeypatch, chunk_bytes, most_known):
    """Over many chunks and few, with the frequent phrases broadcast and, beyond the bound, joined."""
    monkeypatch.setattr(collocations, "MOST_KNOWN", most_known)
    draw = random.Random(11)
    vocabulary = ["a", "B", "ç", "d", "e f", "g.", "h,", "\tx", "y\n", "z;z"]
    docs = [(i, " ".join(draw.choices(vocabulary, [9, 8, 7, 6, 5, 2, 2, 2, 1, 1], k=draw.randrange(60))), draw.choice(["en", None, "de"])) for i in range(120)]
    docs += [(500 + i, "one passage that many documents share, word by word by word", "en") for i in range(30)]
    docs += [(600, None, "en"), (601, "", None), (602, "... ;; \t\t", "fr"), (None, "a b a b a b", None), (7, "a a a a a a", "und")]
    table = docs_of(docs).withColumn("phrase", F.lit("own")).withColumn("chunk", F.lit(1))
    for percent in (100, 60):
        out = collocations.collocations(table, 12, 5, percent, chunk_bytes)
        want = brute_collocations(docs, 12, 5, percent)
        assert rows(out, "lang", "phrase", "a", "l", "r", "n", "score") == want and len(want) > 20


def test_collocations_of_no_rows_and_exact_products(docs_of, spark):
    assert collocations.collocations(docs_of([])).count() == 0
    assert collocations.collocations(docs_of([(1, "a b c", "en")])).count() == 0
    assert collocations.collocations(docs_of([(1, "only one word a piece." * 3, "en")]), 2, 1).count() == 0


def test_long_text_is_cut_between_pieces():
    data = b"a b.c d e.f.g h i j k"
    for size in range(1, 30):
        assert b".".join(collocations._cut(data, size)) == data


def test_words_are_split_a_part_at_a_time(monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 7)
    for data in (b"", b"a", b" . ", b"ab.c d  e f.. gh ijklmnopqrstu v w", b"a.b.c.d.e.f.g.h.i.j k l.m n o p"):
        parts = list(collocations._tokens(data))
        assert [w for part in parts for w in part] == data.replace(b".", b" . ").split()
    assert len(parts) > 1


def memory_of(func):
    """The result, and the most bytes that numpy, Python and Arrow held on the way."""
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        out = func()
        return out, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
    finally:
        tracemalloc.stop()


def test_a_chunk_takes_few_bytes_an_occurrence():
    """A task's memory beside the text: 200,000 occurrences of 20,000 words, nearly all pairs different."""
    n, words = 200_000, 20_000
    groups = np.random.default_rng(3).integers(0, words, n)
    row = {
        "chunk": pa.scalar(5),
        "lang": pa.scalar("en"),
        "n": pa.scalar(n),
        "places": pa.scalar(collocations._pack(np.ones(n, np.int64))),
        "groups": pa.scalar(collocations._pack(groups)),
    }
    ids = np.random.default_rng(4).permutation(1 << 20)[:words]
    ids[::7] = -1
    collocations._extended(row, ids)
    out, most = memory_of(lambda: collocations._extended(row, ids))
    assert most < 90 * n
    at = np.flatnonzero((ids[groups[:-1]] >= 0) & (ids[groups[1:]] >= 0))
    keys = out.column("keys")[0].values
    got = collocations._unpack(out.column("groups")[0], len(at))
    assert np.array_equal(np.cumsum(collocations._unpack(out.column("places")[0], len(at))), at + 1)
    assert np.array_equal(np.asarray(keys.field("left"))[got], ids[groups[at]])
    assert np.array_equal(np.asarray(keys.field("right"))[got], ids[groups[at + 1]])
    assert np.array_equal(np.asarray(out.column("counts")[0].values), np.bincount(got))


def test_known_words_take_few_bytes_a_word():
    n = 50_000
    rows_ = pa.table({"lang": ["en"] * n + ["de"], "word": [f"w{i}" for i in range(n)] + ["w1"], "id": range(n + 1)})
    packed = pickle.dumps(collocations.KnownWords(rows_))
    known, most = memory_of(lambda: pickle.loads(packed))
    assert most < 64 * n

    def ask(lang, *words):
        return known({"lang": pa.scalar(lang), "keys": pa.scalar(list(words), pa.list_(pa.string()))}).tolist()

    assert ask("en", "w7", "none", "w0") == [7, -1, 0]
    assert ask("de", "w0", "w1") == [-1, n]
    assert ask("fr", "w0") == [-1] and ask("en") == []


def test_batches_are_short_for_a_while(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes():
        counted = common.arrow_map(df, lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n bigint")
        return [r.n for r in counted.collect()]

    before = spark.conf.get(name, None)
    assert sizes() == [60]
    with common.short_batches(spark, 50_000):
        short = sizes()
    assert sum(short) == 60 and max(short) <= 6
    assert spark.conf.get(name, None) == before
    spark.conf.set(name, "1m")
    try:
        with pytest.raises(ValueError), common.short_batches(spark):
            raise ValueError
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
