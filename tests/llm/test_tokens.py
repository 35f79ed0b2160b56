"""Tokenizing by pieces, packing and token-id files: equal to the tokenizer, exact round trips."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bendpoint.llm import packing, tokenids, tokens
from bendpoint.llm.common import scratch_folder

from .conftest import rows

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
TEXTS = [
    "a  b\n\nc \n d\t\te", "x' s 's'll é́ é ́b", "<|endoftext|> hi<|startoftext|>", "", "  lead", "trail  \n",
    "Σας ΣΑΣ　ab\x1cb\x85c d\x0bd\x0ce\r\nf  g", "İstanbul 12 345 a1b2", "\n", " ", "one", "nul\x00l z",
    "many words " * 3000, "end.\nStart of a line\nand one more",
]


@pytest.mark.parametrize(("file", "cut"), [(WORD, "drop"), (BYTE, "lead")])
def test_pieces_equal_the_tokenizer(file, cut, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    mine, whole = tokens.Pieces(file, cut, 7), Tokenizer.from_file(file)
    for _ in range(2):
        flat, counts = mine.encode(TEXTS)
        parts = np.split(flat, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in TEXTS]


@pytest.mark.parametrize(("file", "cut"), [(WORD, "drop"), (BYTE, "lead")])
def test_every_letter_with_marks_behind_it(file, cut):
    """One text for each letter, so that a wrong split of one shows."""
    letters = [chr(c) for c in range(0x80, 0x20000) if chr(c).isalpha() and not 0xAC10 < c < 0xD7A3 and not 0x4E20 < c < 0x9FFF]
    mine, whole = tokens.Pieces(file, cut, 7), Tokenizer.from_file(file)
    for tail in ("-", "'s", "."):
        texts = [f"ab{x}{tail} {x}{tail}" for x in letters]
        flat, counts = mine.encode(texts)
        want = [[*e.ids, 7] for e in whole.encode_batch(texts, add_special_tokens=False)]
        parts = np.split(flat, np.cumsum(counts)[:-1])
        assert [t for t, p, w in zip(texts, parts, want, strict=True) if p.tolist() != w] == []


def test_each_word_is_asked_once_and_many_words_together(monkeypatch):
    """Looking up every word and asking for new ones one by one was most of the CPU time of token files."""
    draw = np.random.default_rng(5)
    words = ["".join(draw.choice(list("abcdeéß7'_"), 9)) for _ in range(3000)] + ["'s", "1", "ǆ", "한국", "x's", "<P>"]
    texts = [" ".join(draw.choice(words, 200)) for _ in range(300)] + TEXTS + ["a\nb\nc d", "\nlead", "x\n", "x \ny", "x\n y"]
    mine, whole = tokens.Pieces(BYTE, "lead", 7), Tokenizer.from_file(BYTE)
    asked, looked_up = [], []
    encoded, find = mine._encoded, mine._find
    monkeypatch.setattr(mine, "_encoded", lambda parts: asked.extend(parts) or encoded(parts))
    monkeypatch.setattr(mine, "_find", lambda keys: looked_up.extend(keys) or find(keys))
    flat, counts = mine.encode(texts)
    got = np.split(flat, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in got] == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert len(looked_up) == len(set(looked_up)) and len(asked) < len(words) / 5
    # Where the bytes of ids don't tell words apart, each is asked for by itself.
    plain = tokens.Pieces(BYTE, "lead", 7)
    plain.id_bytes += 1
    assert np.array_equal(plain.encode(texts)[0], flat)


def test_marks_behind_letters_are_no_new_words():
    draw = np.random.default_rng(6)
    ends = [",", ".", "!", "?", ";", ":", "...", ",.", ").", '".', "'s.", "1.", "1,", ".a,", "é,", "é;.", "한.", "'.", "x's,"]
    texts = [" ".join(f"word{e}" for e in draw.choice(ends, 40)) for _ in range(50)] + TEXTS
    texts += ["a.", ".", "a,\nb.\n", ", a", "a .", "a,b, c", "a.\nb,\nÉ. e.", "it's. 's, 'll."]
    mine, whole = tokens.Pieces(BYTE, "lead", 7), Tokenizer.from_file(BYTE)
    flat, counts = mine.encode(texts)
    got = np.split(flat, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in got] == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert "word" in mine.where and not {"word,", "word.", "word!"} & set(mine.where)


def test_little_padding_over_many_partitions(docs_of):
    draw = np.random.default_rng(2)
    docs = docs_of([(i, "some words of a text " * int(draw.integers(1, 300))) for i in range(1500)])
    out = packing.pack(docs.repartition(64), WORD).toPandas()
    assert out.length.sum() > 0.97 * 2048 * out.sequence_id.nunique()


def test_best_fit_takes_the_tightest_window():
    draw = np.random.default_rng(0)
    lengths = draw.integers(1, 64, 500)
    window, offset, n = packing.best_fit(lengths, 64)
    room, where = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if fits:
            tight = min(r for r, _ in fits)
            assert room[window[i]] == tight
        else:
            assert window[i] == len(room)
            room.append(64)
        assert offset[i] == 64 - room[window[i]]
        room[window[i]] -= lengths[i]
        where.setdefault(window[i], []).append(i)
    assert n == len(room) and lengths.sum() / (64 * n) > 0.93


def test_packing(docs_of):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "no id"), (3, ""), (3, "")]
    table = docs_of(docs).withColumn("ids", F.lit("clash"))
    out = packing.pack(table, WORD, capacity=64, chunk_ids=2000).toPandas()
    whole = Tokenizer.from_file(WORD)
    want = sorted((str(i), tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in docs)
    got = []
    for key, part in out.assign(key=out.doc_id.map(lambda x: "None" if x != x else str(int(x)))).groupby("key"):
        if key == "3":
            got += [("3", tuple(np.frombuffer(x, "<u4").tolist())) for x in part.ids]
            continue
        part = part.sort_values("start")
        assert part.start.tolist() == (part.length.cumsum() - part.length).tolist()
        assert (part.length.sum() == part.doc_tokens).all()
        got.append((key, tuple(np.concatenate([np.frombuffer(x, "<u4") for x in part.ids]).tolist())))
    assert sorted(got) == want
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist()
        assert part.length.sum() <= 64
    assert packing.pack(docs_of([]), WORD).count() == 0


def test_grammar_round_trip():
    draw = np.random.default_rng(1)
    counts = np.array([1, 4000, 1, 2500, 1, 997])
    ids = np.where(draw.random(counts.sum()) < 0.7, draw.integers(0, 6, counts.sum()), draw.integers(0, 50_000, counts.sum()))
    ids = ids.astype(np.uint32)
    ids[100:400] = 5  # runs of one id overlap themselves
    for base in (50_257, 1 << 17):
        symbols, starts, rules, lengths = tokenids.compress(ids, counts, base)
        assert np.array_equal(tokenids.expand(symbols, rules, lengths, base), ids)
        assert len(symbols) < len(ids) and len(rules) and len(starts) == len(counts)
        assert (rules < base + np.arange(len(rules))[:, None]).all()
        block = {"starts": starts.tobytes(), "symbols": symbols.astype("<u4").tobytes(), "width": 4, "rules": rules.tobytes(), "lengths": lengths.tobytes(), "base": base}
        ends = np.cumsum(counts)
        for k, n in enumerate(counts):
            assert np.array_equal(tokenids.read_document(block, k), ids[ends[k] - n : ends[k]])


def test_grammar_goes_on_until_no_pair_is_frequent():
    draw = np.random.default_rng(4)
    passage, n = draw.integers(0, 50_000, 700), 200
    docs = [np.concatenate([draw.integers(0, 50_000, 5), passage, [2]]) for _ in range(n)]
    ids, counts = np.concatenate(docs).astype(np.uint32), np.full(n, 706)
    symbols, _, rules, lengths = tokenids.compress(ids, counts, 50_257)
    assert np.array_equal(tokenids.expand(symbols, rules, lengths, 50_257), ids)
    assert lengths.max() >= 700 and len(symbols) <= n * 7
    pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
    inside = np.ones(len(symbols) - 1, bool)
    inside[np.flatnonzero(symbols[:-1] == 2)] = False
    assert np.unique(pairs[inside], return_counts=True)[1].max(initial=0) < tokenids.LEAST_COUNT


def test_symbols_of_every_width():
    for width, top in ((2, 1 << 16), (3, 1 << 24), (4, 1 << 32)):
        values = np.array([0, 1, 255, 256, top - 1], np.uint32)
        assert tokenids._narrow(tokenids._wide(values, width), width).tolist() == values.tolist()


def test_token_files(spark, docs_of):
    docs = [(i * 3 % 41, t) for i, t in enumerate(TEXTS * 2)] + [(None, "no id"), (77, None), (3, "again"), (3, "again")]
    folder = scratch_folder(spark, "test-ids")
    tokenids.write_ids(docs_of(docs).withColumn("mark", F.lit(1)), folder, BYTE, shards=3, block_ids=500)
    out = tokenids.read_ids(spark, folder).orderBy("start").collect()
    whole = Tokenizer.from_file(BYTE)
    want = sorted((str(i), tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in docs)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert ids == sorted(ids)
    assert [r.start for r in out] == (np.cumsum([r.n_tokens for r in out]) - [r.n_tokens for r in out]).tolist()
    assert all(zlib.crc32(r.ids) for r in out)
    folder = scratch_folder(spark, "test-no-ids")
    tokenids.write_ids(docs_of([]), folder, BYTE)
    assert rows(tokenids.read_ids(spark, folder), "doc_id") == []


def test_a_block_ends_with_the_document_that_fills_it(spark, docs_of):
    folder = scratch_folder(spark, "test-blocks")
    tokenids.write_ids(docs_of([(i, "a b c d e f g h i") for i in range(60)]), folder, BYTE, shards=1, block_ids=100)
    blocks = spark.read.parquet(folder).orderBy("block").collect()
    assert [b.n_ids for b in blocks] == [100] * 6 and [b.first_id for b in blocks] == list(range(0, 600, 100))
    out = tokenids.read_ids(spark, folder).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in out] == [(i, 10 * i, 10) for i in range(60)]
