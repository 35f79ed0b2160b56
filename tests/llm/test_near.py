"""SimHash and embeddings against brute force; components on awkward graphs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bendpoint.llm import embed_dedup, simhash
from bendpoint.llm.components import components

from .conftest import rows
from .test_native import TABLE


def reach(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, size=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(TABLE)) if x]
    runs = [" ".join(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    draw = np.random.default_rng(1)
    chain = draw.permutation(300).tolist()
    pairs = list(zip(chain[:-1], chain[1:], strict=True)) + [(400, i) for i in range(401, 460)] + [(500, 500), (600, 601)]
    out = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    want = reach(700, pairs)
    nodes = {x for p in pairs for x in p} - {500}
    assert rows(out, "node", "root") == sorted(((i, want[i]) for i in nodes), key=repr)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sliced_links_equal_popcounts():
    draw = np.random.default_rng(2)
    seeds = draw.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.concatenate([
        seeds[draw.integers(0, 6, 700)] ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (4, 700)).astype(np.uint64), axis=0),
        draw.integers(0, 2**63, 100, dtype=np.uint64),
    ])
    starts = np.array([0, 1, 66, 300])
    for radius in (0, 3, 4, 6):
        got = {(int(a), int(b)) for u, v in simhash.sliced_links(fps, starts, radius) for a, b in zip(u, v, strict=True)}
        bounds = [*starts.tolist(), len(fps)]
        want = {
            (i, j) for low, high in zip(bounds[:-1], bounds[1:], strict=True) for i in range(low, high) for j in range(i + 1, high)
            if int(fps[i] ^ fps[j]).bit_count() <= radius
        }
        assert got == want


@pytest.mark.parametrize("unit_rows", [4096, 16])
def test_links_lose_nothing(spark, unit_rows):
    draw = np.random.default_rng(3)
    seeds = draw.integers(-(2**62), 2**62, 12)
    fps = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in draw.integers(0, 63, (20, 2))}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 4, unit_rows)
    at = {f: i for i, f in enumerate(fps)}
    got = reach(len(fps), [(at[r.a], at[r.b]) for r in edges.collect()])
    want = reach(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4])
    assert got == want


def test_blocks_cover_all_bits():
    for n, blocks in ((10, 5), (10**9, 6), (10**12, 8)):
        assert simhash.choose_blocks(n, 4) >= blocks - 1
    for blocks in (5, 6, 7):
        for mask in simhash.block_masks(blocks, 4):
            assert -(2**63) <= mask < 2**63


def test_simhash_cases(spark, docs_of):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here to there " * 6
    docs = [
        (5, base), (3, base), (9, base.upper()), (7, base + " indeed"), (8, None), (2, ""), (6, "  \t\n"), (4, "one two"),
        (4, "One\x0bTWO"), (1, "Été é x y z"), (None, base), (10, "something else that is not like the others at all, no"),
        (3, base),
    ]
    out = simhash.near_duplicates(docs_of(docs))
    prints = [fingerprint(t) for _, t in docs]
    groups = reach(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {g: min((d for (d, _), x in zip(docs, groups, strict=True) if x == g and d is not None), default=None) for g in groups}
    want = sorted(((d, p - (p >> 63 << 64), least[g]) for (d, _), p, g in zip(docs, prints, groups, strict=True)), key=repr)
    assert rows(out, "doc_id", "fp", "component_id") == want
    kept = simhash.keep_one(docs_of(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert kept.columns == docs_of(docs).columns
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_majority_over_chunks(monkeypatch):
    draw = np.random.default_rng(4)
    counts = np.array([0, 5, 1, 0, 300, 2, 0])
    flat = draw.integers(-(2**63), 2**63 - 1, counts.sum())
    whole = simhash.majority(flat, counts)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert np.array_equal(simhash.majority(flat, counts), whole)
    assert whole[0] == 0 and whole[2] == flat[5]


def test_embeddings(spark):
    draw = np.random.default_rng(6)
    seeds = draw.normal(size=(30, 12))
    x = np.concatenate([seeds[draw.integers(0, 30, 300)] + 0.12 * draw.normal(size=(300, 12)), draw.normal(size=(100, 12))])
    x = np.float32(x)
    x[7], x[8] = x[6], 3 * x[6]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(vectors)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [float("nan")] * 12), (n + 4, [float("inf")] + [1.0] * 11), (n + 5, [None] + [1.0] * 11), (n + 6, [1.0, 0.0]), (n + 7, [2.0, -0.0]), (n + 8, [1e30, 1e30]), (6, x[6].tolist())]
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors + odd], "vec_id bigint, embedding array<float>, label int")
    units = np.concatenate([x, x[6:7]]).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(n), 6]
    roots = reach(n + 1, [(i, j) for i, j in np.argwhere(near) if i > j])
    want = [(ids[i], int(near[i].sum()), ids[roots[i]], ids[i] == ids[roots[i]]) for i in range(n + 1)]
    want += [(n + k, 0, n + k, True) for k in (0, 1, 2, 3, 4, 5, 8)] + [(n + 6, 1, n + 6, True), (n + 7, 1, n + 6, False)]
    for tile_rows, sample in ((4096, 10_000), (32, 50)):
        out = embed_dedup.near_duplicates(table, tile_rows=tile_rows, sample_rows=sample)
        assert rows(out, "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)
    empty = table.filter(F.lit(False))
    assert embed_dedup.near_duplicates(empty).count() == 0
