from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from marlstone.llm.packing import container_fill, make_plan, optimal_bounds, pack_documents
from marlstone.llm.tokens import token_counts


def padding(histogram, bounds):
    s = np.arange(len(histogram))
    return int((histogram * (np.asarray(bounds)[np.searchsorted(bounds, np.maximum(s, 1))] - s)).sum())


def bounds_of(h, buckets):
    s = np.flatnonzero(h)
    return optimal_bounds(s, h[s].astype(float), len(h) - 1, buckets)


@pytest.mark.parametrize("seed", range(25))
def test_bounds_are_optimal(seed):
    from itertools import combinations

    h = np.random.default_rng(seed).integers(0, 5, 13)
    best = min(padding(h, [*c, 12]) for n in range(3) for c in combinations(range(1, 12), n))
    assert padding(h, bounds_of(h, 3)) == best


def test_bounds_of_a_large_capacity():
    """Against the plain dynamic programme over every end, 3,000 sizes in 40 buckets."""
    rng = np.random.default_rng(1)
    h = np.zeros(9001, dtype=np.int64)
    h[rng.choice(9000, 3000, replace=False) + 1] = rng.integers(1, 500, 3000)
    ends = np.union1d(np.flatnonzero(h), [9000])
    own = h[ends].astype(float)
    count, weight = np.concatenate([[0], np.cumsum(own)]), np.concatenate([[0], np.cumsum(own * ends)])
    cost = ends[None, :] * (count[None, 1:] - count[:-1, None]) - (weight[None, 1:] - weight[:-1, None])
    cost[np.tril_indices(len(ends), -1)] = np.inf
    best = cost[0].copy()
    for _ in range(39):
        best = np.minimum(best, np.append(np.inf, (best[:-1, None] + cost[1:, 1:]).min(axis=0)))
    assert padding(h, bounds_of(h, 40)) == best[-1]


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_everything(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(513, dtype=np.int64)
    np.add.at(h, rng.integers(0, 513, 20_000), 1)
    p = make_plan(np.flatnonzero(h), h[np.flatnonzero(h)], 512, 32)
    assert p.containers * 512 >= (h * np.arange(513)).sum()
    room = defaultdict(int)
    for b, n, c in zip(p.bucket, p.per_batch, p.first_container, strict=True):
        room[int(c)] += int(p.bounds[b]) * int(n)
    assert max(room.values()) <= 512


DOCS = "doc_id bigint, text string, pack_name string, size int"


def test_packing(spark, data):
    docs, packs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{data}/pack_sizes.parquet")
    packed = pack_documents(docs, packs).collect()
    size = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    capacity = {r.pack_name: r.capacity_tokens for r in packs.collect()}
    parts, room = defaultdict(list), defaultdict(int)
    for r in packed:
        parts[r.pack_name, r.doc_id].append((r.part_no, r.first_token, r.n_tokens))
        room[r.pack_name, r.container_id] += r.n_tokens
    assert set(parts) == {(p, d) for p in capacity for d in size}
    for (pack, doc), rows in parts.items():
        rows.sort()
        assert sum(n for *_, n in rows) == size[doc] and [k for k, *_ in rows] == list(range(len(rows)))
        assert len(rows) == max(1, -(-size[doc] // capacity[pack])) and all(f == k * capacity[pack] for k, f, _ in rows)
    assert all(n <= capacity[p] for (p, _), n in room.items())
    filled = container_fill(pack_documents(docs, packs), packs).collect()
    assert min(r.fill for r in filled) > 0.95 and all(r.least <= r.containers <= 1.06 * r.least + 1 for r in filled)


def test_edges(spark):
    packs = spark.createDataFrame([("a", 10), ("a", 10), ("none", None), ("zero", 0), (None, 5), ("vast", 2_000_000_000)], "pack_name string, capacity_tokens int")
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "word " * 5000, "x", 1), (4, "one", "x", 1), (5, "one", "x", 1)]
    got = pack_documents(spark.createDataFrame(rows * 2, DOCS), packs).collect()
    assert {r.pack_name for r in got} == {"a", "vast"} and {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    assert len({(r.pack_name, r.doc_id, r.part_no) for r in got}) == len(got)
    assert pack_documents(spark.createDataFrame([], DOCS), packs).count() == 0
    assert pack_documents(spark.createDataFrame(rows, DOCS), packs.limit(0)).count() == 0
