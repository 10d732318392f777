"""Operators for training data over whole candidates, where shorter comparisons lost some."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import families, leaks


@pytest.mark.parametrize(("block", "shingles"), [(1024, 10**6), (30, 10**6), (1024, 900)])
def test_links_of_a_mixed_bucket(spark, monkeypatch, block, shingles):
    """One bucket of 200 pairs that resemble nothing else: each is found, also over several blocks, by number or by size."""
    monkeypatch.setattr(families, "BLOCK_SHINGLES", shingles)
    rng = random.Random(2)
    rows = []
    for k in range(200):
        base = [rng.randrange(2**31) for _ in range(18)]
        for j in range(2):
            rows.append((2 * k + j, np.sort(np.array([*base, 2**31 + 2 * k + j], np.uint32)).tobytes(), 19, [7, k if j == 0 else -k - 1]))
    df = spark.createDataFrame(rows, "class bigint, shingles binary, n int, bands array<bigint>")
    assert {tuple(r) for r in families.class_links(df, block).collect()} == {(2 * k, 2 * k + 1) for k in range(200)}


def test_recall_in_a_bucket_of_more_than_a_thousand(spark):
    """1,200 classes that all share one bucket, in families of about ten whose members lie between 0.7 and 1: against all
    pairs, every two classes of similarity 0.8 or more end in one family."""
    rng = np.random.default_rng(3)
    rows, sets = [], []
    for k in range(1200):
        base = (np.arange(60) + 1000 * (k % 120)).astype(np.uint32)
        own = np.unique(np.concatenate([rng.choice(base, 60 - int(rng.integers(0, 9)), replace=False), (10**6 + 50 * k + np.arange(int(rng.integers(0, 4)))).astype(np.uint32)]))
        sets.append(set(own.tolist()))
        rows.append((k, own.tobytes(), len(own), [5, *(int(x) for x in rng.integers(-(2**60), 2**60, 2))]))
    df = spark.createDataFrame(rows, "class bigint, shingles binary, n int, bands array<bigint>")
    parent = list(range(1200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in families.class_links(df, 400).collect():
        parent[find(a)] = find(b)
    pairs = [(i, j) for m in range(120) for i in range(m, 1200, 120) for j in range(i + 120, 1200, 120) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 1000 and all(find(i) == find(j) for i, j in pairs)
    assert len({find(k) for k in range(1200)}) >= 120


@pytest.mark.parametrize("runs", [(5, 5, 8), (5, 8, 5), (8, 5, 5), (4, 5, 9), (4, 4, 10)])
@pytest.mark.parametrize("change", [[], ["one", "two"]])
def test_changes_of_the_number_of_words(runs, change):
    """A passage of 20 words of which two are dropped, or replaced by two words each."""
    words = [f"w{k}x" for k in range(80)]
    index = leaks.build_index([(1, " ".join(words))], Counter())
    quoted, at = [], 30
    for n in runs:
        quoted += [*words[at : at + n], *change]
        at += n + 1
    tokens, begins, *_ = leaks._tokens(["before it " + " ".join(quoted[: len(quoted) - len(change)]) + " behind it"], index)
    assert list(leaks._matches(index.words, tokens, begins)) == [(0, 0)]


def test_changes_of_the_number_of_characters():
    """A passage of 60 characters of which six are dropped, in runs of 6 and one of 18."""
    text = "".join(chr(0x4E00 + 7 * k) for k in range(200))
    index = leaks.build_index([(1, text)], Counter())
    at, quoted = 40, ""
    for n in (6, 6, 6, 18, 6, 6, 6):
        quoted += text[at : at + n]
        at += n + 1
    _, _, chars, begins, _ = leaks._tokens(["\u5f00" + quoted + "\u675f"], index)
    assert list(leaks._matches(index.chars, chars, begins)) == [(0, 0)]
