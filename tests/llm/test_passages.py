"""Substring dedup and suffix arrays against brute force, with nulls, repeated rows and clashing names."""

from collections import Counter

import numpy as np
import pytest

from tesserae.llm import passages, substring, suffix_array

SCHEMA = "doc_id long, text string, d int, runs string"


def brute(data, length):
    rows = list(dict.fromkeys(data))
    split = [(r[0], (r[1] or "").split()) for r in rows]
    count = Counter(tuple(w[p : p + length]) for _, w in split for p in range(len(w) - length + 1))
    out = set()
    for i, w in split:
        mark = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if count[tuple(w[p : p + length])] > 1:
                mark[p : p + length] = True
        at = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(int), [0]])))
        out |= {(i, int(a), int(b - a)) for a, b in zip(at[::2], at[1::2])}
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"p{k}_{i}" for i in range(int(rng.integers(6, 25)))) for k in range(4)]
    out = []
    for i in range(40):
        parts = []
        for _ in range(3):
            parts.append(" ".join(f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(0, 20)))))
            if rng.random() < 0.4:
                parts.append(shared[int(rng.integers(0, 4))])
        out.append((i, "  \n".join(parts), 0, "x"))
    out += [(50, "a b " * 30, 0, "x"), (51, None, 0, "x"), (52, "", 0, "x"), (53, "one", 0, "x"), (None, shared[0] + " " + shared[1], 0, "x"), out[0], out[1], (7, "differs " + out[2][1], 1, "y"), (54, "é" * 3 + " ß " + shared[2], 0, "x")]
    return out


@pytest.mark.parametrize("operator", [substring.repeated_spans, suffix_array.repeated_spans])
def test_spans_against_brute_force(spark, operator):
    data = corpus(5)
    df = spark.createDataFrame(data, SCHEMA)
    got = operator(df, length=8, gram=3).collect()
    assert {tuple(r) for r in got} == brute(data, 8) and len(got) == len({tuple(r) for r in got})


def test_small_shards_and_small_memory(spark):
    data = corpus(6)
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data, 8)
    assert {tuple(r) for r in substring.repeated_spans(df, length=8, gram=3, shard_bytes=200).collect()} == want
    assert {tuple(r) for r in suffix_array.repeated_spans(df, length=8, gram=3, shard_words=100, memory=16).collect()} == want


@pytest.mark.parametrize("operator", [substring.repeated_spans, suffix_array.repeated_spans])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    assert operator(spark.createDataFrame([(1, None, 0, ""), (2, "x", 0, "")], SCHEMA)).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, k, cap = int(rng.integers(1, 60)), int(rng.integers(1, 5)), int(rng.integers(1, 8))
        text = np.append(rng.integers(0, k, n), -1)
        order, prefixes = suffix_array.suffix_array(text, cap, None, int(rng.integers(3, 50)))
        t, got, lcp = text.tolist(), list(order)[::-1], list(prefixes)[::-1]
        assert got == sorted(range(len(t)), key=lambda i: t[i:])
        for i, (a, b) in enumerate(zip(got, got[1:])):
            m = 0
            while m < cap and max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert lcp[i] == m


def test_disk_queue_keeps_order():
    rng = np.random.default_rng(2)
    queue, held, out = suffix_array.DiskQueue(suffix_array.Spill(None), 2, 7), [], []
    for x in rng.integers(0, 50, 300).tolist():
        queue.push((x, len(held)))
        held.append((x, len(held)))
    while (item := queue.take(None)) is not None:
        out.append(tuple(item))
    assert out == sorted(held)


def test_anchors_follow_the_words():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 300, dtype=np.uint64)
    shifted = np.concatenate([rng.integers(0, 2**63, 37, dtype=np.uint64), words[40:220], rng.integers(0, 2**63, 9, dtype=np.uint64)])
    g1, p1 = passages.anchor_places(words, 20, 5)
    g2, p2 = passages.anchor_places(shifted, 20, 5)
    for w in range(40, 220 - 20 + 1):
        assert g1[p1[w]] == g2[p2[w - 3]] and p1[w] - 3 == p2[w - 3]
