"""Suffix sorting and removal of repeated strings against brute force."""

import gc
import hashlib
import os
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from simspark.llm import suffix
from simspark.llm.common import Workspace
from simspark.llm.substring_dedup import dedup_documents, digests, repeated_windows, segments
from simspark.llm.suffix import suffix_array


def unique_ends(text, i):
    out = []
    while text[i]:
        out.append((int(text[i]), 0))
        i += 1
    return [*out, (0, i)]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_matches_sorting(seed):
    rng = random.Random(seed)
    for _ in range(120):
        letters = rng.choice([1, 2, 3, 10])
        text = np.array([c for _ in range(rng.randrange(1, 6)) for c in [*(rng.randint(1, letters) for _ in range(rng.randrange(14))), 0]], np.uint8)
        cap = rng.choice([3, 100])
        order, lcp = suffix_array(text, cap, limit=rng.choice([3, 1000]), base=rng.choice([2, 1000]))
        want = sorted((i for i in range(len(text)) if text[i]), key=lambda i: unique_ends(text, i))
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = unique_ends(text, want[k - 1]), unique_ends(text, want[k])
            same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(same, cap)


def brute(rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé \0\n") for _ in range(rng.randrange(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    common, edge = text(30), text(9)
    rows = [(i, text(rng.randrange(1, 40))) for i in range(30)]
    rows += [(100 + i, text(6) + common + text(6)) for i in range(25)]
    rows += [(200 + i, text(4) + edge + text(4)) for i in range(25)]
    rows += [(300 + i, rows[3][1]) for i in range(4)] + [(400, "ab" * 300), (401, "x" * 200), (402, None), (403, ""), (None, rows[40][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("hot", [2, 6, 1000])
def test_removed_bytes_match_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = digests(Workspace(spark, "t"), docs, length=40, anchor=12, hot=hot, cell=8, shard_bytes=2000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 40)


def test_texts_keep_their_columns_and_whole_characters(spark):
    rows = [(1, "é" * 60 + "tail", "a", 1), (2, "é" * 60 + "end", "b", 2), (3, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, items int")
    got = dedup_documents(Workspace(spark, "t"), docs, length=40, anchor=12)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "tail", "a", 1), (2, "end", "b", 2), (3, None, None, 3)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digests(Workspace(spark, "t"), docs).collect() == []


def test_common_prefixes_hash_few_places(monkeypatch):
    rng = np.random.default_rng(4)
    part = rng.integers(97, 105, 20_000, dtype=np.uint8)
    text = np.concatenate([part, [0], part[5_000:], [0], rng.integers(97, 105, 5_000, dtype=np.uint8), [0]]).astype(np.uint8)
    hashed, ranged = [], []
    span, least = suffix._hash.span, suffix._range_min
    monkeypatch.setattr(suffix._hash, "span", lambda prefix, a, b: hashed.append(len(a)) or span(prefix, a, b), raising=False)
    monkeypatch.setattr(suffix, "_range_min", lambda values, a, b: ranged.append(len(a)) or least(values, a, b))
    order, lcp = suffix_array(text, 400)
    assert sum(hashed) < len(text) and sum(ranged) < 1.2 * len(order)
    bodies = [bytes(text[i : i + 400]).split(b"\0")[0] for i in order.tolist()]
    assert lcp.tolist()[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(bodies, bodies[1:])]


def test_sorter_holds_few_arrays():
    text = np.append(np.random.default_rng(6).integers(97, 123, 1_000_000, dtype=np.uint8), np.uint8(0))
    suffix_array(text[-1_000:], 400)
    suffix._hash.prefix(text)  # powers that all sorts share
    tracemalloc.start()
    try:
        suffix_array(text, 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70 * len(text)


def test_segments_without_names_are_the_same():
    rng = np.random.default_rng(5)
    body, offsets = rng.integers(97, 101, 300_000, dtype=np.uint8), np.array([0, 0, 90_000, 90_399, 200_000, 300_000])
    full, bare = segments(body, offsets), segments(body, offsets, named=False)
    assert all((a == b).all() for a, b in zip(full[:5], bare)) and not bare[5].any()
    text, first, windows, place, *_ = full
    owned = sorted((t, w) for t, f, n in zip(text.tolist(), first.tolist(), windows.tolist()) for w in range(f, f + n))
    assert owned == [(t, w) for t in range(5) for w in range(max(0, int(offsets[t + 1] - offsets[t]) - 399))]


def test_a_pass_leaves_its_result_only(spark):
    """Tables and shuffle files of a pass would stay while the next one runs."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(3)
    before, ws = files(), Workspace(spark, "t")
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(90)
    docs = spark.createDataFrame([(i, text(50) + passage + text(50)) for i in range(8)], "uid long, text string")
    items = repeated_windows(ws, docs, length=40, anchor=12, shard_bytes=2000)
    assert os.listdir(ws.path.removeprefix("file://")) == ["items"]
    until = time.time() + 20
    while files() > before and time.time() < until:
        ws.free()
        time.sleep(0.5)
    assert files() <= before and items.count() == 8
